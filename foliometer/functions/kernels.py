"""Sequential kernels that columns cannot express, in plain Python and numpy: edit distance, common subsequence, assignment, sequence alignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def _masks(a: Sequence) -> dict:
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences (code points or tokens), one whole column of the table per step; what both begin and end with is passed over."""
    if a == b:
        return 0
    begin, most = 0, min(len(a), len(b))
    while begin < most and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < most - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if len(a) < len(b):  # fewer columns, and longer ones
        a, b = b, a
    if not b:
        return len(a)
    # nothing comes down from bits above the last row, so they are cut off once a column; negative numbers would cost twice as much
    masks, full = _masks(a), (1 << len(a)) - 1
    plus, minus = full, 0
    for x in b:
        eq = masks.get(x, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = (minus | ((zero | plus) ^ full)) << 1 | 1, (plus & zero) << 1
        plus, minus = (down | ((zero | up) ^ full)) & full, up & zero
    return len(b) + plus.bit_count() - (minus & full).bit_count()


def common_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence; what both begin and end with is in one."""
    begin, most = 0, min(len(a), len(b))
    while begin < most and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < most - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return begin + end
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    rest = iter(long_)
    if all(c in rest for c in short):  # all of it is in the other, in order
        return begin + end + len(short)
    return begin + end + _common(_masks(long_), len(long_), short)


def _common(masks: dict, size: int, short: Sequence) -> int:
    """`common_length` of a sequence, by its masks and size, and one that is best the shorter: a whole column of the table per step."""
    row = full = (1 << size) - 1
    for x in short:
        if x in masks:
            hit = row & masks[x]
            row = (row + hit | row ^ hit) & full
    return size - row.bit_count()


def _common_of_many(pairs: list[tuple[str, str]]) -> list[int]:
    """`common_length` of each pair; many short texts are compared with the same long one, whose masks are made once."""
    out, by_long = [0] * len(pairs), {}
    for k, (a, b) in enumerate(pairs):
        short, long_ = (a, b) if len(a) <= len(b) else (b, a)
        if short in long_:
            out[k] = len(short)
        else:
            by_long.setdefault(long_, []).append((k, short))
    for long_, others in by_long.items():
        masks = _masks(long_)
        for k, short in others:
            out[k] = _common(masks, len(long_), short)
    return out


_WINDOW, _BELOW = 64, 31
#: Texts of so many characters are compared together, and so many pieces of them at most.
_TOGETHER, _PIECES = 300_000, 4096


def _codes(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _narrow(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' characters as numbers from 2, in a byte each if there are few enough."""
    seen = np.zeros(int(max(a.max(initial=0), b.max(initial=0))) + 1, dtype=bool)
    seen[a] = seen[b] = True
    number = np.cumsum(seen) + 1
    number = number.astype(np.uint8 if number[-1] < 256 else np.uint32)
    return number[a], number[b]


def _near(a: np.ndarray, b: np.ndarray, at: np.ndarray, indel: bool) -> np.ndarray:
    """The least cost of each piece's paths that stay within 31 places of the diagonal, all pieces a column at a time.

    at: a row for each piece, its begin and end in a and in b. A replacement counts as one edit, with indel as two.
    """
    n, m = at[:, 1] - at[:, 0], at[:, 3] - at[:, 2]
    wide = int(max(n.max(), m.max()))
    ours, theirs = np.zeros((len(at), _BELOW + wide + _WINDOW), dtype=a.dtype), np.ones((wide, len(at)), dtype=a.dtype)
    for side, size, first, put in ((a, n, at[:, 0], lambda k, c, x: ours.__setitem__((k, c + _BELOW), x)), (b, m, at[:, 2], lambda k, c, x: theirs.__setitem__((c, k), x))):
        k = np.repeat(np.arange(len(at)), size)
        c = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
        put(k, c, side[first[k] + c])
    one, top = np.uint64(1), np.uint64(1 << 63)
    hits_of = lambda j: np.packbits(ours[:, j : j + _WINDOW] == theirs[j][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    if indel:
        row, gone = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), dtype=np.int64)
        for j in range(wide):
            hits = hits_of(j)
            row = (row + (row & hits)) | (row & ~hits)
            gone += (~row & one).astype(np.int64)
            row = (row >> one) | top
        return n + m - 2 * (gone + np.bitwise_count(~row))
    # differences down a column, of the rows from 31 above the diagonal; nothing above the first row matches, so it costs a step each
    plus, minus, score = np.full(len(at), ~np.uint64(0) << np.uint64(_BELOW)), np.zeros(len(at), dtype=np.uint64), n - m
    diagonal = (_BELOW + n - m).astype(np.uint64)  # of the last cell; at its begin are n - m insertions
    for j in range(wide):
        hits = hits_of(j)
        zero = (((hits & plus) + plus) ^ plus) | hits | minus
        score = score + ((j < m) & ((zero >> diagonal) & one == 0))
        up, down = minus | ~(zero | plus), zero & plus
        zero >>= one
        plus, minus = down | ~(zero | up), zero & up
    return score


_MULTIPLIER = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F), 4: np.uint64(0x165667B19E3779F9), 8: np.uint64(0xD6E8FEB86659FD93)}


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` characters, a power of two."""
    out, n = codes.astype(np.uint64), 1
    while n < size:
        out = out[:-n] * _MULTIPLIER[n] + out[n:] if len(out) > n else out[:0]
        out ^= out >> np.uint64(31)
        n *= 2
    return out * _MULTIPLIER[1]


def _cut(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, size: int, swap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (begin and end in a and in b) whose distances sum to those of the pairs, their pairs, a bound of their cost, and whether they are straight.

    a, b: all pairs' characters one after the other, n, m each; swap: the cost of a replacement. Each first text is laid out in
    windows of `size`. A path along those that occur once on either side is taken, straight between two on one diagonal. Any other
    path leaves it and comes back; meanwhile it pays at least one edit for each window that occurs nowhere but on the path. Where
    all such detours that pass a place pay as much as the path itself does there, some best path leads through that place.
    """
    a0, b0, count = np.cumsum(n) - n, np.cumsum(m) - m, -(-n // size)
    of = np.repeat(np.arange(len(n)), count)
    w0 = np.cumsum(count) - count
    row = size * (np.arange(len(of)) - w0[of])  # of a window in its text
    full = row + size <= n[of]
    salt = np.arange(len(n), dtype=np.uint64) * _MULTIPLIER[2]
    ours, theirs = np.zeros(len(of), dtype=np.uint64), _rolled(b, size)
    ours[full] = _rolled(a, size)[(a0[of] + row)[full]]
    ours ^= salt[of]
    text = np.repeat(np.arange(len(m)), m)[: len(theirs)]
    theirs ^= salt[text]
    # where each window is in the other text
    kinds, kind, alike = np.unique(ours[full], return_inverse=True, return_counts=True)
    seen = np.zeros(1 << 20, dtype=bool)
    seen[kinds >> np.uint64(44)] = True
    place = np.flatnonzero(seen[theirs >> np.uint64(44)])
    place = place[place + size <= (b0 + m)[text[place]]]
    found = np.searchsorted(kinds, theirs[place])
    hit = found < len(kinds)
    hit[hit] = kinds[found[hit]] == theirs[place[hit]]
    place, found = place[hit], found[hit]
    times, where = np.bincount(found, minlength=len(kinds)), np.zeros(len(kinds), dtype=np.int64)
    where[found] = place
    occurs, column = np.full(len(of), 2), np.zeros(len(of), dtype=np.int64)
    occurs[full], column[full] = times[kind], where[kind]
    once = np.zeros(len(of), dtype=bool)
    once[full] = (times[kind] == 1) & (alike[kind] == 1)
    fixed = np.flatnonzero(once)
    shift = column[fixed] - b0[of[fixed]] - row[fixed]
    fixed = fixed[np.abs(shift) < _BELOW]
    c = column[fixed]
    fixed = fixed[(c == np.maximum.accumulate(c)) & (c == np.minimum.accumulate(c[::-1])[::-1])] if len(c) else fixed
    close = np.flatnonzero((np.diff(column[fixed]) < size) & (np.diff(of[fixed]) == 0))
    fixed = np.delete(fixed, np.union1d(close, close + 1))
    # the path's diagonal before and after each window
    held = np.full(len(of), -1)
    held[fixed] = fixed
    diagonal = np.zeros(len(of), dtype=np.int64)
    diagonal[fixed] = column[fixed] - b0[of[fixed]] - row[fixed]
    last, following = np.maximum.accumulate(held), np.minimum.accumulate(np.where(held < 0, len(of), held)[::-1])[::-1]
    before = np.where(last >= w0[of], diagonal[last], 0)
    after = np.where(following < (w0 + count)[of], diagonal[np.minimum(following, len(of) - 1)], (m - n)[of])
    straight = before == after
    step = np.arange(size)
    inside = row[:, None] + step < n[of][:, None]
    x = np.minimum((a0[of] + row)[:, None] + step, len(a) - 1)
    y = np.clip((b0[of] + row + before)[:, None] + step, 0, len(b) - 1)
    wrong = ((a[x] != b[y]) & inside).sum(axis=1)
    cost = np.where(straight, swap * wrong, swap * size + np.abs(after - before))
    turn = np.flatnonzero((of[1:] == of[:-1]) & straight[1:] & straight[:-1] & (before[1:] != before[:-1]))
    apart = np.abs(before[turn + 1] - before[turn])
    cost[turn] += apart
    cost[turn + 1] += apart
    ends_of = w0 + count - 1
    cost[w0] += np.where(straight[w0], np.abs(before[w0]), 0)
    cost[ends_of] += np.where(straight[ends_of], np.abs((m - n) - after[ends_of]), 0)
    off = ~straight
    off[turn] = off[turn + 1] = True
    off[w0] |= before[w0] != 0
    off[ends_of] |= after[ends_of] != m - n
    pays = full & ((occurs == 0) | (occurs == 1) & straight & (wrong == 0))
    sums, paid = np.concatenate([[0], np.cumsum(cost)]), np.concatenate([[0], np.cumsum(pays)])
    lower = of * (int(sums[-1]) + len(of) + 1)  # keeps the texts apart
    most = np.maximum.accumulate((sums[1:] - paid[:-1] - lower)[::-1])[::-1]
    least = np.minimum.accumulate(sums[:-1] - paid[1:] - lower)
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | straight[1:] & (most[1:] <= least[:-1])])) if len(of) else np.zeros(0, dtype=np.int64)
    owner = of[first]
    ends = np.concatenate([owner[1:] != owner[:-1], [True]])
    begin_a, begin_b = a0[owner] + row[first], b0[owner] + row[first] + np.where(first == w0[owner], 0, before[first])
    end_a, end_b = np.where(ends, (a0 + n)[owner], np.append(begin_a[1:], 0)), np.where(ends, (b0 + m)[owner], np.append(begin_b[1:], 0))
    bent = np.concatenate([[0], np.cumsum(off)])
    upto = np.append(first[1:], len(of))
    return np.stack([begin_a, end_a, begin_b, end_b], axis=1), owner, sums[upto] - sums[first], bent[upto] == bent[first]


def _banded(a: str, b: str, most: int) -> int:
    """The edit distance of two texts, at most `most`: paths that cost no more stay close to the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    off = len(a) - len(b)
    below = (most - off) // 2 + 1
    reach, full = below + off, (1 << 2 * below + off + 1) - 1
    rows: dict[str, list[int]] = {}  # where a character is, counted from the band's begin at a column
    for r, x in enumerate(a[:reach]):
        rows.setdefault(x, [0, 0])[0] |= 1 << r + below
    plus, minus, score = full >> below << below, 0, off
    for j, x in enumerate(b):
        if j + reach < len(a):
            of = rows.setdefault(a[j + reach], [0, j])
            of[0] |= 1 << j + reach + below - of[1]
        hits = 0
        if x in rows:
            of = rows[x]
            of[0] >>= j - of[1]
            hits, of[1] = of[0], j
        zero = ((((hits & plus) + plus) ^ plus) | hits | minus) & full
        score += not zero >> reach & 1
        up, down = minus | ((zero | plus) ^ full), zero & plus
        zero >>= 1
        plus, minus = down | ((zero | up) ^ full), zero & up
    return score


def _by_pieces(pairs: list[tuple[str, str]], indel: bool) -> list[int]:
    """The distance of each pair of texts, none empty, by pieces: many at once where they differ in few places, else one by one."""
    a, b = _codes([x for x, _ in pairs]), _codes([y for _, y in pairs])
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    at, owner, most, straight = _cut(a, b, n, m, 8, 2 if indel else 1)
    # one edit, or two of equal lengths, on one diagonal: nothing else costs less
    distance = np.where(straight & (most <= 2), most, -1)
    size = np.maximum(at[:, 1] - at[:, 0], at[:, 3] - at[:, 2])
    near = np.flatnonzero((distance < 0) & (most <= 32 * _WINDOW) & (size <= 4000))
    near = near[np.argsort(size[near], kind="stable")]
    x, y = _narrow(a, b)
    while len(near):
        upto = int(np.searchsorted(size[near[: min(_PIECES, 2_000_000 // int(size[near[0]]))]], 1.2 * size[near[0]] + 8, side="right"))
        some, near = near[:upto], near[upto:]
        more = (at[some, 1] - at[some, 0]) - (at[some, 3] - at[some, 2])
        for k, off, got in ((some[more >= 0], more[more >= 0], lambda k: _near(x, y, at[k], indel)), (some[more < 0], -more[more < 0], lambda k: _near(y, x, at[k][:, [2, 3, 0, 1]], indel))):
            if len(k):
                found = got(k)
                distance[k] = np.where(found + off <= _WINDOW - 2, found, -1)
    a0, b0 = np.cumsum(n) - n, np.cumsum(m) - m
    for k in np.flatnonzero(distance < 0).tolist():
        pair, (i, i1, j, j1) = owner[k], at[k].tolist()
        one, other = pairs[pair][0][i - a0[pair] : i1 - a0[pair]], pairs[pair][1][j - b0[pair] : j1 - b0[pair]]
        if indel:
            distance[k] = len(one) + len(other) - 2 * common_length(one, other)
        else:
            distance[k] = _banded(one, other, int(most[k])) if 3 * most[k] < len(one) else edit_distance(one, other)
    return np.bincount(owner, weights=distance, minlength=len(pairs)).astype(np.int64).tolist()


def _in_turn(pairs: list[tuple[str, str]], at: list[int], indel: bool) -> list[tuple[int, int]]:
    """Place and `_by_pieces` of the pairs at the places, some characters at a time."""
    out, k = [], 0
    while k < len(at):
        upto, chars = k, 0
        while upto < len(at) and chars < _TOGETHER:
            chars, upto = chars + len(pairs[at[upto]][0]), upto + 1
        out += zip(at[k:upto], _by_pieces([pairs[i] for i in at[k:upto]], indel), strict=True)
        k = upto
    return out


def edit_distances(pairs: list[tuple[str, str]]) -> list[int]:
    """`edit_distance` of each pair of texts; those of much the same length by pieces, as they may differ in few places."""
    alike = [k for k, (a, b) in enumerate(pairs) if a != b and min(len(a), len(b)) >= 64 and abs(len(a) - len(b)) <= 64]
    out = dict(_in_turn(pairs, alike, False))
    return [out[k] if k in out else edit_distance(a, b) for k, (a, b) in enumerate(pairs)]


def _near_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The longest common subsequence of each pair among those that stay within 31 places of the diagonal, all pairs a column at a time."""
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    a, b = _narrow(_codes([x for x, _ in pairs]), _codes([y for _, y in pairs]))
    return (n + m - _near(a, b, np.stack([np.cumsum(n) - n, np.cumsum(n), np.cumsum(m) - m, np.cumsum(m)], axis=1), True)) // 2


def common_lengths(pairs: list[tuple[str, str]]) -> list[int]:
    """`common_length` of each pair of texts.

    Where a common subsequence near the diagonal leaves no more characters out than any must that goes further off, it is
    the longest; long texts are compared by pieces, the rest one by one.
    """
    out = [-1] * len(pairs)
    near = sorted((k for k, (a, b) in enumerate(pairs) if a != b and min(len(a), len(b)) >= 24 and max(len(a), len(b)) <= 4000 and abs(len(a) - len(b)) <= 16), key=lambda k: len(pairs[k][0]))
    at = 0
    while at < len(near):
        upto = at + 1
        while upto < len(near) and upto - at < 1024 and len(pairs[near[upto]][0]) <= 1.2 * len(pairs[near[at]][0]) + 32:
            upto += 1
        if upto - at >= 8:
            for k, n in zip(near[at:upto], _near_lengths([pairs[k] for k in near[at:upto]]).tolist(), strict=True):
                a, b = pairs[k]
                if len(a) + len(b) - 2 * n <= _WINDOW - abs(len(a) - len(b)):
                    out[k] = n
        at = upto
    for k, n in _in_turn(pairs, [k for k, (a, b) in enumerate(pairs) if out[k] < 0 and a != b and min(len(a), len(b)) >= 400 and abs(len(a) - len(b)) <= 64], True):
        out[k] = (len(pairs[k][0]) + len(pairs[k][1]) - n) // 2
    rest = [k for k, n in enumerate(out) if n < 0]
    for k, n in zip(rest, _common_of_many([pairs[k] for k in rest]), strict=True):
        out[k] = n
    return out


def ratio(a: Sequence, b: Sequence) -> float:
    """Twice the common length over both lengths; 1 for two empty sequences."""
    return 2.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """The pairing of rows and columns, min(rows, columns) pairs, of greatest total score.

    Shortest augmenting paths. Among optima, pairs close to the diagonal are
    preferred through a bonus too small to change the total's order.
    """
    score = np.asarray(score, dtype=np.float64)
    if not score.size:
        return []
    if score.shape[0] > score.shape[1]:
        return sorted((i, j) for j, i in assign(score.T))
    n, m = score.shape
    off = np.abs(np.arange(n)[:, None] - np.arange(m)[None, :])
    cost = -(score - 1e-9 * off / max(n, m))
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
    if n == m:  # where many rows are alike they all want one column; with what each column costs at least taken off they want one each
        v[1:] = cost.min(axis=0)
    # each row may have its best column at once, if no row before it has that; only the others need a path
    left = cost - v[1:]
    u[1:] = left.min(axis=1)
    wanted, first = np.unique(left.argmin(axis=1), return_index=True)
    owner[wanted + 1] = first + 1
    for i in np.setdiff1d(np.arange(1, n + 1), first + 1).tolist():
        owner[0], j0 = i, 0
        low, used, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=np.int64)
        while True:
            used[j0] = True
            row = owner[j0]
            free = ~used[1:]
            slack = cost[row - 1] - u[row] - v[1:]
            better = free & (slack < low[1:])
            low[1:][better], back[1:][better] = slack[better], j0
            j1 = 1 + int(np.argmin(np.where(free, low[1:], np.inf)))
            delta = low[j1]
            u[owner[used]] += delta
            v[used] -= delta
            low[1:][free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def align(n: int, m: int, similarity: Callable[[int, int], float], least: float) -> list[tuple[int, int]]:
    """Order-keeping pairs of greatest total similarity, gaps for free; pairs under `least` cost a trifle and are not returned.

    Read back from the end: a pair before a gap in the first sequence before a gap in the second.
    """
    s = np.array([[similarity(i, j) for j in range(m)] for i in range(n)]).reshape(n, m)
    gain = np.where(s >= least, s, -1e-9)
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1] + gain[i - 1, j - 1], best[i - 1, j], best[i, j - 1])
    out, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j - 1] + gain[i - 1, j - 1]:
            if s[i - 1, j - 1] >= least:
                out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align_texts(a: Sequence[str], b: Sequence[str], similarity: Callable[[str, str], float], least: float) -> list[tuple[int, int]]:
    """`align` of two sequences of texts.

    Equal texts at the end belong together in the optimum that `align` reads back; those at the begin do in every optimum as
    long as no other text equals them. Only what is between is compared.
    """
    end = 0
    while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
        end += 1
    n, m, begin = len(a) - end, len(b) - end, 0
    while begin < min(n, m) and a[begin] == b[begin] and a[begin] not in a[begin + 1 : n] and b[begin] not in b[begin + 1 : m]:
        begin += 1
    between = align(n - begin, m - begin, lambda i, j: similarity(a[begin + i], b[begin + j]), least) if n > begin and m > begin else []
    return [*((i, i) for i in range(begin)), *((begin + i, begin + j) for i, j in between), *((n + i, m + i) for i in range(end))]
