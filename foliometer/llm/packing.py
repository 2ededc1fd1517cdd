"""Sequence packing by non-negative least squares.

Documents become token ids and one end id. Runs of `window` ids at the start of a
document fill sequences alone; what is left of each, its tail, is packed:

1. A histogram counts the tails by length in units of window / units ids, rounded down.
2. All combinations of up to `depth` lengths that add up to the window are
   enumerated, and non-negative least squares finds how often to use each so that
   together they match the histogram. The repeats are rounded and cut to what is there.
3. The r-th tail of a length goes to the combination and repeat that the plan has for
   rank r. As lengths were rounded down, a sequence holds a few ids too many;
   its longest tail, which comes last, is cut by those.
4. The residual (tails that the plan leaves over, the cut ends, tails under one unit) is
   packed greedily by exact length: a sequence takes as many as fit of the longest, then
   of the longest that fits what is open, and so on; if nothing fits, the shortest
   piece that is longer is cut. The same filling is repeated while there are pieces for it.
5. What the greedy step cuts off, and its last sequence if it stays open, is laid end to
   end and cut at each window; the last, partial window is cut at powers of two. So no
   sequence has padding: each holds `window` ids or a power of two.

The column `step` says which of these placed a piece: whole, nnls, greedy or rest.

Ids are written once, by the task that reads the texts, into a file of that task in the
shared folder; from there on rows hold places in these files, and the last pass maps them
for the check sums. Ranks are counted within each task as it writes, and shifted by
the counts of the tasks before, so no length, however common, meets in one task. The
driver gets two histograms: at most `units` and `window` rows; the plans made of them go
along with the tasks.

Nulls and ties: a null text is empty and yields its end id; a null doc_id stays.
Rows that repeat a doc_id are documents of their own. An empty table gives an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import mapped_dir, table, trim, written
from .words import SPACED, Words, slices


class WordEncoder:
    """Token ids of whole texts, word by word.

    For tokenizers that drop white space and split at it, a text's ids are those of
    its words, so each word is encoded once and kept in a table of bounded size. A
    word is known by its hash, its length and its first eight bytes together.
    """

    _kept: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this process."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str, slots: int = 1 << 21, pool: int = 8_000_000, chunk: int = 256) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.slots, self.pool, self.chunk = Tokenizer.from_file(path), slots, pool, chunk
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros((3, self.slots), np.uint64), np.full(self.slots, -1, np.int32)
        self.begin, self.length, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.entries = self.used = 0

    def _room(self, name: str, n: int) -> None:
        array = getattr(self, name)
        if len(array) < n:
            more = np.zeros(max(n, len(array) * 3 // 2), array.dtype)
            more[: len(array)] = array
            setattr(self, name, more)

    def _enter(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Adds entries of so many ids each; returns their numbers."""
        first, self.entries = self.entries, self.entries + len(size)
        for name, n in (("begin", self.entries), ("length", self.entries), ("ids", self.used + len(ids))):
            self._room(name, n)
        self.begin[first : self.entries] = self.used + np.cumsum(size) - size
        self.length[first : self.entries] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return np.arange(first, self.entries)

    def _encode(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Adds entries of the words at `at`, encoded as one text after the other; where in a text an id stands tells its word."""
        length = (words.end - words.start)[at]
        begin = np.cumsum(length + 1) - length - 1
        joined = np.full(int(length.sum()) + len(at), 32, dtype=np.uint8)
        joined[np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = words.data[np.repeat(words.start[at] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        chars = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))
        first, text = chars[begin], joined.tobytes().decode()
        flat, size = [], []
        for a in range(0, len(at), self.chunk):
            z = min(a + self.chunk, len(at))
            got = self.tokenizer.encode(text[first[a] : first[z] if z < len(at) else None], add_special_tokens=False)
            starts = np.fromiter((x for x, _ in got.offsets), np.int64, len(got))
            size.append(np.bincount(np.searchsorted(first[a:z] - first[a], starts, side="right") - 1, minlength=z - a))
            flat.append(np.array(got.ids, dtype=np.uint32))
        return self._enter(np.concatenate(flat), np.concatenate(size))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text's followed by end_id, and where each text's begin."""
        if self.used > self.pool:
            self._clear()
        words = Words(texts, SPACED, lower=False)
        keys = np.stack([words.hash, words.heads(), (words.end - words.start).astype(np.uint64)])
        slot = (keys[0] >> np.uint64(11)).astype(np.int64) & (self.slots - 1)
        which = np.where((self.keys[:, slot] == keys).all(axis=0), self.entry[slot], -1)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            _, first, back = np.unique(keys[0][missing], return_index=True, return_inverse=True)
            alike = (keys[:, missing] == keys[:, missing[first[back]]]).all(axis=0)
            if not alike.all():  # different words of one hash: each for itself
                back[~alike] = len(first) + np.arange((~alike).sum())
                first = np.concatenate((first, np.flatnonzero(~alike)))
            at = missing[first]
            new = self._encode(words, at)
            which[missing] = new[back]
            free = self.entry[slot[at]] < 0
            at, new = at[free][::-1], new[free][::-1]  # of several words of a slot the first stays
            self.keys[:, slot[at]], self.entry[slot[at]] = keys[:, at], new
        end = self._enter(np.array([end_id], np.uint32), np.ones(1, np.int64))[0]
        every = np.insert(which, words.first[1:], end)
        size = self.length[every].astype(np.int64)
        place = np.cumsum(size) - size
        out = self.ids[np.repeat(self.begin[every] - place, size) + np.arange(size.sum())]
        starts = place[words.first[:-1] + np.arange(len(words.first) - 1)]
        return out, np.append(starts, len(out))


class Ids:
    """The ids that tasks have written, one file each, mapped and not read."""

    def __init__(self, folder: str) -> None:
        self.folder, self._open = folder, {}

    def __getstate__(self):
        return {"folder": self.folder, "_open": {}}

    def path(self, task: int) -> str:
        return f"{self.folder}/ids-{task:06d}.bin"

    def get(self, task: int, width: int, at: int, n: int) -> np.ndarray:
        """n ids from the at-th on, 32 bits each."""
        if task not in self._open:
            self._open = {task: np.memmap(self.path(task), "<u2" if width == 2 else "<u4", "r")}
        return self._open[task][at : at + n].astype("<u4")


#: What a piece carries from pass to pass: its document, the document's ids, and where they are.
CARRIED = ["doc_id", "n", "task", "at", "width"]


def ordinal_within(groups: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each entry, how many of its group came before; seen counts them on."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(groups) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(groups)))
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(groups)) - np.repeat(begin, size) + seen[ordered]
    seen[ordered[begin]] += size
    return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int, units: int) -> tuple[DataFrame, Ids]:
    """Rows of CARRIED with full (windows of the task's rows before), units and rank (of the tail, among the task's of as many units); the ids in files."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    files = Ids(mapped_dir(docs.sparkSession, "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        narrow = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        temporary = f"{files.path(task)}.{uuid.uuid4().hex}"
        before = full = 0
        seen = np.zeros(units, np.int64)
        with open(temporary, "wb") as f:
            for batch in slices(batches):
                ids, at = encode(batch.column("text"), end_id)
                f.write(ids.astype(narrow).data)
                n, rows = np.diff(at), batch.num_rows
                whole = n // window
                unit = n % window * units // window
                columns = {"doc_id": batch.column("doc_id"), "n": n, "task": np.full(rows, task, np.int32), "at": before + at[:-1], "width": np.full(rows, np.dtype(narrow).itemsize, np.int32), "full": full + np.cumsum(whole) - whole, "units": unit.astype(np.int32), "rank": ordinal_within(unit, seen)}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
                before, full = before + len(ids), full + int(whole.sum())
        os.replace(temporary, files.path(task))
        trim()

    schema = f"doc_id {kind}, n long, task int, at long, width int, full long, units int, rank long"
    # the places are of one run of the pass, so it is written before anything else reads it
    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "tokens"), files


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Ascending lengths, at most depth of them, that add up to units; none is units itself."""
    out, open_ = [], [((), units)]
    while open_:
        have, left = open_.pop()
        low = have[-1] if have else 1
        if have and low <= left:
            out.append((*have, left))
        if len(have) < depth - 2:
            open_ += [((*have, x), left - x) for x in range(low, left // 2 + 1)]
        elif not have or len(have) == depth - 2:
            out += [(*have, x, left - x) for x in range(low, left // 2 + 1)] if have or depth == 2 else []
    return sorted({x for x in out if 1 < len(x) <= depth})


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    scale = max(1.0, float(np.abs(b).max()) if len(b) else 1.0)
    for _ in range(rounds or 3 * max(a.shape)):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= 1e-9 * scale:
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if not len(at) or s.min() > 0:
                break
            down = s <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.min(np.where(x[at][down] - s[down] > 0, x[at][down] / (x[at][down] - s[down]), 0.0))
            x[at] += step * (s - x[at])
            active[at[x[at] <= 1e-12 * scale]] = False
            x[~active] = 0
        x[:] = 0
        x[at] = s
    return x


def plan(histogram: dict[int, int], units: int, depth: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, from rank, to rank, first sequence, slot) and the number of sequences."""
    combos = combinations(units, depth)
    b = np.array([histogram.get(k, 0) for k in range(1, units)], dtype=np.float64)
    if not combos or not b.any():
        return [], 0
    a = np.zeros((units - 1, len(combos)))
    for j, combo in enumerate(combos):
        for k in combo:
            a[k - 1, j] += 1
    want = np.rint(nnls(a, b)).astype(np.int64)
    left, rows, sequences = b.astype(np.int64), [], 0
    used = np.zeros(units, dtype=np.int64)
    for j in np.argsort(-want, kind="stable"):
        need = a[:, j].astype(np.int64)
        repeat = int(min(want[j], (left[need > 0] // need[need > 0]).min()))
        if repeat > 0:
            left -= repeat * need
            for slot, k in enumerate(combos[j]):
                rows.append((k, int(used[k]), int(used[k]) + repeat, sequences, slot))
                used[k] += repeat
            sequences += repeat
    return rows, sequences


def greedy(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Rows (length, from rank, to rank, pieces of a sequence, first sequence, offset, ids taken of each) and the number of sequences.

    Pieces that no row has are those of a last sequence that nothing is left to fill.
    Each filling is repeated until a length runs short, so there are about as many rows as lengths, however many pieces.
    """
    left = {k: n for k, n in histogram.items() if n}
    lengths, used, rows, sequences = sorted(left), dict.fromkeys(left, 0), [], 0
    while lengths:
        open_, picks, top = window, [], len(lengths)
        while open_ and (top := bisect_right(lengths, open_, 0, top)):
            top -= 1
            k = lengths[top]
            many = min(open_ // k, left[k])
            picks.append((k, many, window - open_, k))
            open_ -= many * k
        need = {k: n for k, n, _, _ in picks}
        if open_:  # the shortest that is longer, cut
            over = next((k for k in lengths[bisect_left(lengths, open_ + 1) :] if left[k] > need.get(k, 0)), None)
            if over is None:
                break
            picks.append((over, 1, window - open_, open_))
            need[over] = need.get(over, 0) + 1
        repeat = min(left[k] // n for k, n in need.items())
        for k, n, offset, taken in picks:
            rows.append((k, used[k], used[k] + repeat * n, n, sequences, offset, taken))
            used[k] += repeat * n
            left[k] -= repeat * n
        sequences += repeat
        for k in need:
            if not left[k]:
                del lengths[bisect_left(lengths, k)]
    return rows, sequences


class Steps:
    """Rows of a plan, found by length and rank."""

    def __init__(self, rows: list[tuple[int, ...]]) -> None:
        self.rows = np.array(sorted(rows), dtype=np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each (length, rank), and whether there is one."""
        if not len(self.rows):
            return np.zeros(len(length), np.int64), np.zeros(len(length), dtype=bool)
        wide = 1 << 48
        at = np.maximum(np.searchsorted(self.rows[:, 0] * wide + self.rows[:, 1], length * wide + rank, side="right") - 1, 0)
        return at, (self.rows[at, 0] == length) & (self.rows[at, 1] <= rank) & (rank < self.rows[at, 2])


def before(df: DataFrame, by: list[str], part: str, value, name: str) -> DataFrame:
    """by, part, name: what value sums to in the parts before, for each part; one row for each part and group."""
    sums = df.groupBy(*by, part).agg(value.alias("_s"))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, part, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).cast("long").alias(name))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, units: int = 128, depth: int = 3, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, step and, if asked for, ids (32-bit)."""
    if window % units or window & (window - 1):
        raise ValueError("window must be a power of two and a multiple of units")
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens, files = tokenized(docs, tokenizer, end_id, window, units)
    whole = tokens.agg(F.sum(F.expr(f"n div {window}"))).first()[0] or 0
    full = tokens.where(f"n >= {window}").join(before(tokens, [], "task", F.sum(F.expr(f"n div {window}")), "shift"), "task")
    full = full.select(*CARRIED, F.posexplode(F.expr(f"sequence(0L, n div {window} - 1)")).alias("k", "w"), (F.col("full") + F.col("shift")).alias("first"))
    full = full.select(*CARRIED, (F.col("w") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("first") + F.col("w")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit("whole").alias("step"))

    tails = tokens.where(f"n % {window} > 0")
    histogram = {r[0]: r[1] for r in tails.where("units > 0").groupBy("units").count().collect()}  # at most units rows
    rows, planned = plan(histogram, units, depth)
    steps = Steps(rows)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, there = steps.find(batch.column("units").to_numpy().astype(np.int64), batch.column("rank").to_numpy())
            got = steps.rows[at] if len(steps.rows) else np.zeros((batch.num_rows, 5), np.int64)
            sequence = np.where(there, got[:, 3] + batch.column("rank").to_numpy() - got[:, 1], 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CARRIED), pa.array(sequence, mask=~there), pa.array(got[:, 4].astype(np.int32), mask=~there)], [*CARRIED, "seq", "slot"])

    ranked = tails.join(before(tails, ["units"], "task", F.count("*"), "shift"), ["units", "task"]).select(*CARRIED, "units", (F.col("rank") + F.col("shift")).alias("rank"))
    ranked = ranked.mapInArrow(combine, f"doc_id {kind}, n long, task int, at long, width int, seq long, slot int")
    ranked = ranked.select("*", F.expr(f"n - n % {window}").alias("start"), F.expr(f"n % {window}").alias("length"), F.coalesce("seq", -1 - F.pmod(F.xxhash64("task", "at"), F.lit(1 << 40))).alias("_g"))
    together = Window.partitionBy("_g")
    earlier = together.orderBy("slot", "task", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.select("*", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"), F.sum("length").over(together).alias("total"), F.max("slot").over(together).alias("last"))
    placed = placed.withColumn("excess", F.expr(f"CASE WHEN seq IS NULL THEN length WHEN slot = last THEN total - {window} ELSE 0L END")).withColumn("stays", F.col("length") - F.col("excess"))
    piece = F.struct(F.col("start"), F.col("stays").alias("length"), (F.col("seq") + whole).alias("sequence_id"), F.col("offset"))
    end = F.struct((F.col("start") + F.col("stays")).alias("start"), F.col("excess").alias("length"), F.lit(None).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    combined = placed.select(*CARRIED, F.inline(F.array(piece, end))).where("length > 0")
    columns = f"doc_id {kind}, n long, task int, at long, width int, start long, length long, sequence_id long, offset long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            rank = np.zeros(batch.num_rows, np.int64)
            free = batch.column("sequence_id").is_null().to_numpy(zero_copy_only=False)
            rank[free] = ordinal_within(batch.column("length").to_numpy()[free], seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(rank)], [*batch.schema.names, "part", "rank"])

    combined = written(combined.mapInArrow(number, f"{columns}, part int, rank long"), "combined")
    residual = combined.where("sequence_id IS NULL")
    histogram = {r[0]: r[1] for r in residual.groupBy("length").count().collect()}  # at most window rows
    rows, filled = greedy(histogram, window)
    fillings = Steps(rows)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, laid = TaskContext.get().partitionId(), 0
        for batch in batches:
            length, rank, start = (batch.column(c).to_numpy() for c in ("length", "rank", "start"))
            at, there = fillings.find(length, rank)
            got = fillings.rows[at] if len(fillings.rows) else np.zeros((batch.num_rows, 7), np.int64)
            k, each = rank - got[:, 1], np.maximum(got[:, 3], 1)
            taken = np.where(there, got[:, 6], 0)
            rest = np.flatnonzero(taken < length)
            row = np.concatenate((np.flatnonzero(there), rest))
            of_rest = np.arange(len(row)) >= there.sum()
            sizes = np.where(of_rest, (length - taken)[row], taken[row])
            laid_before = np.where(of_rest, np.cumsum(np.where(of_rest, sizes, 0)) - sizes + laid, 0)
            laid += int(sizes[of_rest].sum())
            sequence = (got[:, 4] + k // each + whole + planned)[row]
            offset = (got[:, 5] + k % each * got[:, 0])[row]
            begin = np.where(of_rest, (start + taken)[row], start[row])
            back = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(back) for c in CARRIED), pa.array(begin), pa.array(sizes), pa.array(sequence, mask=of_rest), pa.array(offset), pa.array(np.full(len(row), part, np.int32)), pa.array(laid_before)], [*CARRIED, "start", "length", "sequence_id", "offset", "part", "laid"])

    shifted = residual.join(before(residual, ["length"], "part", F.count("*"), "shift"), ["length", "part"]).select(*CARRIED, "start", "length", (F.col("rank") + F.col("shift")).alias("rank"))
    spread = written(shifted.mapInArrow(fill, f"{columns}, part int, laid long"), "spread")
    rest = spread.where("sequence_id IS NULL")
    total = rest.agg(F.sum("length")).first()[0] or 0
    edges = rest_edges(total, window)
    known = "array(" + ", ".join(f"{x}L" for x in edges) + ")"
    laid = rest.join(before(rest, [], "part", F.sum("length"), "shift"), "part").withColumn("a", F.col("laid") + F.col("shift")).withColumn("to", F.expr("a + length"))
    inner = F.expr(f"filter(transform(sequence(a div {window}, (to - 1) div {window}), x -> x * {window}), x -> x > a AND x <= {edges[0]}L)")
    cuts = F.array_sort(F.array_union(F.array_union(F.array("a"), inner), F.expr(f"filter({known}, x -> x > a AND x < to)")))
    laid = laid.withColumn("cuts", cuts).select(*CARRIED, "start", "to", "a", "cuts", F.posexplode("cuts").alias("k", "p")).withColumn("q", F.coalesce(F.try_element_at("cuts", F.col("k") + 2), F.col("to")))
    ordinal = F.expr(f"size(filter({known}, x -> x <= p)) - 1")
    own = F.when(F.col("p") < edges[0], F.expr(f"p div {window}")).otherwise(F.lit(edges[0] // window) + ordinal)
    offset = F.when(F.col("p") < edges[0], F.expr(f"p % {window}")).otherwise(F.col("p") - F.element_at(F.expr(known), ordinal + 1))
    laid = laid.select(*CARRIED, (F.col("start") + F.col("p") - F.col("a")).alias("start"), (F.col("q") - F.col("p")).alias("length"), (own + whole + planned + filled).alias("sequence_id"), offset.alias("offset"), F.lit("rest").alias("step"))

    final = ["start", "length", "sequence_id", "offset", "step"]
    pieces = full.unionByName(combined.where("sequence_id IS NOT NULL").select(*CARRIED, *final[:-1], F.lit("nnls").alias("step")))
    pieces = pieces.unionByName(spread.where("sequence_id IS NOT NULL").select(*CARRIED, *final[:-1], F.lit("greedy").alias("step"))).unionByName(laid)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], T.StructField("step", T.StringType()), *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for a in range(0, large.num_rows, 256 if keep_ids else large.num_rows):
                batch = large.slice(a, 256) if keep_ids else large
                task, width, at, start, length = (batch.column(c).to_numpy() for c in ("task", "width", "at", "start", "length"))
                own = [files.get(*x) for x in zip(task.tolist(), width.tolist(), (at + start).tolist(), length.tolist(), strict=True)] if keep_ids else None
                crc = [zlib.crc32(x) for x in own] if keep_ids else [zlib.crc32(files.get(*x)) for x in zip(task.tolist(), width.tolist(), (at + start).tolist(), length.tolist(), strict=True)]
                out = [batch.column("doc_id"), batch.column("start"), batch.column("length"), pa.array(crc, pa.int64()), batch.column("n"), batch.column("sequence_id"), batch.column("offset"), pc.cast(batch.column("step"), pa.string())]
                yield pa.RecordBatch.from_arrays(out + ([pa.array([x.tobytes() for x in own], pa.binary())] if keep_ids else []), [f.name for f in schema.fields])

    # each file is mapped by few tasks, from front to back
    return pieces.repartition("task").sortWithinPartitions("task", F.col("at") + F.col("start")).mapInArrow(digest, schema)


def rest_edges(total: int, window: int) -> list[int]:
    """Where the last, partial window begins, and its parts, which are powers of two."""
    edges = [total - total % window]
    for k in reversed(range(window.bit_length() - 1)):
        if total % window >> k & 1:
            edges.append(edges[-1] + (1 << k))
    return edges


def op1(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
