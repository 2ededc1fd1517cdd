"""Pairing of gold and predicted blocks, and what follows from the pairs."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import align_texts, assign, common_lengths, ratio


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def similarity_matrix(a: list[str], b: list[str], known: dict[tuple[str, str], float] | None = None) -> np.ndarray:
    """Similarity of all pairs; equal texts are compared once, and not again if known already."""
    known = {} if known is None else known
    for x in set(a):
        for y in set(b):
            if (x, y) not in known:
                known[x, y] = 1.0 if x == y else ratio(x, y)
    return np.array([[known[x, y] for y in b] for x in a]).reshape(len(a), len(b))


def _bags(texts: list[str]) -> np.ndarray:
    """How often each of 64 classes of characters is in each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4") % 64
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * 64, [len(x) for x in texts])
    return np.bincount(owner + codes, minlength=64 * len(texts)).reshape(len(texts), 64).astype(np.int32)


def _bounds(a: list[str], b: list[str], ours: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most that each pair can be alike, by the characters that both have, and which pairs that settles."""
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(y) for y in b])
    shared = np.array([np.minimum(row, theirs).sum(axis=1) for row in ours])
    return np.where(sizes == 0, 1.0, 2.0 * shared / np.maximum(sizes, 1)), sizes == 0


def _in_place(a: list[str], b: list[str], threshold: float, kinds: tuple[Sequence, Sequence]) -> list[tuple[int, int, float]] | None:
    """The pairs of texts that are the same on both sides: equal ones of one kind keep their order, which is closest to the diagonal, and so do the others that are left."""
    if len(a) != len(b) or sorted(a) != sorted(b):
        return None
    pair, places, free = {}, {}, {}
    for j, y in enumerate(zip(b, kinds[1], strict=True)):
        places.setdefault(y, deque()).append(j)
    for i, x in enumerate(zip(a, kinds[0], strict=True)):
        if places.get(x):
            pair[i] = places[x].popleft()
    for j in sorted(j for left in places.values() for j in left):
        free.setdefault(b[j], deque()).append(j)
    return [(i, pair[i] if i in pair else free[x].popleft(), 1.0) for i, x in enumerate(a) if threshold <= 1.0]


#: What a pair of one kind is worth beyond its similarity: more than closeness to the diagonal, too little to change the total's order.
_OF_A_KIND = 1e-8


def _alike(pairs: list[tuple[str, str]]) -> list[float]:
    return [2.0 * n / (len(x) + len(y)) if x or y else 1.0 for n, (x, y) in zip(common_lengths(pairs), pairs, strict=True)]


def pair_pages(pages: Sequence[tuple[list[str], list[str]]], threshold: float = 0.0, kinds: Sequence[tuple[Sequence, Sequence]] | None = None) -> list[list[tuple[int, int, float]]]:
    """For each page (texts of either side) i, j, similarity of the one-to-one pairs of greatest total similarity that are at least `threshold` alike.

    The characters that two texts share bound their similarity from above. The pairs are chosen by bounds, those chosen are
    compared, and so on until all chosen have been: no other choice can then be better. Pages take each step together, as texts of
    many pairs are compared at once. Of choices with the same total the one with the most pairs of one kind counts, if kinds (of the
    texts of either side of each page) are given, and then the one closest to the diagonal.
    """
    out: list = [None] * len(pages)
    alike = [None if kinds is None else np.asarray(kinds[k][0], dtype=object)[:, None] == np.asarray(kinds[k][1], dtype=object) for k in range(len(pages))]
    open_ = []
    for k, (a, b) in enumerate(pages):
        out[k] = [] if not a or not b else _in_place(a, b, threshold, kinds[k] if kinds else ([0] * len(a), [0] * len(b)))
        if out[k] is None:
            open_.append(k)
    bags = _bags([x for k in open_ for side in pages[k] for x in side])
    score, exact, known, at = {}, {}, {}, 0
    for k in open_:
        a, b = pages[k]
        mid, end = at + len(a), at + len(a) + len(b)
        (score[k], exact[k]), at = _bounds(a, b, bags[at:mid], bags[mid:end]), end

    def compare(wanted: list[tuple[int, int, int]]) -> None:
        texts = {(pages[k][0][i], pages[k][1][j]): None for k, i, j in wanted}
        fresh = [x for x in texts if x not in known]
        known.update(zip(fresh, _alike(fresh), strict=True))
        for k, i, j in wanted:
            score[k][i, j], exact[k][i, j] = known[pages[k][0][i], pages[k][1][j]], True

    best = {k: score[k].argmax(axis=1) for k in open_}
    compare([(k, i, int(j)) for k in open_ for i, j in enumerate(best[k])])
    for turn in range(25):
        wanted, left = [], []
        for k in open_:
            s = score[k]
            if turn == 0 and s.shape[0] <= s.shape[1]:  # each text's own best, if no two want the same and nothing else can reach it
                top = s[np.arange(len(s)), best[k]]
                if len(set(best[k].tolist())) == len(s) and ((s >= top[:, None]).sum(axis=1) == 1).all():
                    out[k] = [(i, int(j), float(x)) for i, (j, x) in enumerate(zip(best[k], top, strict=True)) if x >= threshold]
                    continue
            pairs = assign(s if alike[k] is None else s + _OF_A_KIND * alike[k])
            more = [(k, i, j) for i, j in pairs if not exact[k][i, j]]
            if not more:
                out[k] = [(i, j, float(s[i, j])) for i, j in pairs if s[i, j] >= threshold]
                continue
            left.append(k)
            wanted += more if turn < 23 else [(k, int(i), int(j)) for i, j in zip(*np.nonzero(~exact[k]), strict=True)]
        open_ = left
        if not open_:
            break
        compare(wanted)
    return out


def pair_texts(a: list[str], b: list[str], threshold: float = 0.0) -> list[tuple[int, int, float]]:
    """`pair_pages` of one page."""
    return pair_pages([(a, b)], threshold)[0]


#: So many characters of pages are paired together.
_TOGETHER = 2_000_000


def assign_pages(pages: DataFrame, keys: Sequence[str], threshold: float = 0.55, normalize: Callable[[str], str] | None = None) -> DataFrame:
    """keys, gold_ix, pred_ix, sim of pages that are a row each: keys, g_ix, g, p_ix, p (places and normalised texts, or what normalize makes them from)."""

    def paired(keep: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
        rows = [(*key, gi[i], pi[j], sim) for (key, gi, _, pi, _), found in zip(keep, pair_pages([(g, p) for _, _, g, _, p in keep], threshold), strict=True) for i, j, sim in found]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[] for _ in kinds], kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = (lambda texts: [normalize(x) for x in texts]) if normalize else list
        keep, size = [], 0
        for batch in batches:
            kinds = pa.schema([*(batch.schema.field(k) for k in keys), ("gold_ix", pa.int64()), ("pred_ix", pa.int64()), ("sim", pa.float64())])
            for key, gi, g, pi, p in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), *(batch.column(c).to_pylist() for c in ("g_ix", "g", "p_ix", "p")), strict=True):
                keep.append((key, gi, clean(g or []), pi, clean(p or [])))
                size += sum(map(len, keep[-1][2]))
                if size > _TOGETHER:
                    yield paired(keep, kinds)
                    keep, size = [], 0
        if keep:
            yield paired(keep, kinds)

    return pages.select(*keys, "g_ix", "g", "p_ix", "p").mapInArrow(run, f"{_kinds(pages, keys)}, gold_ix long, pred_ix long, sim double")


def assign_blocks(gold: DataFrame, pred: DataFrame, keys: Sequence[str], threshold: float = 0.55, normalize: Callable[[str], str] | None = None) -> DataFrame:
    """keys, gold_ix, pred_ix, sim of the optimal one-to-one pairs at least `threshold` alike.

    gold and pred carry keys, ix and norm (the normalised text, or what normalize makes it from). The threshold
    applies after the optimum, so pairs below it take part in it. A group is a page.
    """
    own = lambda df, x: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("ix").cast("long").alias("ix"), "norm"))).alias(x)).select(*keys, F.col(f"{x}.ix").alias(f"{x}_ix"), F.col(f"{x}.norm").alias(x))
    return assign_pages(own(gold, "g").join(own(pred, "p"), [*keys]), keys, threshold, normalize)


def align_lines(gold: DataFrame, pred: DataFrame, keys: Sequence[str], least: float = 0.35) -> DataFrame:
    """keys, gold_ix, pred_ix: order-keeping alignment of two sequences of texts."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("ix"), b.sort_values("ix")
        rows = [[*key, a.ix.iloc[i], b.ix.iloc[j]] for i, j in align_texts(a.norm.tolist(), b.norm.tolist(), lambda x, y: 1.0 if x == y else ratio(x, y), least)]
        return pd.DataFrame(rows, columns=[*keys, "gold_ix", "pred_ix"])

    sides = [x.select(*keys, "ix", "norm").groupBy(*keys) for x in (gold, pred)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, f"{_kinds(gold, keys)}, gold_ix long, pred_ix long")


def pair_textless(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, gold_ix, pred_ix: the k-th block without text of a coarse type with the k-th of the other side."""
    order = Window.partitionBy(*keys, "kind").orderBy("ix")
    g = gold.withColumn("k", F.row_number().over(order)).select(*keys, "kind", "k", F.col("ix").alias("gold_ix"))
    p = pred.withColumn("k", F.row_number().over(order)).select(*keys, "kind", "k", F.col("ix").alias("pred_ix"))
    return g.join(p, [*keys, "kind", "k"]).select(*keys, "gold_ix", "pred_ix")


@F.pandas_udf(T.DoubleType())
def tau_of(places: pd.Series) -> pd.Series:
    """Kendall's tau of each list with its own order, scaled to 0..1; 1 for fewer than two entries."""

    def one(p: Sequence[int]) -> float:
        n, total, seen = len(p), 0, []
        for y in p:  # those before that are smaller, less those that are larger
            low, high = bisect_left(seen, y), bisect_right(seen, y)
            total += low - (len(seen) - high)
            seen.insert(high, y)
        return 1.0 if n < 2 else (total / (n * (n - 1) / 2) + 1) / 2

    return places.map(lambda p: 1.0 if p is None else one(p))


def reading_order_tau(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, tau: Kendall's tau of the paired indices, scaled to 0..1; 1 for fewer than two pairs."""
    rows = pairs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("gold_ix", "pred_ix"))), lambda x: x["pred_ix"]).alias("p"))
    return rows.select(*keys, tau_of("p").alias("tau"))
