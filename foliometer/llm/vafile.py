"""Exact top-k search by inner product with vector-approximation files.

Vectors become integers, floor(scale * x) of each component. Blocks of vectors are
written to the shared folder as two files: the cells (each component quantised to
2 ** bits steps of its range in the block, one byte each) and the exact vectors. A
query block scans a block's cells first: with the middle m and half width r of a
cell, q.m - |q|.r <= q.v <= q.m + |q|.r. A query keeps the vectors whose upper bound
reaches its k-th best so far and its k-th best lower bound in the block, and reads exact
vectors (mapped, in the order of their bounds) until the k-th result is at least
the next bound. So nothing is missed, and no pair of vectors becomes a row.

Blocks are known by the task that wrote them and a number. A step is one block of queries with
a share of the vector blocks; steps are a range of numbers, so no table of blocks is joined or
gathered. The driver holds one count for each task. A final window takes k of each query's k
best per share.

Ties go to the smaller id. Vectors that are null or hold null or non-finite
components take no part, nor do empty ones; vectors of different lengths are not
compared. Rows that repeat an id are rows of their own; a query's own rows are all those with its
id, so they are no candidates for it, and repeated query rows each give their results.
Null ids are no queries, and as candidates rank after all others. Components
beyond 2 ** 53 are cut there, scores to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import mapped, mapped_dir, parts, save, table

_MOST = float(1 << 53)
_NULL = np.iinfo(np.int64).max


def _matrix(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, is a query, integer vectors as doubles) of the valid rows, for each length of vector."""
    lists = batch.column("embedding")
    ids = batch.column("vec_id").cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False)
    ask = batch.column("ask").fill_null(False).to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        x = values[begin[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1)
        x = np.clip(np.floor(scale * x[good]), -_MOST, _MOST)
        yield ids[rows[good]], ask[rows[good]], x


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of v's rows with q; by Python's integers where 64 bits might not do."""
    if not len(v) or float(np.abs(v).max()) * float(np.abs(q).sum()) < 2.0**62:
        return v.astype(np.int64) @ q.astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in v]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in whole], dtype=np.int64)


class Block:
    """One block of a vector-approximation file."""

    def __init__(self, path: str) -> None:
        self.ids, self.cells, self.exact = (mapped(f"{path}-{n}.npy") for n in ("ids", "cells", "exact"))
        self.low, self.width = np.load(f"{path}-grid.npy")

    @staticmethod
    def write(path: str, ids: np.ndarray, x: np.ndarray, bits: int) -> None:
        low = x.min(axis=0)
        width = np.maximum(np.ceil((x.max(axis=0) - low + 1) / (1 << bits)), 1.0)
        cells = np.minimum((x - low) // width, (1 << bits) - 1).astype(np.uint8)
        small = np.abs(x).max() < 1 << 31
        for name, array in (("ids", ids), ("cells", cells), ("exact", x.astype(np.int32) if small else x), ("grid", np.stack([low, width]))):
            save(f"{path}-{name}.npy", array)

    def bounds(self, q: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Middle of each query's and vector's score range, and half its width for each query."""
        half = (self.width - 1) / 2
        middle = q @ (self.low + half)[:, None] + (q * self.width) @ self.cells[rows].T.astype(np.float64)
        reach = np.abs(q) @ half
        slack = 1e-12 * (np.abs(q) @ (np.abs(self.low) + 256 * self.width)) + 1e-6  # rounding of the sums
        return middle, reach + slack


class Best:
    """The k best of each of some queries: scores descending, then ids ascending."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def kth(self, i: int) -> float:
        return float(self.score[i][-1]) if len(self.score[i]) == self.k else -np.inf

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate((self.score[i], score)), np.concatenate((self.id[i], ids))
        order = np.lexsort((ids, -score.astype(object) if len(score) and score.min() == np.iinfo(np.int64).min else -score))[: self.k]
        self.score[i], self.id[i] = score[order], ids[order]


def search_block(best: Best, ids: np.ndarray, q: np.ndarray, block: Block, step: int = 8192) -> None:
    k = best.k
    for at in range(0, len(block.ids), step):
        rows = slice(at, at + step)
        own_ids = np.asarray(block.ids[rows])
        middle, reach = block.bounds(q, rows)
        n = middle.shape[1]
        nth = np.partition(middle, n - k - 1, axis=1)[:, n - k - 1] if n > k else np.full(len(q), -np.inf)  # one more, as the query's own row may be among them
        copies = len(own_ids) != len(np.unique(own_ids))
        for i in range(len(q)):
            floor = best.kth(i) if copies else max(best.kth(i), nth[i] - reach[i])
            near = np.flatnonzero(middle[i] + reach[i] >= floor)
            near = near[own_ids[near] != ids[i]]
            near = near[np.argsort(-middle[i][near], kind="stable")]
            size = max(64, 2 * k)
            for a in range(0, len(near), size):
                if middle[i][near[a]] + reach[i] < best.kth(i):
                    break
                take = near[a : a + size]
                best.add(i, _exact(q[i], np.asarray(block.exact[at + np.sort(take)])), own_ids[np.sort(take)])


def top_k(vectors: DataFrame, ask: Column, k: int = 20, scale: float = 64.0, bits: int = 5, block_rows: int = 16384, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding) that ask holds for, its k best others."""
    spark = vectors.sparkSession
    folder = mapped_dir(spark, "vectors")

    def path_of(size: int, query: bool, task: int, number: int) -> str:
        return f"{folder}/{'query' if query else 'block'}-{size}-{task}-{number}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()  # a task that runs again writes the same files
        held: dict[tuple[int, bool], list] = {}
        numbers: dict[tuple[int, bool], int] = {}

        def flush(key: tuple[int, bool], most: int) -> None:
            ids, x = (np.concatenate(c) for c in zip(*held[key], strict=True))
            while len(ids) > most or (len(ids) and most == 0):
                size = (query_rows if key[1] else block_rows) if most else len(ids)
                Block.write(path_of(*key, task, numbers.get(key, 0)), ids[:size], x[:size], bits)
                numbers[key] = numbers.get(key, 0) + 1
                ids, x = ids[size:], x[size:]
            held[key] = [(ids, x)]

        for batch in batches:
            for ids, asks, x in _matrix(batch, scale):
                for query, chosen in ((False, np.ones(len(ids), dtype=bool)), (True, asks & (ids != _NULL))):
                    if chosen.any():
                        key = (x.shape[1], query)
                        held.setdefault(key, []).append((ids[chosen], x[chosen]))
                        most = query_rows if query else block_rows
                        if sum(len(c[0]) for c in held[key]) > most:
                            flush(key, most)
        for key in list(held):
            flush(key, 0)
        rows = [(*key, task, n) for key, n in numbers.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int32(), pa.int64()), strict=True)], ["size", "asks", "task", "blocks"])

    source = vectors.select("vec_id", "embedding", ask.alias("ask"))
    # one row for each task and length of vectors: how many blocks it has written
    written_by = sorted(source.mapInArrow(build, "size int, asks boolean, task int, blocks long").collect())
    tables = {key: (np.array([r["task"] for r in rows]), np.cumsum([0] + [r["blocks"] for r in rows])) for key, rows in ((k, [r for r in written_by if (r["size"], r["asks"]) == k]) for k in sorted({(r["size"], r["asks"]) for r in written_by}))}

    def nth(size: int, query: bool, k: int) -> str:
        """The k-th of all blocks of one kind."""
        tasks, upto = tables[size, query]
        at = int(np.searchsorted(upto, k, side="right")) - 1
        return path_of(size, query, int(tasks[at]), int(k - upto[at]))

    # each step is one query block with a share of the vector blocks; steps are numbers, and what they stand for is worked out in the task
    sizes, shares, first = [], [], [0]
    for size in sorted({k[0] for k in tables if k[1]}):
        n_asks, n_blocks = int(tables[size, True][1][-1]), int(tables[size, False][1][-1])
        sizes.append(size)
        shares.append(parts(n_blocks, 64) if n_asks >= 64 else min(n_blocks, parts(64, n_asks)))
        first.append(first[-1] + n_asks * shares[-1])
    steps = spark.range(0, first[-1], 1, parts(first[-1], 4, min(8, max(first[-1], 1))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in batch.column("id").to_pylist():
                kind = int(np.searchsorted(first, step, side="right")) - 1
                size, (query, share) = sizes[kind], divmod(step - first[kind], shares[kind])
                own = Block(nth(size, True, query))
                ids, q = np.asarray(own.ids), np.asarray(own.exact).astype(np.float64)
                best = Best(len(ids), k)
                for block in range(share, int(tables[size, False][1][-1]), shares[kind]):
                    search_block(best, ids, q, Block(nth(size, False, block)))
                found = [len(x) for x in best.id]
                row = np.repeat(np.arange(len(ids)), found)
                yield pa.RecordBatch.from_arrays([pa.array([f"{size}-{query}"] * len(row), pa.string()), pa.array(row, pa.int32()), pa.array(ids[row]), pa.array(np.concatenate(best.id)), pa.array(np.concatenate(best.score))], ["query", "row", "query_id", "vec_id", "score"])

    found = steps.mapInArrow(scan, "query string, row int, query_id long, vec_id long, score long")
    order = Window.partitionBy("query", "row").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.nullif("vec_id", F.lit(int(_NULL))).alias("vec_id"), "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
