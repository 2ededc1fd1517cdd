"""SimHash near-duplicates by a range join on segment bit counts.

A document's fingerprint has 64 bits; bit b is 1 if over half of the XXH64
hashes of its word shingles (repeats included) have bit b. Two fingerprints link
at `max_bits` or fewer differing bits; a group is a connected component.

The join. Each fingerprint is split into segments of two bits, and embedded as
the vector of their bit counts. The Manhattan distance of two such vectors never
exceeds the number of differing bits. The 32 counts lie in two halves; if the
whole distance is at most max_bits, one half's is at most max_bits // 2 = r.
Each fingerprint is put into every grid cell (a vector of counts of one half)
within distance r // 2 rounded up of its own, so two that lie within r of each other
meet in a cell between them. Pairs that meet are verified on all 64 bits.
Only distinct fingerprints take part, so copies cost nothing; a task keeps a
spanning star of the links it finds, not the pairs. Cells are compared tile by
tile, without a cap. Components come from alternating large-star and small-star
rounds of DataFrame joins, each written to the shared folder.

Nulls: a null text has no words (fingerprint zero, like any other without
words); a null doc_id links like others and counts as larger than any other, so
component_id is null only where all reachable doc_ids are null. Rows that repeat
a doc_id stay rows of their own. An empty table gives an empty result. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_edges, pack, parts, release, table, unpack, written
from .words import SPACED, Words, mix, slices

_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_P4, _P5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    out = x << np.uint64(r)
    out |= x >> np.uint64(64 - r)
    return out


def xxh64(data: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:end] for many spans at once."""
    raw = np.frombuffer(data + bytes(16), dtype=np.uint8)
    at8 = np.ndarray(shape=(len(data) + 8,), dtype="<u8", buffer=raw, strides=(1,))
    at4 = np.ndarray(shape=(len(data) + 8,), dtype="<u4", buffer=raw, strides=(1,))
    s = np.uint64(seed)
    length = (end - start).astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(start), s + _P5, dtype=np.uint64)
        p = start.astype(np.int64).copy()
        long = np.flatnonzero(length >= 32)
        if len(long):
            lanes = [np.full(len(long), x, dtype=np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            q, stripes, done = p[long], length[long] // 32, 0
            live = np.arange(len(long))
            while len(live):
                for k, lane in enumerate(lanes):
                    lane[live] = _rotl(lane[live] + at8[q[live] + (done * 32 + 8 * k)] * _P2, 31) * _P1
                done += 1
                live = live[stripes[live] > done]
            g = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                g ^= _rotl(lane * _P2, 31) * _P1
                g = g * _P1 + _P4
            h[long] = g
            p[long] += stripes * 32
        h += length.astype(np.uint64)
        rest = length & 31
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * (k + 1))
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ (_rotl(at8[p[i]] * _P2, 31) * _P1), 27) * _P1 + _P4
            p[i] += 8
        i = np.flatnonzero(rest & 4)
        h[i] = _rotl(h[i] ^ (at4[p[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        p[i] += 4
        for k in range(3):
            i = np.flatnonzero((rest & 3) > k)
            h[i] = _rotl(h[i] ^ (raw[p[i]].astype(np.uint64) * _P5), 11) * _P1
            p[i] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


#: For each byte, its eight bits in the eight bytes of a word, the highest bit first in memory.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").reshape(256)


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run h[first[i]:first[i + 1]], the bits set in over half of it; 0 for an empty run."""
    out = np.zeros(len(first) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    size = np.diff(first)[full]
    # sums of at most 255 rows fit the bytes of a word; then sums of those in 32 bits
    chunks = -(-size // 255)
    begin = np.concatenate(([0], np.cumsum(chunks)[:-1]))
    at = np.repeat(first[:-1][full], chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(begin, chunks))
    planes = h.byteswap().view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(at), 64), dtype=np.uint8)
    for k in range(8):
        counts[:, 8 * k : 8 * k + 8] = np.add.reduceat(_SPREAD[planes[:, k]], at).view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts, begin, axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > size[:, None], axis=1)
    out[full] = bits.reshape(-1).view(">u8")
    return out


def fingerprints_of(texts: pa.Array, shingle_words: int) -> np.ndarray:
    words = Words(texts, SPACED, lower=True)
    joined, start, end = words.joined()
    count = words.counts
    shingles = np.where(count >= shingle_words, count - shingle_words + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(shingles)))
    begin = np.repeat(words.first[:-1] - first[:-1], shingles) + np.arange(first[-1])
    last = begin + np.repeat(np.minimum(count, shingle_words), shingles) - 1
    return majority(xxh64(joined, start[begin], end[last], 42), first)


def fingerprints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprints_of(batch.column("text"), shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


_PAIRS = np.uint64(0x5555555555555555)


def cells_of(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid cells that each fingerprint is put in, and which fingerprint each is of.

    A cell is a half's 16 counts, two bits each, with the half's number above.
    """
    counts = fp - ((fp >> np.uint64(1)) & _PAIRS)
    cells, owner = [], []
    everyone = np.arange(len(fp))
    for half in range(2):
        ring = {0: [(counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), everyone]}
        for r in range(radius):
            more, who = [], []
            base, of = ring[r]
            for k in range(16):
                value = (base >> np.uint64(2 * k)) & np.uint64(3)
                one = np.uint64(1 << (2 * k))
                for ok, moved in ((value < 2, base + one), (value > 0, base - one)):
                    more.append(moved[ok])
                    who.append(of[ok])
            ring[r + 1] = [np.concatenate(more), np.concatenate(who)]
            if r:  # from the second ring on a cell is reached in several ways
                both = np.unique(np.stack([ring[r + 1][0], ring[r + 1][1].astype(np.uint64)]), axis=1)
                ring[r + 1] = [both[0], both[1].astype(np.int64)]
        for base, of in ring.values():
            cells.append(base | np.uint64(half << 32))
            owner.append(of)
    return np.concatenate(cells), np.concatenate(owner)


class Links:
    """Which of n nodes hang together: labels that only links between different labels change."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            low, high = np.minimum(x, y), np.maximum(x, y)
            to = np.arange(len(self.label))
            np.minimum.at(to, high, low)
            while True:
                jumped = to[to]
                if np.array_equal(jumped, to):
                    break
                to = jumped
            self.label = to[self.label]


def cell_links(cell: np.ndarray, fp: np.ndarray, max_bits: int, tile: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (member, smallest) of the fingerprints that share a cell and differ in few bits."""
    order = np.lexsort((fp, cell))
    cell, fp = cell[order], fp[order]
    keep = np.ones(len(cell), dtype=bool)
    keep[1:] = (cell[1:] != cell[:-1]) | (fp[1:] != fp[:-1])
    cell, fp = cell[keep], fp[keep]
    nodes, index = np.unique(fp, return_inverse=True)
    links = Links(len(nodes))
    begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(cell)))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.flatnonzero((size > 1) & (size <= 64))
    small = np.zeros(len(cell), dtype=bool)
    room = np.repeat(np.append(begin[1:], len(cell)), size)
    small[:] = np.repeat(np.isin(np.arange(len(size)), live), size)
    i = np.flatnonzero(small)
    for d in range(1, 64):
        i = i[i + d < room[i]]
        if not len(i):
            break
        hit = np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits
        pairs.append((index[i[hit]], index[i[hit] + d]))
    if pairs:
        links.add(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
    for k in np.flatnonzero(size > 64):
        a, z = begin[k], begin[k] + size[k]
        for top in range(a, z, tile):
            for left in range(top, z, tile):
                x, y = fp[top : min(top + tile, z)], fp[left : min(left + tile, z)]
                p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= max_bits)
                links.add(index[top + p], index[left + q])
    moved = np.flatnonzero(links.label != np.arange(len(nodes)))
    return nodes[moved], nodes[links.label[moved]]


def links(nodes: DataFrame, count: int, max_bits: int) -> DataFrame:
    """a, b: links that connect whatever the range join finds linked (fp long in both)."""
    radius = -(-(max_bits // 2) // 2)
    spread = 2 * (1 + 32 * radius**2)
    buckets = parts(count * spread, 3_000_000, 8)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16384):
                fp = batch.column("fp").slice(at, 16384).to_numpy().view(np.uint64)
                cell, owner = cells_of(fp, radius)
                key = mix(cell.copy())
                order = np.argsort(key)
                key, cell, owner = key[order], cell[order], owner[order]
                edge = bucket_edges(key, buckets)
                full = np.flatnonzero(np.diff(edge))
                blobs = [pack(cell[edge[b] : edge[b + 1]], fp[owner[edge[b] : edge[b + 1]]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def meet(group: pa.Table) -> pa.Table:
        both = [unpack(x, "u8", "u8") for x in group.column("blob").to_pylist()]
        a, b = cell_links(np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]), max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return nodes.select("fp").mapInArrow(put, "bucket long, blob binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of an edge (a, b: long), the smallest node that it hangs together with.

    Alternating large-star and small-star rounds until no edge changes; every
    round is two shuffles over what is left of the edges, with map-side minima.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id of the documents that each hangs together with."""
    if not 1 <= max_bits <= 5:
        raise ValueError("max_bits must be 1 to 5: the halves' grids are built for at most two steps")
    prints = written(fingerprints(docs, shingle_words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    edges = written(links(nodes, nodes.count(), max_bits), "links")
    release(docs.sparkSession)
    roots = written(components(edges), "roots")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", "root")
    lowest = placed.where("root IS NOT NULL").select("root", "low").union(nodes.join(roots.select("root").distinct(), F.col("fp") == F.col("root"), "left_semi").select(F.col("fp").alias("root"), "low"))
    lowest = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    own = placed.withColumn("root", F.coalesce("root", "fp")).join(lowest, "root", "left")
    own = own.select(F.col("fp").alias("own_fp"), F.coalesce("component_id", "low").alias("component_id"))
    return prints.join(own, F.col("fp") == F.col("own_fp")).select("doc_id", "fp", "component_id")


def op10(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
