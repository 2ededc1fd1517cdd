"""Groups of documents that share most of their word shingles, and one row of each group.

Two documents link where the Jaccard similarity of their sets of word shingles is
`similarity` or more, by comparison of the whole sets; a group is a connected component.
Pairs to compare come from two sources: SimHash fingerprints of at most `max_bits`
differing bits (the range join of `simhash`), and bands of MinHash values. A band holds
ROWS values; there are as many as it takes to nominate a pair of just that similarity
with probability `sure`, so pairs above it are missed less often still.

A pass over the texts writes each set, sorted, into a file of its task in the shared
folder, 48 bits of XXH64 for each shingle. Only distinct sets take part from there on.
What is shuffled are keys and places in those files; a task that compares two sets
maps them. Members of a key that hang together already are not compared again, so a
large group of near copies costs a comparison for each member, not for each pair.

Documents without words have the same (empty) set. Components as in `simhash`.
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_edges, mapped_dir, pack, parts, release, trim, unpack, written
from .simhash import cells_of, components, majority, xxh64
from .words import BASE, SPACED, Words, mix, slices

ROWS = 5
#: A place is a file's number and the byte where a set's record begins in it.
_FILE = 40
_BAND = np.uint64(1 << 63)


def bands_for(similarity: float, sure: float) -> int:
    return max(1, math.ceil(math.log(1 - sure) / math.log(1 - similarity**ROWS))) if similarity < 1 else 1


def shingle_sets(texts: pa.Array, shingle_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint of each text; sorted distinct shingle hashes (48 high bits) of all texts, and where each text's begin."""
    words = Words(texts, SPACED, lower=True)
    joined, start, end = words.joined()
    count = words.counts
    shingles = np.where(count >= shingle_words, count - shingle_words + 1, np.minimum(count, 1))
    first = np.concatenate(([0], np.cumsum(shingles)))
    begin = np.repeat(words.first[:-1] - first[:-1], shingles) + np.arange(first[-1])
    last = begin + np.repeat(np.minimum(count, shingle_words), shingles) - 1
    h = xxh64(joined, start[begin], end[last], 42)
    fp = majority(h, first)
    h &= ~np.uint64(0xFFFF)
    owner = np.repeat(np.arange(len(count)), shingles)
    order = np.lexsort((h, owner))
    h = h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return fp, h[keep], np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(count)))))


def _sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set h[first[i]:first[i + 1]]; 0 for an empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h.copy()), dtype=np.uint64)))
    return mix(total[first[1:]] - total[first[:-1]])


class Sets:
    """The sets that tasks have written: a length of 4 bytes, then 6 bytes for each shingle."""

    def __init__(self, folder: str) -> None:
        self.folder, self._open = folder, {}

    def __getstate__(self):
        return {"folder": self.folder, "_open": {}}

    def path(self, number: int) -> str:
        return f"{self.folder}/sets-{number:06d}.bin"

    def _at(self, place: int) -> tuple[np.ndarray, int]:
        number = place >> _FILE
        if number not in self._open:
            if len(self._open) > 512:
                self._open.clear()
            self._open[number] = np.memmap(self.path(number), np.uint8, "r")
        return self._open[number], place & ((1 << _FILE) - 1)

    def size(self, place: int) -> int:
        raw, at = self._at(place)
        return int.from_bytes(raw[at : at + 4].tobytes(), "little")

    def get(self, place: int) -> np.ndarray:
        raw, at = self._at(place)
        n = int.from_bytes(raw[at : at + 4].tobytes(), "little")
        out = np.zeros((n, 8), dtype=np.uint8)
        out[:, 2:] = raw[at + 4 : at + 4 + 6 * n].reshape(n, 6)
        return out.view("<u8").reshape(n)


def band_keys(h: np.ndarray, first: np.ndarray, bands: int) -> np.ndarray:
    """(band, set): a key of the band's MinHash values, for sets that are not empty."""
    keys = np.empty((bands, len(first) - 1), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(first) - 1, b + 1, dtype=np.uint64)
        for r in range(ROWS):
            p = h * (mix(np.array([b * ROWS + r + 1], dtype=np.uint64))[0] | np.uint64(1))
            p ^= p >> np.uint64(29)
            key = mix(key * BASE + np.minimum.reduceat(p, first[:-1]))
        keys[b] = key | _BAND
    return keys


class Union:
    """Which places hang together."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def add(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class Verified:
    """Whether two sets are similar, by the whole sets."""

    def __init__(self, sets: Sets, similarity: float) -> None:
        self.sets, self.similarity = sets, similarity
        self.held: dict[int, np.ndarray] = {}  # sets read last, so many bytes of them
        self.bytes = 0
        self.apart: set[tuple[int, int]] = set()  # pairs found not to be similar, for they may share further keys

    def get(self, place: int) -> np.ndarray:
        if place not in self.held:
            if self.bytes > 16 << 20:
                self.held, self.bytes = {}, 0
            self.held[place] = self.sets.get(place)
            self.bytes += self.held[place].nbytes
        return self.held[place]

    def __call__(self, a: int, b: int) -> bool:
        if (a, b) in self.apart:
            return False
        m, n = self.sets.size(a), self.sets.size(b)
        if min(m, n) >= self.similarity * max(m, n) - 1e-9:
            both = len(np.intersect1d(self.get(a), self.get(b), assume_unique=True))
            if both >= self.similarity * (m + n - both) - 1e-9:
                return True
        if len(self.apart) > 200_000:
            self.apart.clear()
        self.apart.add((a, b))
        return False


def key_links(key: np.ndarray, fp: np.ndarray, place: np.ndarray, max_bits: int, similar, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (member, smallest) of the places that share a key and are similar; under a SimHash cell only those of few differing bits are compared."""
    order = np.lexsort((place, key))
    key, fp, place = key[order], fp[order], place[order]
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    key, fp, place = key[keep], fp[keep], place[keep]
    union = Union()
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    banded = key >= _BAND
    for k in np.flatnonzero(size > few):
        at, f, any_bits = place[begin[k] : begin[k] + size[k]], fp[begin[k] : begin[k] + size[k]], banded[begin[k]]
        root = np.array([union.find(x) for x in at.tolist()], dtype=np.uint64)
        for i in range(len(at) - 1):
            if (root[i + 1 :] == root[i]).all() and (root[: i + 1] == root[i]).all():
                break
            other = root[i + 1 :] != root[i]
            if not any_bits:
                other &= np.bitwise_count(f[i + 1 :] ^ f[i]) <= max_bits
            for j in (np.flatnonzero(other) + i + 1).tolist():
                if root[j] != root[i] and similar(int(at[i]), int(at[j])):
                    union.add(int(at[i]), int(at[j]))
                    root[root == root[j]] = root[i]
    i = np.flatnonzero(np.repeat((size > 1) & (size <= few), size))
    room = np.repeat(np.append(begin[1:], len(key)), size)
    pairs = []
    for d in range(1, few):
        i = i[i + d < room[i]]
        if not len(i):
            break
        hit = banded[i] | (np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits)
        pairs.append(np.stack([place[i[hit]], place[i[hit] + d]], axis=1))
    for a, b in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
        if union.find(a) != union.find(b) and similar(a, b):
            union.add(a, b)
    moved = [(x, union.find(x)) for x in list(union.up)]
    moved = np.array([m for m in moved if m[0] != m[1]], dtype=np.uint64).reshape(-1, 2)
    return moved[:, 0], moved[:, 1]


def one_of_each(docs: DataFrame, keys: list[str], shingle_words: int = 5, similarity: float = 0.8, max_bits: int = 4, sure: float = 0.9999) -> DataFrame:
    """For each group the doc_id and keys of one row: that of the smallest doc_id (null is the largest), then of the smallest keys."""
    spark, sets = docs.sparkSession, Sets(mapped_dir(docs.sparkSession, "shingle-sets"))
    bands = bands_for(similarity, sure)
    radius = -(-(max_bits // 2) // 2)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = TaskContext.get().partitionId(), 0
        temporary = f"{sets.path(number)}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            for batch in slices(batches):
                fp, h, first = shingle_sets(batch.column("text"), shingle_words)
                size = np.diff(first)
                record = 4 + 6 * size
                place = at + np.cumsum(record) - record
                six = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 2:]).reshape(-1)
                for i, n in enumerate(size.tolist()):
                    f.write(n.to_bytes(4, "little"))
                    f.write(six[6 * first[i] : 6 * first[i + 1]].data)
                at += int(record.sum())
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(_sums(h, first).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(place + (number << _FILE), pa.int64())], [*names, "node", "fp", "place"])
        os.replace(temporary, sets.path(number))
        trim()

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ["doc_id", *keys])
    prints = docs.select("doc_id", *keys, "text").mapInArrow(write, f"{kinds}, node long, fp long, place long")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("best")
    # the files' places are of one run of the pass, so it has to be written before it is aggregated
    prints = written(prints, "prints")
    nodes = written(prints.groupBy("node").agg(best, F.min("place").alias("place"), F.min("fp").alias("fp")), "nodes")
    buckets = parts(nodes.count() * (2 * (1 + 32 * radius**2) + bands), 400_000, 8)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                place = batch.column("place").slice(at, 8192).to_numpy()
                fp = batch.column("fp").slice(at, 8192).to_numpy().view(np.uint64)
                key, owner = cells_of(fp, radius)
                keys, owners = [key], [owner]
                group, held = [], 0
                for k in [*np.argsort(place).tolist(), -1]:
                    if k >= 0 and (n := sets.size(int(place[k]))):
                        group.append(k)
                        held += n
                    if group and (k < 0 or held > 1 << 17):
                        each = [sets.get(int(place[x])) for x in group]
                        first = np.concatenate(([0], np.cumsum([len(x) for x in each])))
                        keys.append(band_keys(mix(np.concatenate(each)), first, bands).reshape(-1))
                        owners.append(np.tile(np.array(group), bands))
                        group, held = [], 0
                key, owner = np.concatenate(keys), np.concatenate(owners)
                spread = mix(key.copy())
                order = np.argsort(spread)
                spread, key, owner = spread[order], key[order], owner[order]
                edge = bucket_edges(spread, buckets)
                full = np.flatnonzero(np.diff(edge))
                blobs = [pack(key[edge[b] : edge[b + 1]], fp[owner[edge[b] : edge[b + 1]]], place[owner[edge[b] : edge[b + 1]]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
        trim()

    def meet(group: pa.Table) -> pa.Table:
        all_ = [unpack(x, "u8", "u8", "u8") for x in group.column("blob").to_pylist()]
        a, b = key_links(*(np.concatenate([x[k] for x in all_]) for k in range(3)), max_bits, Verified(sets, similarity))
        trim()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    edges = written(nodes.select("fp", "place").mapInArrow(put, "bucket long, blob binary").groupBy("bucket").applyInArrow(meet, "a long, b long"), "links")
    shutil.rmtree(sets.folder, ignore_errors=True)
    release(spark)
    roots = written(components(edges), "roots")
    placed = nodes.join(roots, nodes["place"] == roots["node"], "left").select(F.coalesce("root", "place").alias("root"), "best")
    return placed.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", *[f"best.{k}" for k in keys])
