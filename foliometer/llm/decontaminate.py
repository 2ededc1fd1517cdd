"""Benchmark decontamination: windows of test items, looked up in every document.

Words are lower-cased runs of ASCII letters, digits and characters outside
ASCII. A window is `window` consecutive words of an item; an item with fewer words
is one window, one with none has none. A document word inside any occurrence of a
window is hit. Windows are found by a 64-bit hash and verified on their bytes.

The items go to the executors as a broadcast hash set as long as their texts hold
at most `broadcast_bytes`, their ids counted. Beyond that they are split by a hash of the
item into parts of about that size; each part's hash set is built by a task, written to the
shared folder and mapped by the workers, one after the other for each batch. So no task
ever holds more than one part, and the driver the parts' names only.

Nulls and ties: a null text has no words, a null item_id is the item ''. Rows that
repeat an item_id are one item with all their windows. Documents are never joined or
shuffled, so repeated documents, hot passages and long texts need no care. An empty
benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, mapped_dir, parts, save, table
from .words import ALNUM, Words, slices, windows, within

_FILTER_BITS = 1 << 20


class ItemSet:
    """The windows of some items: for each length, sorted hashes, where each is found, and which items have it."""

    ARRAYS = ("filter", "key", "at", "begin", "item")

    def __init__(self, ids: list[str], texts: list[str | None], window: int) -> None:
        self.ids = sorted(set(ids))
        number = {x: k for k, x in enumerate(self.ids)}
        own = np.array([number[x] for x in ids], dtype=np.int64)
        words = Words(pa.array(texts, pa.large_string()), ALNUM, lower=True)
        self.data, self.start, self.end = words.data.copy(), words.start, words.end
        count, owner = words.counts, own[words.owner()] if len(words) else np.zeros(0, np.int64)
        self.lengths: dict[int, dict[str, np.ndarray]] = {}
        for length in [*np.unique(count[(count > 0) & (count < window)]).tolist(), window]:
            starts = within(words, length)
            if length < window:
                starts = starts[np.isin(starts, words.first[:-1][count == length])]
            if not len(starts):
                continue
            key = windows(words.hash, length)[starts]
            both = np.unique(np.stack([key, owner[starts].astype(np.uint64)]), axis=1)
            keys, at = np.unique(key, return_index=True)
            seen = np.zeros(_FILTER_BITS, dtype=bool)
            seen[(keys & np.uint64(_FILTER_BITS - 1)).astype(np.int64)] = True
            self.lengths[length] = {"filter": seen, "key": keys, "at": starts[at], "begin": np.searchsorted(both[0], np.append(keys, 0))[:-1], "item": both[1].astype(np.int64)}

    def same(self, words: Words, k: int, ref: int, length: int) -> bool:
        return all(self.data[self.start[ref + j] : self.end[ref + j]].tobytes() == words.text(k + j) for j in range(length))

    def find(self, words: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which words are hit, and pairs (text, item) as two arrays."""
        cover, pairs = np.zeros(len(words) + 1, dtype=np.int64), []
        owner = None
        for length, own in self.lengths.items():
            starts = within(words, length)
            if not len(starts):
                continue
            key = windows(words.hash, length)[starts]
            maybe = np.flatnonzero(own["filter"][(key & np.uint64(_FILTER_BITS - 1)).astype(np.int64)])
            at = np.searchsorted(own["key"], key[maybe])
            at[at == len(own["key"])] = 0
            hit = own["key"][at] == key[maybe]
            at, starts = at[hit], starts[maybe[hit]]
            if not len(at):
                continue
            # the first occurrence of each window is compared by bytes, the others with it word by word
            which, first, back = np.unique(at, return_index=True, return_inverse=True)
            good = np.array([self.same(words, starts[f], own["at"][w], length) for w, f in zip(which, first, strict=True)])[back]
            model = starts[first][back]
            for j in range(length):
                good &= words.hash[starts + j] == words.hash[model + j]
            at, starts = at[good], starts[good]
            cover += np.bincount(starts, minlength=len(cover)) - np.bincount(starts + length, minlength=len(cover))
            owner = words.owner() if owner is None else owner
            both = np.unique(np.stack([owner[starts], at]), axis=1)
            begin, end = own["begin"][both[1]], np.append(own["begin"][1:], len(own["item"]))[both[1]]
            size = end - begin
            items = own["item"][np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
            pairs.append(np.unique(np.stack([np.repeat(both[0], size), items]), axis=1))
        hit = np.cumsum(cover)[:-1] > 0
        return hit, list(np.unique(np.concatenate(pairs, axis=1), axis=1)) if pairs else [np.zeros(0, np.int64)] * 2

    def save(self, folder: str) -> ItemSet:
        """The same set with its arrays in files, which are mapped where they are used."""
        for length, own in self.lengths.items():
            for name in self.ARRAYS:
                save(f"{folder}/{length}-{name}.npy", own[name])
        for name in ("data", "start", "end"):
            save(f"{folder}/{name}.npy", getattr(self, name))
        with open(f"{folder}/ids", "w", encoding="utf-8") as f:
            json.dump(self.ids, f)
        return ItemSet.at(folder)

    @staticmethod
    def at(folder: str) -> ItemSet:
        """The set of a folder, not opened yet."""
        out = ItemSet.__new__(ItemSet)
        out.ids, out.folder = [], folder
        return out

    def opened(self) -> ItemSet:
        if not hasattr(self, "folder"):
            return self
        out = ItemSet.__new__(ItemSet)
        lengths = sorted(int(name.split("-")[0]) for name in os.listdir(self.folder) if name.endswith("-key.npy"))
        out.lengths = {k: {n: mapped(f"{self.folder}/{k}-{n}.npy") for n in self.ARRAYS} for k in lengths}
        out.data, out.start, out.end = (mapped(f"{self.folder}/{n}.npy") for n in ("data", "start", "end"))
        with open(f"{self.folder}/ids", encoding="utf-8") as f:
            out.ids = json.load(f)
        return out


def item_sets(benchmark: DataFrame, window: int, broadcast_bytes: int) -> list[ItemSet]:
    """One set that may be broadcast, or several whose arrays are in the shared folder."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    items = items.where(F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))  # one without words has no window
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 16)).first()[0] or 0
    count = parts(size, broadcast_bytes)
    if count == 1:
        rows = items.collect()  # at most broadcast_bytes
        return [ItemSet([r[0] for r in rows], [r[1] for r in rows], window)]
    folder = mapped_dir(benchmark.sparkSession, "items")

    def build(group: pa.Table) -> pa.Table:
        own = f"{folder}/{group.column('part')[0].as_py()}-{uuid.uuid4().hex}"
        os.makedirs(own)
        ItemSet(group.column("item_id").to_pylist(), group.column("text").to_pylist(), window).save(own)
        return pa.table({"folder": [own]})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    return [ItemSet.at(r[0]) for r in dealt.groupBy("part").applyInArrow(build, "folder string").collect()]  # a name for each part


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = 8 << 20, remove: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated; the text goes unless keep_text.

    remove="spans" cuts each run of hit words, and what lies between them, from the
    text; remove="documents" drops the documents that are hit; None changes nothing.
    """
    if remove not in (None, "spans", "documents"):
        raise ValueError(f"remove: {remove}")
    spark = docs.sparkSession
    sets = spark.sparkContext.broadcast(item_sets(benchmark, window, broadcast_bytes))
    new = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]
    own = {n for n, _ in new}
    schema = T.StructType([f for f in docs.schema.fields if f.name not in own and (keep_text or f.name != "text")] + [T.StructField(n, t) for n, t in new])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), ALNUM, lower=True)
            hit, texts, ids = np.zeros(len(words), dtype=bool), [], []
            for one in sets.value:
                one = one.opened()
                got, (text, item) = one.find(words)
                hit |= got
                texts += text.tolist()
                ids += [one.ids[k] for k in item.tolist()]
            found: dict[int, set[str]] = {}
            for t, item in zip(texts, ids, strict=True):
                found.setdefault(t, set()).add(item)
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[words.first[1:]] - total[words.first[:-1]]
            digest = [hashlib.sha256(",".join(sorted(found.get(i, ()))).encode()).hexdigest() for i in range(batch.num_rows)]
            out = {
                "n_words": pa.array(words.counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(found.get(i, ())) for i in range(batch.num_rows)], pa.int64()),
                "items_sha256": pa.array(digest, pa.string()), "contaminated": pa.array(n_hit > 0),
            }
            if remove == "spans" and keep_text and hit.any():
                text = batch.column("text").to_pylist()
                for i in np.flatnonzero(n_hit):
                    text[i] = _cut(text[i], words, int(i), hit)
                out["text"] = pa.array(text, pa.string())
            got = pa.RecordBatch.from_arrays([out[n] if n in out else batch.column(n) for n in names], names)
            yield got.filter(pa.array(n_hit == 0)) if remove == "documents" else got

    return (docs if keep_text else docs.select(*[c for c in docs.columns if c not in own])).mapInArrow(run, schema)


def _cut(text: str, words: Words, i: int, hit: np.ndarray) -> str:
    raw, base = text.encode(), words.offsets[i]
    a, b = words.first[i], words.first[i + 1]
    edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
    out, at = [], 0
    for p, q in zip(a + np.flatnonzero(edge == 1), a + np.flatnonzero(edge == -1) - 1, strict=True):
        out.append(raw[at : words.start[p] - base])
        at = words.end[q] - base
    return (b"".join(out) + raw[at:]).decode()


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, table(spark, sf_dir, "benchmark"), keep_text=False)


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
