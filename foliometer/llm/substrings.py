"""Exact repeats of word windows, found through recompression symbols.

A window is `window` consecutive words of one document. Every word that a window
covers goes, if the window's word sequence also starts earlier: in a document of
smaller doc_id, or earlier in the same document.

1. Each text is recompressed for a few rounds (recompress.py): runs and pairs of
   words get names that are the same everywhere. Names seen at least twice are
   kept, as sorted files in the shared folder.
2. Equal windows have equal consistent interior symbols, so a window can repeat
   only if each of its symbols of the last round does. Windows that pass are told by
   their decomposition into symbols: as many of the last round as lie in the window,
   beside them what is left of the rounds before, down to words. Decompositions are equal
   just where the windows are; 96 bits of them are compared, of two names that are worked
   out apart from the words' bytes on. Each task reduces its windows to (decomposition,
   first place), deals them by decomposition, and those that start at least twice are written as
   sorted files with their first place.
3. Each document looks its windows up in those files, which are mapped and
   not read whole; a window whose first place is another one covers its words.

What crosses the network is one entry per task for each distinct symbol or
candidate window, so copies collapse before the shuffle and every hash range is
even, however hot a passage is. Nothing is capped, and nothing is sent to the driver.

Nulls and ties: a null text has no words; a null doc_id counts as smaller than any
other. Rows that repeat a doc_id count as one place: neither is earlier than the
other at an equal start. Empty tables give an empty result, other columns stay
as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SortedFiles, bucket_edges, mapped_dir, pack, parts, release, table, text_bytes, unpack
from .recompress import Parse, parse
from .words import SPACED, Words, slices, within

_NONE = np.iinfo(np.int64).min


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False)


def _doubles(sorted_keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and whether each counts at least twice."""
    begin = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[begin], (np.add.reduceat(counts, begin) if len(begin) else counts) > 1


class _Blobs:
    """Collects a task's sorted arrays until there are many, then gives them as rows (bucket, blob)."""

    def __init__(self, buckets: int, merge, most: int = 1_500_000) -> None:
        self.buckets, self.merge, self.most = buckets, merge, most
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(arrays)
        self.size += len(arrays[0])
        if self.size > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            arrays = self.merge(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
            edge = bucket_edges(arrays[0], self.buckets)
            full = np.flatnonzero(np.diff(edge))
            blobs = [pack(*(np.ascontiguousarray(a[edge[b] : edge[b + 1]]) for a in arrays)) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
        self.held, self.size = [], 0


def _merge_symbols(names: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(names)
    names, many = _doubles(names[order], twice[order].astype(np.int64))
    return names, (many + 1).astype(np.uint8)


def _merge_windows(key: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each window: its first place, and 2 if it is known to start at two places."""
    order = np.lexsort((start, doc, check, key)) if len(key) else np.zeros(0, np.int64)
    key, check, doc, start, twice = key[order], check[order], doc[order], start[order], twice[order]
    begin = np.ones(len(key), dtype=bool)
    begin[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    at = np.flatnonzero(begin)
    # repeated rows share a place; only another place makes a window repeat
    moved = np.zeros(len(key), dtype=np.int64)
    moved[1:] = ~begin[1:] & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
    many = (np.maximum.reduceat(np.maximum(moved, twice == 2), at) if len(at) else moved) > 0
    return key[at], check[at], doc[at], start[at], (many + 1).astype(np.uint8)


def _symbols(words: Words, rounds: int) -> Parse:
    return parse(words.hash, words.owner(), rounds, words.second())


def _candidates(words: Words, window: int, symbols: Parse, repeated: SortedFiles) -> np.ndarray:
    """Starts of the windows all of whose consistent interior symbols of the last round repeat."""
    starts = within(words, window)
    if not len(starts):
        return starts
    lo, hi = symbols.need_lo, symbols.need_hi
    inside = hi - lo <= window
    names, lo, hi = symbols.name[inside], lo[inside], hi[inside]
    order = np.argsort(names)
    known, _ = repeated.find(names[order], (0,))
    alone = np.zeros(len(names), dtype=bool)
    alone[order] = ~known
    lo, hi = lo[alone], hi[alone]
    # a symbol seen once bars every window that holds all that its name depends on
    first = np.maximum(hi - window, 0)
    ok = lo >= first
    change = np.bincount(first[ok], minlength=len(words) + 2).astype(np.int64)
    change -= np.bincount(lo[ok] + 1, minlength=len(change))[: len(change)]
    return starts[np.cumsum(change)[starts] == 0]


def _keys(symbols: Parse, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a window is told by: hashes of the symbols that it is made of."""
    key, check = symbols.decompositions(starts, window)
    return key, check.astype(np.uint32)


def covered(words: Words, docs: np.ndarray, window: int, rounds: int, repeated: SortedFiles, firsts: SortedFiles) -> np.ndarray:
    """For each word, whether a window that also starts earlier covers it."""
    symbols = _symbols(words, rounds)
    starts = _candidates(words, window, symbols, repeated)
    out = np.zeros(len(words) + 1, dtype=np.int64)
    if len(starts):
        owner = words.owner()[starts]
        key, check = _keys(symbols, window, starts)
        order = np.argsort(key)
        there, _, doc, start = firsts.find(key[order], (0, 0, 0), check[order])
        own, place = docs[owner][order], (starts - words.first[owner])[order]
        hit = there & ((doc < own) | ((doc == own) & (start < place)))
        at = starts[order][hit]
        out += np.bincount(at, minlength=len(out)) - np.bincount(at + window, minlength=len(out) + window)[: len(out)]
    return np.cumsum(out)[:-1] > 0


def index_repeats(docs: DataFrame, window: int, rounds: int) -> tuple[SortedFiles, SortedFiles]:
    """Files of the symbols that repeat, and of the windows that repeat with their first places."""
    if rounds < 1:
        raise ValueError("rounds must be at least 1")
    spark = docs.sparkSession
    folder = mapped_dir(spark, "substrings")
    buckets = parts(text_bytes(docs), 24 << 20, 8)
    repeated = SortedFiles(folder, "symbols", buckets, ["name", "seen"])
    firsts = SortedFiles(folder, "windows", buckets, ["key", "check", "doc", "start"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Blobs(buckets, _merge_symbols)
        for batch in slices(batches):
            words = Words(batch.column("text"), SPACED, lower=False)
            symbols = parse(words.hash, words.owner(), rounds)
            names = symbols.name[symbols.need_hi - symbols.need_lo <= window]
            yield from held.add(names, np.ones(len(names), dtype=np.uint8))
        yield from held.flush()

    def keep_names(group: pa.Table) -> pa.Table:
        both = [unpack(x, "u8", "u1") for x in group.column("blob").to_pylist()]
        names, twice = _merge_symbols(np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]))
        names = names[twice > 1]
        repeated.write(group.column("bucket")[0].as_py(), name=names, seen=np.zeros(len(names), dtype=np.uint8))
        return pa.table({"bucket": group.column("bucket").slice(0, 1)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Blobs(buckets, _merge_windows, 750_000)
        for batch in slices(batches):
            words = Words(batch.column("text"), SPACED, lower=False)
            symbols = _symbols(words, rounds)
            starts = _candidates(words, window, symbols, repeated)
            owner = words.owner()[starts]
            key, check = _keys(symbols, window, starts)
            yield from held.add(key, check, _ids(batch.column("doc_id"))[owner], (starts - words.first[owner]).astype(np.int32), np.ones(len(key), dtype=np.uint8))
        yield from held.flush()

    def keep_windows(group: pa.Table) -> pa.Table:
        both = [unpack(x, "u8", "u4", "i8", "i4", "u1") for x in group.column("blob").to_pylist()]
        *kept, twice = _merge_windows(*(np.concatenate(x) for x in zip(*both, strict=True)))
        key, check, doc, start = (x[twice > 1] for x in kept)
        firsts.write(group.column("bucket")[0].as_py(), key=key, check=check, doc=doc, start=start)
        return pa.table({"bucket": group.column("bucket").slice(0, 1)})

    source = docs.select("doc_id", "text")
    for dealt, kept, files in ((name, keep_names, repeated), (place, keep_windows, firsts)):
        # a partition for each range, so that what a task reads doesn't grow with the input
        ranges = source.mapInArrow(dealt, "bucket int, blob binary").repartitionById(buckets, F.col("bucket"))
        done = ranges.groupBy("bucket").applyInArrow(kept, "bucket int")
        files.seal([r[0] for r in done.collect()])  # a number for each range
        del done
        release(spark)
    return repeated, firsts


def remove_repeats(docs: DataFrame, window: int = 20, rounds: int = 4, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, if asked for, the text without the words that go.

    A text that loses nothing stays as it is; of others the kept words remain,
    joined by one space.
    """
    repeated, firsts = index_repeats(docs, window, rounds)
    inner = docs if keep_text else docs.select("doc_id", "text")
    schema = T.StructType([f for f in inner.schema.fields if f.name not in ("n_words", "n_removed", "kept_sha256")] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != "text"])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), SPACED, lower=False)
            gone = covered(words, _ids(batch.column("doc_id")), window, rounds, repeated, firsts)
            lost = np.concatenate(([0], np.cumsum(gone)))
            removed = lost[words.first[1:]] - lost[words.first[:-1]]
            joined, start, end = words.joined()
            digest, text = [], batch.column("text").to_pylist() if keep_text else []
            raw = np.frombuffer(joined, dtype=np.uint8)
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                if removed[i]:
                    stay = np.repeat(~gone[a:b], end[a:b] - start[a:b] + 1)
                    kept = raw[start[a] : end[b - 1] + 1][stay].tobytes()[:-1]
                    if keep_text:
                        text[i] = kept.decode()
                else:
                    kept = joined[start[a] : end[b - 1]] if b > a else b""
                digest.append(hashlib.sha256(kept).hexdigest())
            out = {"n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "text": pa.array(text, pa.string()) if keep_text else None}
            yield pa.RecordBatch.from_arrays([out[n] if n in out else batch.column(n) for n in names], names)

    return inner.select(*[f.name for f in inner.schema.fields]).mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS g FROM d, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20
), later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT w.doc_id, count(g.p) AS n_removed, string_agg(x, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS t
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
