"""An interpolated modified Kneser-Ney model, counted in Spark and mapped by the workers that score.

A text is one sentence: a start symbol, its words, an end symbol (which is a token).
Level m of the model holds the n-grams of m words, keyed by a 64-bit hash:

    p_m(w | c) = (max(a(c w) - D_m(a(c w)), 0) + (D1 N1(c) + D2 N2(c) + D3 N3(c)) p_{m-1}(w | c')) / T(c)

a is the count at the highest level and for n-grams that begin with the start
symbol, else the number of distinct words seen before the n-gram; N1, N2, N3 count
the continuations of c with a = 1, 2, 3 or more and T sums their a. D_m comes
from the counts of counts of level m. A context never seen passes on to c'. Level
1 rests on the uniform 1 / (V + 1), which is all that an unknown word gets.

Counting. Each task reduces its texts to sorted n-grams with counts, split by ranges
of their hash; a range is merged in one task, which writes the level's sorted
arrays (`SortedFiles`) and passes on, for the level below, its distinct suffixes and
contexts. The number of ranges follows the input's size, and as a task holds one
entry for each distinct n-gram a hot word or text makes no range larger. What is
passed on stays in sorted files as well, of which each range below maps its slice. The
files lie in the shared folder, are mapped, and are asked in the order of their
keys. The driver gets counts of counts only.

Nulls and ties: a null text is an empty text, of which the end symbol is scored. A
null doc_id has no remainder and is trained on. Rows that repeat count and are scored
once each. With no training text at all, base and model give every token 1 / (V + 1)
with V = 0. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SortedFiles, bucket_edges, mapped_dir, pack, parts, release, small_batches, table, text_bytes, trim, unpack
from .words import BASE, SPACED, Words, mix, slices, windows

START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x1B873593CC9E2D51)


def sentences(words: Words, rows: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the chosen texts end to end, the position of each in its sentence, and the text of each.

    Position 0 is the start symbol.
    """
    count = words.counts[rows]
    size = count + 2
    begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.zeros(0, np.int64)
    symbols = np.empty(int(size.sum()), dtype=np.uint64)
    place = np.arange(len(symbols)) - np.repeat(begin, size)
    owner = np.repeat(rows, size)
    symbols[begin], symbols[begin + size - 1] = START, END
    inner = (place > 0) & (place < np.repeat(size, size) - 1)
    symbols[inner] = words.hash[(np.repeat(words.first[:-1][rows], count) + np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)).astype(np.int64)] if len(rows) else []
    return symbols, place, owner


def gram_keys(grams: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams given as columns of words; equal to windows() over a text."""
    if len(grams) == 1:
        return grams[0]
    out = grams[0].copy()
    for words in grams[1:]:
        out *= BASE
        out += words
    return mix(out)


def _sum(keys: np.ndarray, columns: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct keys, the first of each column and the total of each of sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], [c[order[at]] for c in columns], [np.add.reduceat(s[order], at) if len(at) else s for s in sums]


class Model:
    """Where the levels are, and the constants of the formula."""

    def __init__(self, folder: str, order: int, buckets: int) -> None:
        self.order, self.buckets = order, buckets
        context = ["total", "n1", "n2", "n3"]
        self.levels = {}
        for m in range(1, order + 1):
            counts = [*(["raw"] if m == 1 else []), "count", *(context if m < order else [])]
            self.levels[m] = SortedFiles(folder, f"level{m}", buckets, ["key", *counts], counts)
        self.discounts: dict[int, np.ndarray] = {}
        self.tokens = self.types = 0
        self.unigram_total = self.unigram_mass = 0.0

    def discount(self, level: int, a: np.ndarray) -> np.ndarray:
        return self.discounts[level][np.minimum(a, 3).astype(np.int64)]

    def mass(self, level: int, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> np.ndarray:
        d = self.discounts[level]
        return d[1] * n1 + d[2] * n2 + d[3] * n3

    def lookup(self, level: int, keys: np.ndarray) -> list[np.ndarray]:
        """The level's columns for keys in any order (zeros for those not there)."""
        distinct, back = np.unique(keys, return_inverse=True)
        return [x[back] for x in self.levels[level].find(distinct, [0] * (len(self.levels[level].columns) - 1))]

    def score(self, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol but the starts (which get 0): its probability, and its count in the training tokens."""
        _, raw, count, *context = self.lookup(1, symbols)
        p = np.full(len(symbols), 1.0 / (self.types + 1))
        if self.unigram_total:
            a = count.astype(np.float64)
            p = (np.maximum(a - self.discount(1, count), 0) + self.unigram_mass * p) / self.unigram_total
        for m in range(2, self.order + 1):
            # columns of the context of m - 1 words that ends before each symbol
            total, n1, n2, n3 = (np.concatenate((np.zeros(min(m - 1, len(symbols)), x.dtype), x[: max(0, len(x) - m + 1)])).astype(np.float64) for x in context)
            known = (place >= m - 1) & (total > 0)
            at = np.flatnonzero(place >= m - 1)
            count, context = np.zeros(len(symbols), np.int64), [np.zeros(len(symbols))] * 4
            keys = windows(symbols, m)
            if len(keys):
                _, found, *rest = self.lookup(m, keys)
                ends = np.arange(len(keys)) + m - 1
                valid = place[ends] >= m - 1
                count[ends[valid]] = found[valid]
                if rest:
                    # indexed by the first word of the n-gram, as for level 1
                    context = [np.where(valid, x, 0) for x in rest]
                    context = [np.concatenate((x, np.zeros(len(symbols) - len(x), x.dtype))) for x in context]
            at = np.flatnonzero(known)
            a = count[at].astype(np.float64)
            p[at] = (np.maximum(a - self.discount(m, count[at]), 0) + self.mass(m, n1[at], n2[at], n3[at]) * p[at]) / total[at]
        return p, raw


def _discounts(counts: np.ndarray) -> np.ndarray:
    """D0..D3 from the numbers of n-grams with a = 1, 2, 3 and 4; absolute 0.5, 1, 1.5 where those are too few."""
    n1, n2, n3, n4 = (float(x) for x in counts)
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % 10 == 0 for x in ids.to_pylist()], dtype=bool)


def pack_grams(grams: list[np.ndarray], count: np.ndarray) -> bytes:
    """n-grams and counts in the order of the first word; each word stands once, and by number in the n-grams."""
    order, out, head = None, [], []
    for words in grams:
        distinct, number = np.unique(words, return_inverse=True)
        order = np.argsort(number, kind="stable") if order is None else order
        number = number[order].astype(np.uint16 if len(distinct) < 1 << 16 else np.uint32)
        head += [len(distinct), number.itemsize]
        out += [pack(distinct), pack(number)]
    return np.array([len(count), *head], np.int64).tobytes() + b"".join(out) + pack(count[order].astype(np.uint32))


def unpack_grams(blob: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    n, *head = np.frombuffer(blob, np.int64, 1 + 2 * width).tolist()
    at, grams = 8 * (1 + 2 * width), []
    for size, kind in zip(head[::2], head[1::2], strict=True):
        (distinct,) = unpack(blob[at : at + 8 * size], "u8")
        at += 8 * size
        (number,) = unpack(blob[at : at + kind * n], f"u{kind}")
        at += kind * n
        grams.append(distinct[number])
    return grams, unpack(blob[at:], "u4")[0]


def _rows(buckets: int, kind: int, keys: np.ndarray, grams: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
    edge = bucket_edges(keys, buckets)
    full = np.flatnonzero(np.diff(edge))
    cut = lambda x, b: np.ascontiguousarray(x[edge[b] : edge[b + 1]])
    blobs = [pack_grams([cut(g, b) for g in grams], cut(values[0], b)) if kind == _GRAM else pack(*(cut(x, b) for x in (*grams, *values))) for b in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(np.full(len(full), kind), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


_BLOB = "bucket long, kind int, blob binary"
#: Kinds of blobs: counts of n-grams, counts of tokens, and none.
_GRAM, _TOKEN, _NOTHING = 0, 1, 2
#: What a level passes to the one below: distinct words seen before, and the total and the numbers of continuations.
_PASSED = ["before", "total", "n1", "n2", "n3"]


def train(docs: DataFrame, order: int = 2, bucket_bytes: int = 16 << 20) -> Model:
    """Count the documents of docs(doc_id, text) that are not held out.

    Each level reads the texts once, so that only one level's n-grams are in a
    shuffle or on the shared disk at a time.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    buckets = parts(text_bytes(docs), bucket_bytes, 8)
    model = Model(mapped_dir(spark, "kneser-ney"), order, buckets)

    def counter(level: int):
        return lambda batches: count(batches, level)

    def count(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        kind, size = (_TOKEN, 0) if level == 1 else (_GRAM, 0)

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                grams = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                keys, grams, (n,) = _sum(gram_keys(grams), grams, [np.ones(len(grams[0]), np.uint32)])
                out = _rows(buckets, kind, keys, grams, [n.astype(np.uint32)])
                del keys, grams, n
                trim()
                yield out

        for batch in slices(batches):
            words = Words(batch.column("text"), SPACED, lower=True)
            symbols, place, _ = sentences(words, np.flatnonzero(~held_out(batch.column("doc_id"))), order)
            if level == 1:
                held.append([symbols[place > 0]])
            else:  # shorter n-grams keep their counts only if they begin with the start symbol
                ends = np.flatnonzero(place >= order - 1 if level == order else place == level - 1)
                held.append([symbols[ends - level + 1 + j] for j in range(level)])
            size += len(held[-1][0])
            if size > 2_500_000:
                yield from flush()
                size = 0
        yield from flush()

    passed = {m: SortedFiles(model.levels[m].folder, f"passed{m}", buckets, ["key", *(f"w{j}" for j in range(m) if m > 1), *_PASSED], _PASSED) for m in range(1, order)}

    def merge(level: int):
        files = model.levels[level]

        def run(group: pa.Table) -> pa.Table:
            bucket = group.column("bucket")[0].as_py()
            pieces = []
            for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob"), strict=True):
                if kind == _NOTHING:
                    grams, count = [np.zeros(0, np.uint64)] * level, np.zeros(0, np.int64)
                elif kind == _GRAM:
                    grams, count = unpack_grams(blob.as_buffer().to_pybytes(), level)
                else:
                    *grams, count = unpack(blob.as_buffer().to_pybytes(), "u8", "u4")
                zero = np.zeros(len(count), np.int64)
                count = count.astype(np.int64)
                pieces.append((grams, [count] if level == order else [count if level == 1 else zero, zero if level == 1 else count, *[zero] * 4]))
            if level < order:  # what each range of the level above has passed on, of which this range is a slice
                for source in range(buckets):
                    got = passed[level].part(source, bucket)
                    if got:
                        pieces.append((got[1 : level + 1] if level > 1 else got[:1], [np.zeros(len(got[0]), np.int64), *got[-5:]]))
            grams = [np.concatenate([p[0][j] for p in pieces]) for j in range(level)]
            values = [np.concatenate([p[1][j] for p in pieces]) for j in range(len(pieces[0][1]))]
            del pieces
            keys, grams, values = _sum(gram_keys(grams), grams, values)
            raw, a, *context = values if level < order else [np.zeros(0, np.int64), values[0]]
            files.write(bucket, key=keys, count=a, raw=raw, **dict(zip(_PASSED[1:], context, strict=False)))
            if level > 1:
                # a suffix gains one distinct word before it; a context gains its continuation
                real = a > 0
                grams, b = [g[real] for g in grams], a[real]
                _, suffix, (before,) = _sum(gram_keys(grams[1:]), grams[1:], [np.ones(len(b), np.int64)])
                _, prefix, after = _sum(gram_keys(grams[:-1]), grams[:-1], [b, (b == 1).astype(np.int64), (b == 2).astype(np.int64), (b > 2).astype(np.int64)])
                columns = [np.concatenate(x) for x in zip(suffix, prefix, strict=True)]
                both = [np.concatenate((before, np.zeros(len(prefix[0]), np.int64))), *(np.concatenate((np.zeros(len(before), np.int64), x)) for x in after)]
                k, columns, both = _sum(gram_keys(columns), columns, both)
                passed[level - 1].write(bucket, key=k, **{f"w{j}": w for j, w in enumerate(columns)}, **dict(zip(_PASSED, both, strict=True)))
            facts = [*(int((a == k).sum()) for k in (1, 2, 3, 4)), int((a > 2).sum()), int(a.sum()), int(raw.sum()), int((raw > 0).sum())]
            trim()
            return pa.table({f"f{j}": [x] for j, x in enumerate(facts)})

        return run

    for level in range(order, 0, -1):
        every = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(_NOTHING).alias("kind"), F.lit(b"").alias("blob"))
        dealt = docs.select("doc_id", "text").mapInArrow(counter(level), _BLOB).unionByName(every)
        merged = dealt.groupBy("bucket").applyInArrow(merge(level), ", ".join(f"f{j} long" for j in range(8)))
        facts = merged.agg(*[F.sum(c).alias(c) for c in merged.columns]).first()
        model.discounts[level] = _discounts(np.array(facts[:4]))
        del dealt, merged
        release(spark)
    model.tokens, model.types = int(facts[6]), int(facts[7])
    model.unigram_total = float(facts[5])
    d = model.discounts[1]
    model.unigram_mass = float(d[1] * facts[0] + d[2] * facts[1] + d[3] * facts[4])
    return model


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) and perplexity."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), SPACED, lower=True)
            n = batch.num_rows
            symbols, place, _ = sentences(words, np.arange(n), model.order)
            p, raw = model.score(symbols, place)
            base = np.log10((raw + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            begin = np.flatnonzero(place == 0)
            inner = place > 0
            total = lambda x: np.add.reduceat(np.where(inner, x, 0), begin)
            tokens, score = total(np.ones(len(p), np.int64)), total(np.log10(p))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(held_out(batch.column("doc_id"))), pa.array(tokens), pa.array(total((raw > 0).astype(np.int64))), pa.array(np.full(n, model.tokens)), pa.array(total(base)), pa.array(score), pa.array(10.0 ** np.minimum(-score / tokens, 300.0))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return perplexity(docs, train(docs))
