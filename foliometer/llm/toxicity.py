"""Toxicity by a classifier chain of linear models.

A chain predicts categories one after the other. Each is a logistic regression on
words and word beginnings (present or not) and a few figures of the text's surface, and on the
probabilities of the categories before it. A later model is trained with
out-of-fold probabilities of the earlier ones: those that models fitted without the
row's fold gave. Scoring uses the models of all rows, in the order of the chain.

Training takes a bounded sample: the `sample` rows of labels of smallest doc_id hash
(all of them, if fewer), and of the different texts of their documents at most as many, again by hash. These are reduced on the executors to hashed
features, and the features counted in Spark. Copies and near copies (by the minima
of their word sets) count once, so that a copied document and its label do not weigh
more. A feature needs `least_docs` texts of the sample; for each category those whose
share of positive texts is furthest from the mean are taken, and only which of
these each text has comes to the driver. The fitted chain, a few
hundred numbers, goes to the executors; every document is scored whole, by the task
that reads it, without a shuffle.

Nulls and ties: a null text is empty and is scored as such. Labels that are null or whose
document is missing are not used; of a doc_id that is labelled or stored more than once all
rows are used. Without any usable label of a category (or with one value only) its
model gives the share of positives in the sample, 0 if there are none. An empty
table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written
from .words import ALNUM, SPACED, Words, mix, slices

_KINDS = np.zeros((4, 256), dtype=bool)
_KINDS[0, 65:91] = True  # upper-case letters
_KINDS[1, 65:91] = _KINDS[1, 97:123] = _KINDS[1, 0x80:] = True  # letters
_KINDS[2, 48:58] = True  # digits
_KINDS[3] = SPACED & ~_KINDS[1] & ~_KINDS[2]  # other signs


def surface(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The lower-cased words of texts, and five figures of each text."""
    plain, words = Words(texts, SPACED, lower=False), Words(texts, ALNUM, lower=True)
    size = np.maximum(np.diff(plain.offsets), 1)
    shares = []
    for kind in _KINDS:
        total = np.concatenate(([0], np.cumsum(kind[plain.data], dtype=np.int64)))
        shares.append(np.diff(total[plain.offsets]))
    letters = np.maximum(shares[1], 1)
    figures = np.stack([shares[0] / letters, shares[2] / size, shares[3] / size, np.log1p(words.counts) / 10, size / np.maximum(plain.counts, 1) / 50], axis=1)
    return words, np.minimum(figures, 5.0)


class Rows:
    """Feature rows: words as indices, figures and earlier categories dense; made dense a chunk at a time."""

    def __init__(self, words: list[np.ndarray], n_words: int, dense: np.ndarray, chunk: int = 1024) -> None:
        self.words, self.n_words, self.dense, self.chunk = words, n_words, dense, chunk

    def take(self, at: np.ndarray) -> Rows:
        return Rows([self.words[i] for i in at], self.n_words, self.dense[at], self.chunk)

    def chunks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(0, len(self.words), self.chunk):
            part = self.words[a : a + self.chunk]
            x = np.zeros((len(part), self.n_words + self.dense.shape[1] + 1))
            x[np.repeat(np.arange(len(part)), [len(w) for w in part]), np.concatenate(part)] = 1.0
            x[:, self.n_words : -1], x[:, -1] = self.dense[a : a + self.chunk], 1.0
            yield slice(a, a + self.chunk), x


def fit_logistic(rows: Rows, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights (the last one the intercept) of an L2-regularised logistic regression, by Newton's method."""
    size = rows.n_words + rows.dense.shape[1] + 1
    w, penalty = np.zeros(size), np.full(size, ridge)
    penalty[-1] = 1e-6
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    for _ in range(rounds):
        slope, curve = penalty * w, np.diag(penalty)
        for at, x in rows.chunks():
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (p - y[at])
            curve += (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


def _predict(rows: Rows, w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows.words))
    for at, x in rows.chunks():
        out[at] = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


#: Besides whole words, their first so many bytes are features; so stems count in languages that bend their words.
PREFIXES = (4, 5, 6, 7)


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, feature) for whole words and for each length of prefix."""
    yield np.arange(len(words)), words.hash
    for size in PREFIXES:
        yield words.prefixes(size)


def families(minima: np.ndarray, alike: int = 5) -> np.ndarray:
    """For each row of word-set minima the first row with at least `alike` of them in common."""
    out = np.arange(len(minima))
    for k in range(minima.shape[1]):
        first: dict[int, int] = {}
        for i in range(len(minima)):
            if out[i] == i:
                j = first.setdefault(int(minima[i, k]), i)
                if j != i and (minima[i] == minima[j]).sum() >= alike:
                    out[i] = j
    while not np.array_equal(out, out[out]):
        out = out[out]
    return out


class Chain:
    """For each category in turn: its sorted features and its weights (features, figures, earlier categories, intercept), or a constant."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.models: list[tuple[np.ndarray, np.ndarray] | float] = []

    def fit(self, keys: list[np.ndarray], has: list[list[np.ndarray]], figures: np.ndarray, labels: np.ndarray, folds: np.ndarray, ridge: float) -> Chain:
        """keys: each category's features; has: for each category and text, which of them it has; labels: texts by categories, NaN where unknown."""
        n = len(figures)
        earlier = np.zeros((n, 0))
        for k in range(len(self.names)):
            known = np.flatnonzero(~np.isnan(labels[:, k]))
            y = labels[known, k]
            if len(known) < 2 or y.min() == y.max():
                self.models.append(float(y.mean()) if len(y) else 0.0)
                out = np.full(n, self.models[-1])
            else:
                x = Rows(has[k], len(keys[k]), np.concatenate((figures, _logit(earlier)), axis=1))
                self.models.append((keys[k], fit_logistic(x.take(known), y, ridge)))
                out = _predict(x, self.models[-1][1])
                for fold in np.unique(folds[known]):  # what is passed on comes from models that have not seen the row
                    train = known[folds[known] != fold]
                    if len(train) > 1 and labels[train, k].min() < labels[train, k].max():
                        mine = folds == fold
                        out[mine] = _predict(x.take(np.flatnonzero(mine)), fit_logistic(x.take(train), labels[train, k], ridge))
            earlier = np.concatenate((earlier, out[:, None]), axis=1)
        return self

    def predict(self, words: Words, figures: np.ndarray) -> np.ndarray:
        """Probabilities, texts by categories."""
        n = len(figures)
        out = np.zeros((n, 0))
        owner = None
        for model in self.models:
            if isinstance(model, float):
                p = np.full(n, model)
            else:
                keys, w = model
                score = np.concatenate((figures, _logit(out)), axis=1) @ w[len(keys) : -1] + w[-1]
                if len(keys) and len(words):
                    low = np.zeros(1 << 16, dtype=bool)
                    low[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
                    owner = words.owner() if owner is None else owner
                    found = []
                    for word, h in features(words):
                        maybe = np.flatnonzero(low[(h & np.uint64(0xFFFF)).astype(np.int64)])
                        at = np.searchsorted(keys, h[maybe])
                        at[at == len(keys)] = 0
                        hit = keys[at] == h[maybe]
                        found.append(owner[word[maybe[hit]]] * len(keys) + at[hit])
                    pairs = np.unique(np.concatenate(found))
                    score += np.bincount(pairs // len(keys), weights=w[pairs % len(keys)], minlength=n)
                p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            out = np.concatenate((out, p[:, None]), axis=1)
        return out


def train(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], sample: int = 10_000, folds: int = 5, most: int = 512, least_docs: int = 8, ridge: float = 0.3) -> Chain:
    """Fit the chain; categories: name -> a 0/1 column of labels, in the order of the chain."""
    names = list(categories)
    ys = [f"y{i}" for i in range(len(names))]
    chosen = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *[c.cast("double").alias(y) for y, c in zip(ys, categories.values(), strict=True)]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
        for batch in slices(batches):
            words, figures = surface(batch.column("text"))
            every = [(words.owner()[w], h) for w, h in features(words)]
            owner, h = (np.concatenate(x) for x in zip(*every, strict=True))
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
            own = [np.unique(h[order[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            text, minima = [], []
            for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                w = words.hash[a:b]
                text.append(int(mix(np.array([np.sum(w * (np.arange(b - a, dtype=np.uint64) * np.uint64(2) + np.uint64(1)), dtype=np.uint64)]))[0] >> np.uint64(1)))
                minima.append(np.array([mix(w * s).min() for s in seeds]) if b > a else np.zeros(8, np.uint64))
            blob = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.int64()), blob(own), blob(minima), blob(figures), *(batch.column(y) for y in ys)], ["text", "features", "minima", "figures", *ys])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows are broadcast
    kinds = ", ".join(f"{y} double" for y in ys)
    texts = joined.mapInArrow(reduce, f"text long, features binary, minima binary, figures binary, {kinds}")
    texts = written(texts.groupBy("text").agg(*[F.first(c).alias(c) for c in ("features", "minima", "figures")], *[F.avg(y).alias(y) for y in ys]), "sample")
    if texts.count() > sample:  # doc_ids that repeat with other texts
        few = texts.select("text").orderBy(F.xxhash64("text"), "text").limit(sample)
        texts = written(texts.join(F.broadcast(few), "text", "left_semi"), "sample")

    # of near copies one is kept, with the label that most of them have
    rows = sorted(texts.select("text", "minima", *ys).collect())
    minima = np.array([np.frombuffer(r["minima"], np.uint64) for r in rows], dtype=np.uint64).reshape(len(rows), 8)
    y = np.array([[np.nan if r[c] is None else r[c] for c in ys] for r in rows], dtype=np.float64).reshape(len(rows), len(names))
    family = families(minima)
    kept = np.flatnonzero(family == np.arange(len(rows)))
    for k in range(len(names)):
        known = np.flatnonzero(~np.isnan(y[:, k]))
        n, total = np.bincount(family[known], minlength=len(rows)), np.bincount(family[known], weights=y[known, k], minlength=len(rows))
        y[:, k] = np.where(n > 0, total * 2 >= np.maximum(n, 1), np.nan)
    y = y[kept]
    number = {rows[i]["text"]: j for j, i in enumerate(kept)}
    share = [float(np.nanmean(c)) if (~np.isnan(c)).any() else 0.0 for c in y.T]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [(number[t], np.frombuffer(f, np.uint64)) for t, f in zip(batch.column("text").to_pylist(), batch.column("features").to_pylist(), strict=True) if t in number]
            if mine:
                keys, at = np.unique(np.concatenate([f for _, f in mine]), return_inverse=True)
                row = np.repeat([i for i, _ in mine], [len(f) for _, f in mine])
                sums = [np.bincount(at, weights=w, minlength=len(keys)) for c in y.T for w in ((~np.isnan(c[row])).astype(float), np.nan_to_num(c[row]))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], ["feature", *(f"{a}{k}" for k in range(len(names)) for a in "np")])

    sums = texts.select("text", "features").mapInArrow(count, "feature long, " + ", ".join(f"n{k} double, p{k} double" for k in range(len(names))))
    sums = written(sums.groupBy("feature").agg(*[F.sum(c).alias(c) for c in sums.columns[1:]]).where(F.greatest(*[F.col(f"n{k}") for k in range(len(names))] * 2) >= least_docs), "features")
    keys = []
    for k, mean in enumerate(share):
        surprise = F.abs(F.col(f"p{k}") - F.col(f"n{k}") * mean) / F.sqrt(F.col(f"n{k}") * max(mean * (1 - mean), 1e-12))
        best = sums.where(F.col(f"n{k}") >= least_docs).select("feature", surprise.alias("s")).where("s > 3").orderBy(F.desc("s"), "feature").limit(most).collect()
        keys.append(np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [[np.flatnonzero(np.isin(k, np.frombuffer(f, np.uint64), assume_unique=True)).astype(np.int32).tobytes() for k in keys] for f in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("figures"), pa.array(at, pa.list_(pa.binary()))], ["text", "figures", "at"])

    rows = {r["text"]: r for r in texts.select("text", "figures", "features").mapInArrow(place, "text long, figures binary, at array<binary>").collect() if r["text"] in number}
    order = sorted(number, key=number.get)
    has = [[np.frombuffer(rows[t]["at"][k], np.int32).astype(np.int64) for t in order] for k in range(len(names))]
    figures = np.array([np.frombuffer(rows[t]["figures"], np.float64) for t in order]).reshape(len(order), 5)
    return Chain(names).fit(keys, has, figures, y, np.array([t % folds for t in order], dtype=np.int64), ridge)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category> for each category of the chain."""
    new = [f"p_{n}" for n in chain.names]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in new] + [T.StructField(n, T.DoubleType()) for n in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = chain.predict(*surface(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[: -len(new)]), *(pa.array(p[:, i]) for i in range(len(new)))], schema.names)

    return docs.mapInArrow(run, schema)


def chain_of(spark, sf_dir: str, docs: DataFrame) -> Chain:
    """The chain of the labels table: low quality first, then toxic."""
    labels = table(spark, sf_dir, "labels")
    return train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, chain_of(spark, sf_dir, docs))
    return out.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))
