"""The pipeline's second stage: exact similarity of near copies."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from foliometer.llm import nearcopies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))}


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def kept_of(rows):
    """doc_id of each group's row, by comparison of all pairs."""
    own = {d: shingles(t) for d, t in rows}
    low = {d: d for d in own}
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                if low[a] != low[b] and similar(own[a], own[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return set(low.values())


def near_copies():
    """Texts with copies that have a few words changed, on both sides of a similarity of 0.8, and a group that only a chain holds together."""
    rnd, out = random.Random(11), []
    for n in (6, 30, 90, 250, 600):
        base = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            copy = list(base)
            for k in rnd.sample(range(n), max(1, int(share * n))):
                copy[k] = f"x{rnd.randrange(5000)}"
            out.append(" ".join(copy))
            base = copy if share == 0.01 else base
    return out


def test_near_copies_of_similarity_above_the_limit_go(spark):
    texts = near_copies() + ["", None, "one", "One", "one two"]
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()]
    assert sorted(got) == sorted(kept_of(rows)) and len(got) < len(rows)


def test_stage_on_a_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()]
    assert sorted(got) == sorted(kept_of(rows))


def test_large_keys_are_compared_like_small_ones():
    rnd = random.Random(4)
    sets = [set(rnd.sample(range(60), 40)) for _ in range(30)]
    ok = lambda a, b: len(sets[a] & sets[b]) >= 0.55 * len(sets[a] | sets[b])
    place, band = np.arange(30, dtype=np.uint64), np.full(30, 1 << 63, dtype=np.uint64)
    ends = [nearcopies.key_links(band, place, place, 4, ok, few=f) for f in (1, 64)]
    assert len(ends[0][0]) and all(sorted(zip(*(x.tolist() for x in e), strict=True)) == sorted(zip(*(x.tolist() for x in ends[0]), strict=True)) for e in ends)


def test_sets_have_each_shingle_once():
    _, h, first = nearcopies.shingle_sets(pa.array(["a a a a a a a a", None, "b", "A a a a a"]), 5)
    assert np.diff(first).tolist() == [1, 0, 1, 1] and h[0] == h[2]


def test_rows_of_null_and_repeated_ids_stay_with_their_own_group(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{rnd.randrange(9000)}" for _ in range(n))
    a, b, c, d, e, f = (text(60) for _ in range(6))
    rows = [(None, a), (None, b), (None, b + " end"), (None, c), (7, None), (7, d), (7, d), (7, d + " end"), (7, e), (8, e), (9, f), (3, f), (3, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()]
    assert {(i, t.removesuffix(" end") if t else t) for i, t in got} == {(3, a), (None, b), (None, c), (7, None), (7, d), (7, e), (3, f)} and len(got) == 7
