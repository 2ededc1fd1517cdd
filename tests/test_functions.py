"""Hand-computed values of text functions and kernels, and kernels against exhaustive search."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliometer.functions import kernels
from foliometer.functions import text as t


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("level,given_,want", [("L0", " a  b ", "a b"), ("L1", "“ﬁ² — x…”", '"fi2 - x..."'), ("L1", "• item", "item"), ("L2", "Straße", "strasse"), ("L1", None, ""), ("L0", "é", "é"), ("L1", "a  b", "a b")])
def test_normalize(spark, level, given_, want):
    assert value(spark, t.normalize(F.lit(given_).cast("string"), level)) == want


def test_unknown_level():
    with pytest.raises(ValueError, match="unknown level"):
        t.normalize(None, "L3")


@pytest.mark.parametrize("given_,want", [("-----", ""), ("—", ""), ("- –", ""), ("1,234", "1,234"), ("", "")])
def test_norm_cell(spark, given_, want):
    assert value(spark, t.norm_cell(F.lit(given_))) == want


@pytest.mark.parametrize("g,p,want", [("", "", 0.0), ("", "x", 1.0), ("abc", "", 1.0), ("ab", "xyzw", 2.0)])
def test_cer(spark, g, p, want):
    assert value(spark, t.cer(F.lit(g), F.lit(p))) == want


def test_wer_similarity_accuracy(spark):
    assert value(spark, t.wer(F.lit("a b c"), F.lit("a x c"))) == pytest.approx(1 / 3)
    assert value(spark, t.similarity(F.lit("abc"), F.lit("abd"))) == pytest.approx(2 / 3)
    assert value(spark, t.similarity(F.lit("ab"), F.lit("ba"))) == 0.5 and value(spark, t.similarity(F.lit(""), F.lit(""))) == 1.0
    assert value(spark, t.accuracy(F.lit(2.0))) == 0.0
    got = [value(spark, t.count_accuracy(F.lit(g), F.lit(p))) for g, p in ((10, 11), (10, 12), (10, 13), (53, 0), (0, 0), (0, 1))]
    assert got == pytest.approx([1, 0.5, 0, 0, 1, 0], abs=1e-9)
    assert value(spark, t.fmt3(F.lit(None).cast("double"))) == "—" and value(spark, t.fmt3(F.lit(0.5))) == "0.500"


@given(st.text("abc", max_size=70), st.text("abc", max_size=70))
@settings(max_examples=150, deadline=None)
def test_bit_parallel_kernels(a, b):
    edit, common = {}, {}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if not i or not j:
            edit[i, j], common[i, j] = i + j, 0
        else:
            same = a[i - 1] == b[j - 1]
            edit[i, j] = min(edit[i - 1, j] + 1, edit[i, j - 1] + 1, edit[i - 1, j - 1] + (not same))
            common[i, j] = common[i - 1, j - 1] + 1 if same else max(common[i - 1, j], common[i, j - 1])
    assert kernels.edit_distance(a, b) == edit[len(a), len(b)] and kernels.common_length(a, b) == common[len(a), len(b)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        s = rng.random((n, m)).round(1)
        pairs = kernels.assign(s)
        small, large = min(n, m), max(n, m)
        view = s if n <= m else s.T
        best = max(sum(view[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(pairs) == small == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert sum(s[i, j] for i, j in pairs) == pytest.approx(best)
    assert kernels.assign(np.array([[0.9, 0.8], [0.8, 0.1]])) == [(0, 1), (1, 0)] and kernels.assign(np.ones((3, 3))) == [(0, 0), (1, 1), (2, 2)]


def test_align():
    assert kernels.align(2, 1, lambda i, j: 1.0, 0.35) == [(1, 0)]
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = rng.random((4, 4))
        got = kernels.align(4, 4, lambda i, j, s=s: s[i, j], 0.35)
        best = max(sum(s[i, j] for i, j in zip(a, b, strict=True) if s[i, j] >= 0.35) for k in range(5) for a in itertools.combinations(range(4), k) for b in itertools.combinations(range(4), k))
        assert sum(s[i, j] for i, j in got) == pytest.approx(best)


def test_fmt3_rounds_the_exact_value(spark):
    values = [0.0625, 0.1875, 25.0625, -48574.8125, 1.0005, 2.0005, -0.0001, 83760850404204.62, 1e23, float("inf"), None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", t.fmt3(F.col("v")).alias("out")).collect()
    assert [r["out"] for r in sorted(got, key=lambda r: r["i"])] == ["—" if v is None else f"{v:.3f}" for v in values]


def test_distances_by_pieces():
    import random

    draw, pairs = random.Random(3), []
    for _ in range(400):
        words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(draw.choice([2, 8, 60]))]
        x = " ".join(draw.choices(words, k=draw.randint(14, 120)))
        y = list(x)
        for _ in range(draw.choice([0, 1, 2, 5, 12, 30])):
            k, n = draw.choice([0, len(y) - 1, draw.randrange(len(y))]), draw.randint(1, 12)
            y[k : k + draw.choice([0, 1, 1, 1, n])] = draw.choices("abc é", k=draw.choice([0, 1, 1, 1, n])) or ["z"]
        pairs.append((x, "".join(y)))
    assert kernels.edit_distances(pairs) == [kernels.edit_distance(*p) for p in pairs]
    long = [p for p in pairs if min(map(len, p)) >= 64]
    assert [(len(a) + len(b) - n) // 2 for (a, b), n in zip(long, kernels._by_pieces(long, True), strict=True)] == [kernels.common_length(*p) for p in long]


def test_long_noisy_texts_take_little_time():
    import random
    import time

    draw = random.Random(4)
    x = "".join(draw.choices("abcdefghij klmno", k=200_000))
    y = "".join(draw.choice("xyz") if draw.random() < 0.02 else c for c in x)
    began = time.process_time()
    assert kernels.edit_distances([(x, y)])[0] <= sum(a != b for a, b in zip(x, y, strict=True))
    assert time.process_time() - began < 8  # bit-parallel over the whole of it takes several times that
