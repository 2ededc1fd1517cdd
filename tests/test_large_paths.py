"""The shorter ways of pairing, aligning and building tables, against the plain ones."""

import itertools
import random
import time

import numpy as np
from pyspark.sql import functions as F

from foliometer.functions import kernels
from foliometer.functions.kernels import align, align_texts, assign, common_length, common_lengths, ratio
from foliometer.operators import alignment
from foliometer.plans import tables
from foliometer.plans.fixtures import gold_cells, gold_tables

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 7))) for _ in range(n)]


def test_pairs_have_the_greatest_total():
    rng = random.Random(1)
    for _ in range(300):
        a, b = words(rng, rng.randint(1, 6)), words(rng, rng.randint(1, 6))
        s = alignment.similarity_matrix(a, b)
        got = alignment.pair_texts(a, b)
        assert all(sim == s[i, j] for i, j, sim in got) and len({i for i, *_ in got}) == len({j for _, j, _ in got}) == min(len(a), len(b))
        assert abs(sum(sim for *_, sim in got) - sum(s[i, j] for i, j in assign(s))) < 1e-6
    assert alignment.pair_texts(a, a) == [(i, i, 1.0) for i in range(len(a))]


def test_alignment_between_equal_ends():
    rng = random.Random(2)
    alike = lambda x, y: 1.0 if x == y else ratio(x, y)
    for _ in range(300):
        a, b = words(rng, rng.randint(0, 6)), words(rng, rng.randint(0, 6))
        b = a[:2] + b + a[3:] if rng.random() < 0.7 else b
        assert align_texts(a, b, alike, 0.35) == align(len(a), len(b), lambda i, j: alike(a[i], b[j]), 0.35)


def test_common_length_between_equal_ends():
    rng = random.Random(3)
    for _ in range(300):
        a, b = words(rng, 2)
        t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i, j] = t[i - 1, j - 1] + 1 if x == y else max(t[i - 1, j], t[i, j - 1])
        assert common_length(a, b) == t[-1, -1]


def test_tables_are_the_cells(spark):
    cells = gold_cells(spark, SF)
    built = gold_tables(spark, SF).select("table_id", F.inline("cells")).select(*cells.columns)
    assert cells.exceptAll(built).count() == 0 == built.exceptAll(cells).count()


def noisy_copy(rng, text):
    out = [rng.choice("abcdefgh é") if rng.random() < 0.03 else c for c in text]
    if rng.random() < 0.5:
        del out[rng.randrange(len(out))]
    return "".join(out)


def test_common_lengths_are_those_of_single_pairs():
    rng = random.Random(4)
    a = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(24, 900))) for _ in range(120)]
    pairs = [(x, noisy_copy(rng, x)) for x in a] + [(x, noisy_copy(rng, x[40:] + x[:40])) for x in a[:40]] + [("", "a"), ("ab" * 30, "ba" * 30)] * 5
    assert common_lengths(pairs) == [common_length(x, y) for x, y in pairs]


def test_pages_are_paired_as_each_alone(spark):
    rng = random.Random(5)
    pages = []
    for _ in range(60):
        a = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 7))]
        b = [noisy_copy(rng, x) if x else x for x in a]
        rng.shuffle(b)
        pages.append((a, b[: rng.randint(1, len(b))] if rng.random() < 0.5 else b))
    for (a, b), got in zip(pages, alignment.pair_pages(pages), strict=True):
        s = alignment.similarity_matrix(a, b)
        assert abs(sum(sim for *_, sim in got) - sum(s[i, j] for i, j in assign(s))) < 1e-6 and all(sim == s[i, j] for i, j, sim in got)
    rows = [(k, list(range(len(a))), a, [10 + j for j in range(len(b))], b) for k, (a, b) in enumerate(pages)]
    got = alignment.assign_pages(spark.createDataFrame(rows, "k int, g_ix array<long>, g array<string>, p_ix array<long>, p array<string>"), ["k"], 0.5).collect()
    want = {(k, i, 10 + j) for k, found in enumerate(alignment.pair_pages(pages, 0.5)) for i, j, _ in found}
    assert {(r["k"], r["gold_ix"], r["pred_ix"]) for r in got} == want


def test_table_pairing_reads_items_once(spark):
    """A row of a cell each went through windows and shuffles before."""
    plan = tables.table_pairing(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "CoGroup" not in plan.replace("FlatMapCoGroups", "CoGroup")


def test_assignment_of_a_large_page_is_quick_and_best():
    rng = np.random.default_rng(6)
    for n, m in ((4, 4), (3, 5), (5, 3), (6, 6)):
        for _ in range(40):
            s = np.round(rng.random((n, m)), 1)
            best = max(sum(s[i, j] if n <= m else s[j, i] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
            assert abs(sum(s[i, j] for i, j in assign(s)) - best) < 1e-6
    s = rng.random((900, 900)) * 0.5 + np.eye(900) * 0.5
    began = time.process_time()
    assert assign(s) == [(i, i) for i in range(900)] and time.process_time() - began < 1.0


def test_columns_are_those_of_the_shorter_text(monkeypatch):
    """Merged paragraphs: many lines are compared with one long text, whose masks are made once, and a step is taken for each character of the line."""
    made, masks = [], kernels._masks
    monkeypatch.setattr(kernels, "_masks", lambda a: made.append(len(a)) or masks(a))
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(200)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    lines, merged = [line(12) + "?" for _ in range(40)], line(150)
    got = common_lengths([(x, merged) for x in lines])
    assert made == [len(merged)]
    assert got == [common_length(x, merged) for x in lines] == [common_length(merged, x) for x in lines]
    made.clear()
    kernels.edit_distance(merged, "?" + lines[0]), kernels.edit_distance("?" + lines[0], merged)
    assert made == [len(merged)] * 2
