"""The kernels in the JVM against those in Python."""

import random

from pyspark.sql import functions as F

from foliometer.functions import jvm
from foliometer.functions import text as t
from foliometer.functions.kernels import edit_distance
from foliometer.operators import scoring
from foliometer.operators.alignment import pair_pages, tau_of
from foliometer.operators.degrade import ALPHABET, noise
from foliometer.plans import scored

LETTERS = "abcdéefg   ﬁ”• \u0085日😀é"


def changed(rng, text):
    text = "".join(rng.choice("abz ") if rng.random() < rng.choice([0.02, 0.3]) else c for c in text)
    text = text[len(text) // 2 :] + text[: len(text) // 2] if rng.random() < 0.3 else text
    return text[rng.randint(0, 70) :] if rng.random() < 0.3 else text


def test_errors(spark):
    rng = random.Random(1)
    rows = [("", ""), ("", "a"), ("a", ""), (" ", " ")]
    for n in [1, 2, 5, 63, 64, 65, 127, 128, 129, 200, 1000, 5000] * 8:
        a = "".join(rng.choice(LETTERS) for _ in range(n))
        rows.append((a, changed(rng, a)))
    wide = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(3000))  # most characters too rare for a row of masks
    rows.append((wide, changed(rng, wide[1500:] + wide[:1500])))
    jvm.kernels(spark)
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", jvm.call("plain", F.col("a")).alias("plain"), jvm.call("errors", F.col("a"), F.col("b"), F.col("a"), F.lit(True)).alias("e")).collect()
    for r in got:
        g, p = t.plain(r["a"]), t.plain(r["b"])
        assert r["plain"] == g and r["e"] == [edit_distance(g, p), 0, len(g), len(p), edit_distance(g.split(), p.split()), len(g.split()), len(p.split())]


def test_pairs(spark):
    rng, pages = random.Random(2), []
    for k in range(400):
        a = ["".join(rng.choice(LETTERS if k % 2 else "ab ") for _ in range(rng.randint(0, 6 if k % 3 else 150))) for _ in range(rng.randint(1, 9))]
        b = [changed(rng, x) if rng.random() < 0.5 else x for x in a] + a[: rng.randint(0, 2)]
        rng.shuffle(b)
        b = b[: rng.randint(1, len(b))] if rng.random() < 0.5 else [" ".join(b[:3]), *b[3:]]
        pages.append((k, a, b, *([rng.choice(["text", "list", "furniture"]) for _ in x] for x in (a, b))))
    jvm.kernels(spark)
    got = spark.createDataFrame(pages, "k int, a array<string>, b array<string>, c array<string>, d array<string>").select("k", jvm.call("pairs", *map(F.col, "abcd"), F.lit(0.3)).alias("p")).collect()
    want = pair_pages([([t.plain(x) for x in a], [t.plain(x) for x in b]) for _, a, b, _, _ in pages], 0.3, [(c, d) for *_, c, d in pages])
    assert {r["k"]: r["p"] for r in got} == {k: [float(v) for x in found for v in x] for k, found in enumerate(want)}


def test_tau_and_noise(spark):
    rng = random.Random(3)
    jvm.kernels(spark)
    rows = [([rng.randint(0, 9) for _ in range(n)], ["".join(rng.choice(LETTERS) for _ in range(300)), None, ""], [rng.randint(0, 2**32 - 1) for _ in range(3)]) for n in range(40)]
    df = spark.createDataFrame(rows, "p array<int>, x array<string>, s array<bigint>")
    for r in df.select("x", "s", tau_of("p").alias("want"), jvm.call("tau", F.col("p")).alias("tau"), jvm.call("noise", F.col("x"), F.col("s"), F.lit(50), F.lit(ALPHABET)).alias("noisy")).collect():
        assert r["tau"] == r["want"] and r["noisy"] == list(noise(r["x"], r["s"]))


def test_no_page_waits_for_python(spark):
    """Rows of whole pages were kept in queues, also on disk, for as long as Python had their texts."""
    sf = "/root/testdata/sf0.001"
    frames = scored.gold_page_tables(spark, sf), scored.gold_page_charts(spark, sf)
    texts = scored._texts(scored.gold_pages(spark, sf, *frames), scored.RUNS)
    plan = scoring._measured(texts, [*scoring.ALL])._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInPandas" not in plan


def test_runs_that_read_the_same_are_scored_once(spark):
    """Six of ten runs have the texts of gold as they are, and six its tables; each was laid out and compared for itself."""
    assert scored._readings(scored.RUNS, scored.IN_TEXTS)["perfect"] == [r for r in scored.RUNS if r not in scored.IN_TEXTS]
    sf = "/root/testdata/sf0.001"
    by = scored.scored(spark, sf, ["dropped_na_cells", "merged_paragraphs", "perfect"], ("text", "tables", "table"))
    alone = {r: scored.scored(spark, sf, [r], ("text", "tables", "table")) for r in ("dropped_na_cells", "merged_paragraphs", "perfect")}
    for name in ("text", "tables", "table"):
        want = [str(x) for r in alone for x in alone[r][name].select(*by[name].columns).collect()]
        assert sorted(want) == sorted(str(x) for x in by[name].collect())
