"""Scores of whole pages, worked out by hand and against brute force."""

import itertools

import pytest

from foliometer.functions import text as t
from foliometer.functions.kernels import ratio
from foliometer.operators import scoring
from foliometer.plans import scored
from foliometer.plans.fixtures import coarse

COLUMNS = "doc_id long, ix long, type string, text string, " + scored.EXTRA.replace(", n_rows", ", n_rows")


def page(rows, **more):
    empty = {"cells": None, "n_rows": None, "n_cols": None, "header_rows": None, "ambiguities": None, "chart": None}
    return [{"doc_id": 1, "ix": i, "type": kind, "text": text, **empty, **more.get(f"at{i}", {})} for i, (kind, text) in enumerate(rows)]


GOLD = [("heading", "A title of some length"), ("paragraph", "first words stand here"), ("paragraph", "second words came later"), ("figure", None), ("figure", None), ("footer", "page 7 of the report")]
PRED = {
    "swapped": [("heading", "A title of some length"), ("paragraph", "second words came later"), ("paragraph", "first words stand here"), ("figure", None), ("paragraph", "page 7 of the report")],
    "lossy": [("paragraph", "A titel of some lenght"), ("paragraph", "zzzzzzzz"), ("header", "page 7 of teh report")],
    "nothing": [],
}


@pytest.fixture(scope="module")
def tracks(spark):
    gold = spark.createDataFrame(page(GOLD), COLUMNS)
    rows = [{"run": r, **b} for r, blocks in PRED.items() for b in page(blocks)]
    pred = spark.createDataFrame(rows, "run string, " + COLUMNS)
    pages = spark.createDataFrame([(r, 1) for r in PRED], "run string, doc_id long")
    return {n: {r["run"]: r for r in df.collect()} for n, df in scoring.track_scores(gold, pred, pages, coarse).items()}


def brute_pairs(blocks):
    """Pairs of the assignment of greatest total, by trying all; then the blocks without text in order."""
    g, p = ([(i, t.plain(x)) for i, (_, x) in enumerate(b) if x] for b in (GOLD, blocks))
    best, k = (-1.0, []), min(len(g), len(p))
    for chosen in itertools.permutations(range(len(g)), k):
        for others in itertools.combinations(range(len(p)), k):
            pairs = [(g[i][0], p[j][0], ratio(g[i][1], p[j][1])) for i, j in zip(chosen, others, strict=True)]
            best = max(best, (sum(s for *_, s in pairs), pairs), key=lambda x: x[0])
    bare = zip([i for i, (_, x) in enumerate(GOLD) if not x], [j for j, (_, x) in enumerate(blocks) if not x], strict=False)
    return sorted([(i, j) for i, j, s in best[1] if s >= 0.55] + list(bare))


def test_pairs(spark):
    gold = scoring.with_texts(spark.createDataFrame(page(GOLD), COLUMNS), coarse)
    rows = [{"run": r, **b} for r, blocks in PRED.items() for b in page(blocks)]
    pred = scoring.with_texts(spark.createDataFrame(rows, "run string, " + COLUMNS), coarse)
    got = scoring.pair_blocks(gold, pred).collect()
    for r, blocks in PRED.items():
        assert sorted((x["gold_ix"], x["pred_ix"]) for x in got if x["run"] == r) == (brute_pairs(blocks) if blocks else [])


def test_text(tracks):
    swapped, lossy, nothing = (tracks["text"][r] for r in PRED)
    assert swapped["cer"] > 0.3 and swapped["cer_aligned"] == 0 and swapped["order_penalty"] == swapped["cer"] and swapped["wer"] > 0.3
    assert lossy["cer"] == lossy["cer_aligned"] > 0.4 and lossy["block_similarity"] > 0.8
    assert (nothing["cer"], nothing["score"], nothing["pred_chars"]) == (1.0, 0.0, 0)


def test_structure_and_furniture(tracks):
    s = tracks["structure"]["swapped"]
    assert (s["block_precision"], s["block_recall"], s["type_coarse"], s["spurious"]) == (1.0, 0.8, 1.0, 0) and s["tau"] == pytest.approx((4 / 6 + 1) / 2)
    s = tracks["structure"]["lossy"]
    assert (s["block_precision"], s["block_recall"], s["type_coarse"], s["spurious"]) == (0.5, 0.2, 0.0, 1)
    assert tracks["structure"]["nothing"]["score"] == pytest.approx(1 / 3)
    assert {r: x["score"] for r, x in tracks["furniture"].items()} == {"swapped": 1.0, "lossy": 1.0, "nothing": 0.0}
    assert tracks["table"] == {} and tracks["chart_data"] == {}


def table(*lines, header=1):
    cells = [{"row": r, "col": c, "rowspan": 1, "colspan": 1, "text": x, "is_header": r < header} for r, line in enumerate(lines) for c, x in enumerate(line)]
    return {"cells": cells, "n_rows": len(lines), "n_cols": len(lines[0]), "header_rows": 1}


def test_tables_and_charts(spark):
    drawn = {"labels": ["Alpha", "beta", "gamma"], "n": 10, "by_class": {"a": 5, "b": 5}, "x": "time", "y": "size"}
    gold = page([("table", "h\ti\n1\t2"), ("table", "x\ty\n8\t9"), ("chart", None)], at0=table("hi", "12"), at1=table("xy", "89"), at2={"chart": drawn})
    pred = page([("table", None), ("chart", None)], at0=table("xy", "89", header=0), at1={"chart": {**drawn, "labels": ["ALPHA", "delta"], "n": 12, "by_class": {"a": 12}, "x": "time", "y": None}})
    pages = spark.createDataFrame([("r", 1), ("none", 1)], "run string, doc_id long")
    got = scoring.track_scores(spark.createDataFrame(gold, COLUMNS), spark.createDataFrame([{"run": "r", **b} for b in pred], "run string, " + COLUMNS), pages, coarse)
    found = got["tables"].collect()
    assert [(r["gold_ix"], r["pred_ix"], r["combined"], r["header_inferred"], r["variant"]) for r in found] == [(1, 0, 1.0, True, "as_encoded")]
    assert {r["run"]: (r["n_gold"], r["n_found"], r["score"]) for r in got["table"].collect()} == {"r": (2, 1, 0.5), "none": (2, 0, 0.0)}
    chart = {r["run"]: r for r in got["chart_data"].collect()}
    c = chart["r"]
    assert (c["labels_precision"], c["labels_recall"], c["missed"], c["spurious"]) == (0.5, pytest.approx(1 / 3), ["beta", "gamma"], ["delta"])
    assert (c["count"], c["histogram"], c["axes"]) == (0.5, 0.5, 0.5) and c["score"] == pytest.approx(0.55 * 0.4 + 0.15 * 1.5) and chart["none"]["score"] == 0


def test_only_what_is_wanted_is_compared(spark):
    """cer_aligned is worked out for the runs that want it, and the rest of the text track does not depend on it."""
    rows = [{"run": r, **b} for r, blocks in PRED.items() for b in page(blocks)]
    sides = scoring.with_texts(spark.createDataFrame(page(GOLD), COLUMNS), coarse), scoring.with_texts(spark.createDataFrame(rows, "run string, " + COLUMNS), coarse)
    texts = scoring.page_texts(*sides, spark.createDataFrame([(r, 1) for r in PRED], "run string, doc_id long"))
    every, some, none = ({r["run"]: r.asDict() for r in scoring.page_scores(texts, None, None, ["text", *more])["text"].collect()} for more in (["aligned"], ["aligned:swapped"], []))
    assert some["swapped"] == every["swapped"] and some["lossy"]["cer_aligned"] is None and "cer_aligned" not in none["lossy"]
    assert all(x[r]["cer"] == every[r]["cer"] and x[r]["score"] == every[r]["score"] for x in (some, none) for r in PRED)


def test_a_line_that_repeats_the_footer_does_not_take_its_place(spark):
    """Its text was paired with the footer, as it stood closer to the diagonal, and the footer's text counted as one too many."""
    end = "page 7 of the report"
    gold = page([("heading", "A title"), ("paragraph", "first words stand here"), ("paragraph", end), ("footer", end)])
    pred = {"merged": [("heading", "A title"), ("paragraph", "first words stand here " + end), ("footer", end)], "moved": [("footer", end), ("heading", "A title"), ("paragraph", end), ("paragraph", "first words stand here")]}
    rows = [{"run": r, **b} for r, blocks in pred.items() for b in page(blocks)]
    sides = spark.createDataFrame(gold, COLUMNS), spark.createDataFrame(rows, "run string, " + COLUMNS)
    got = scoring.pair_blocks(*(scoring.with_texts(x, coarse) for x in sides)).collect()
    assert {(r["run"], r["pred_ix"]) for r in got if r["gold_ix"] == 3} == {("merged", 2), ("moved", 0)}
    by = scoring.track_scores(*sides, spark.createDataFrame([(r, 1) for r in pred], "run string, doc_id long"), coarse)
    assert {r["run"]: r["score"] for r in by["text"].collect()}["merged"] == 1.0


def test_table_and_chart_stand_below_a_page_of_many_lines(spark, tmp_path):
    """From 416 lines on the table, and from 500 on the chart, came before the last lines from top to bottom."""
    text = chr(10).join(f"line {k}" for k in range(650))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tables = spark.createDataFrame([(1, "a")], "doc_id long, body string")
    pages = scored.gold_pages(spark, str(tmp_path), tables, spark.createDataFrame([(1,)], "doc_id long"))
    got = pages.select("blocks", scored.predicted_blocks("y_sorted").alias("p")).first()
    assert len(got["p"]) == 652 and [x["text"] for x in got["p"]] == [x["text"] for x in got["blocks"]]
