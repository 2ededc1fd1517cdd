"""Goldens of operators, mutations that quality rules have to catch, calibration of the metrics, sources and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from foliometer.operators import alignment, degrade, grid, html_table, layout, quality, sets, tracks
from foliometer.plans import registry, texts
from foliometer.sources import ir
from foliometer.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_set_and_bag_agreement(spark):
    gold = spark.createDataFrame([(1, x) for x in "abc"] + [(2, "x")], "k int, v string")
    pred = spark.createDataFrame([(1, x) for x in "bcd"] + [(3, "x")], "k int, v string")
    got = {r["k"]: (r["tp"], r["fp"], r["fn"], round(r["f1"], 6)) for r in sets.set_prf(gold, pred, ["k"], "v").collect()}
    assert got == {1: (2, 1, 1, 0.666667), 2: (0, 0, 1, 0.0), 3: (0, 1, 0, 0.0)}
    bag = sets.bag_f1(spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string"), spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], ["v"]).first()
    assert (bag["precision"], bag["recall"]) == (1.0, 0.5)
    h = sets.histogram_similarity(spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "k int, b string, n int"), spark.createDataFrame([(1, "a", 2)], "k int, b string, n int"), ["k"], "b", "n").first()
    assert h["similarity"] == 0.5


def test_tau(spark):
    pairs = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 1), (2, 5, 5)], "k int, gold_ix long, pred_ix long")
    assert {r["k"]: round(r["tau"], 6) for r in alignment.reading_order_tau(pairs, ["k"]).collect()} == {1: 0.666667, 2: 1.0}


def test_assignment_drops_after_the_optimum(spark):
    blocks = lambda xs: spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, ix long, norm string")
    got = alignment.assign_blocks(blocks(["abcd", "wxyz"]), blocks(["wxyz", "abce", "q"]), ["k"]).collect()
    assert sorted((r["gold_ix"], r["pred_ix"], r["sim"]) for r in got) == [(0, 1, 0.75), (1, 0, 1.0)]


def test_grid(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 1, "A", False), (1, 0, 1, 1, 2, "B", False), (1, 1, 1, 1, 1, "c", False), (1, 1, 2, 1, 1, "d", False)], "k int, row int, col int, rowspan int, colspan int, text string, is_header boolean")
    assert [r["text"] for r in grid.expand_grid(cells, ["k"]).orderBy("r", "c").collect()] == list("ABBAcd")
    same = grid.grits(cells, cells, ["k"]).first()
    assert (same["grits_con"], same["grits_top"]) == (1.0, 1.0)
    g = [[("a", 1, 1, False), ("b", 1, 1, False)], [("c", 1, 1, False), ("d", 1, 1, False)]]
    assert grid.grid_similarity(g, [[("a", 1, 1, False), ("b", 1, 1, False)]])[0] <= 4 / 6 and grid.grid_similarity(g, []) == (0.0, 0.0)
    flat = degrade.dropped_na_cells(spark.createDataFrame([(1, 0, 0, 1, 1, "x", False), (1, 0, 1, 1, 1, "N/A", False), (1, 0, 2, 1, 1, "y", False)], cells.schema), ["k"], 0)
    assert [(r["text"], r["col"]) for r in flat.orderBy("col").collect()] == [("x", 0), ("y", 1)]


def test_html_cells():
    got = html_table.cells_of("<table><tr><td rowspan=2>A</td><td>b<br>c &amp;</td></tr><tr><td colspan=0>d</td></tr></table>")
    assert [(c["row"], c["col"], c["rowspan"], c["text"]) for c in got] == [(0, 0, 2, "A"), (0, 1, 1, "b c &"), (1, 1, 1, "d")]
    assert html_table.cells_of("<p>x</p>") is None and html_table.cells_of("<tr><td>outside</td></tr>") is None and html_table.cells_of(None) is None
    spans = html_table.cells_of('<table><tr><td rowspan="²">a</td><td rowspan=-3 colspan=3000000>b</td></tr><tr><td>open</tr><tr><td>c</td></tr></table>')
    assert [(c["row"], c["col"], c["rowspan"], c["colspan"]) for c in spans] == [(0, 0, 1, 1), (0, 1, 1, html_table.MOST), (2, 0, 1, 1)]
    wide = html_table.cells_of("<table><tr><td>a</td><td rowspan=3 colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td colspan=2>e</td><td>f</td></tr></table>")
    assert [(c["text"], c["row"], c["col"]) for c in wide] == [("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 3), ("e", 2, 0), ("f", 2, 3)]


def test_header_rows_end_at_a_row_without_cells(spark):
    html = ["<table><tr><th rowspan=2>a</th><th rowspan=2>b</th></tr><tr></tr><tr><td>c</td></tr></table>", "<table><tr><th>a</th></tr><tr><th>b</th></tr><tr><td>c</td></tr></table>", "<table><tr><th>a</th></tr></table>", "<table><tr></tr></table>", "x"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(html)], "k int, html string").select("k", html_table.html_cells("html").alias("cells"))
    assert [r["n"] for r in rows.select("k", html_table.header_rows(F.col("cells")).alias("n")).orderBy("k").collect()] == [1, 2, 1, 0, 0]


def test_grid_has_the_declared_shape(spark):
    schema = "k int, pos int, row int, col int, rowspan int, colspan int, text string, is_header boolean"
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 1, "a", True), (1, 1, 0, 2, 9, 9, "b", False), (1, 2, 1, 2, 1, 1, "late", False), (1, 3, 1, 1, 1, 2, "last", False)], schema)
    shape = spark.createDataFrame([(1, 2, 3)], "k int, n_rows int, n_cols int")
    got = grid.expand_grid(cells, ["k"], shape)
    assert [r["text"] for r in got.orderBy("r", "c").collect()] == ["a", "", "b", "", "last", "last"]
    assert [r["line_text"] for r in grid.line_texts(got, ["k"], "r").orderBy("r").collect()] == ["a |  | b", " | last | last"]
    read = [{**r.asDict(), "norm": r["text"]} for r in cells.orderBy("pos").collect()]
    assert [[c[0] for c in line] for line in grid.grid_of(read, 2, 3)] == [["a", "", "b"], ["", "last", "last"]]
    with pytest.raises(Exception, match="two cells at row 0, column 0"):
        grid.fill_gaps(cells.unionByName(cells.where("pos = 0")), ["k"], shape).collect()


def test_readings_need_a_declared_alternative(spark):
    cells = spark.createDataFrame([(k, r, c, 1, 1, x, True) for k in (1, 2) for r, c, x in ((0, 0, ""), (1, 0, "label"), (1, 1, "other"))], "k int, row int, col int, rowspan int, colspan int, text string, is_header boolean")
    known = spark.createDataFrame([(1, 1, ["row0/col0", "nowhere"], "label with rowspan=2"), (2, 1, ["row0/col0"], "left out")], "k int, reading int, cells array<string>, accepted_alternative string")
    got = {(r["k"], r["variant"], r["row"], r["rowspan"], r["text"]) for r in grid.ambiguity_variants(cells, known, ["k"]).where("reading = 1").collect()}
    assert got == {(1, "rowspan2_alternative", 0, 2, "label"), (1, "rowspan2_alternative", 1, 1, "other")}


def test_composite(spark):
    scores = spark.createDataFrame([(1, "p", "text", 0.8), (1, "p", "structure", 0.6), (2, "none", "text", 0.8), (3, "p", "table", None)], "page int, profile string, track string, score double")
    weights = spark.createDataFrame([("p", "table", 0.65), ("p", "text", 0.15), ("p", "structure", 0.2)], "profile string, track string, weight double")
    assert {r["page"]: round(r["composite"], 6) for r in tracks.composite(scores, weights, ["page"]).collect()} == {1: 0.685714, 2: 0.0}


def test_degradations_move_their_own_metric(spark):
    """A perfect prediction scores 1; noise lowers text accuracy, and nothing else does."""
    sim = texts.text_pairs(spark, SF).select(F.avg((F.col("g") != F.col("p")).cast("int")).alias("changed")).first()["changed"]
    assert sim > 0.3
    acc = registry.QUERIES["text_accuracy"](spark, SF).agg(F.avg("accuracy")).first()[0]
    assert 0.9 < acc < 0.99
    tau = registry.QUERIES["reading_order_tau"](spark, SF).agg(F.min("tau"), F.max("tau")).first()
    assert tau[0] >= 0 and tau[1] == 1.0
    grits = registry.QUERIES["grits"](spark, SF).agg(F.avg("grits_con"), F.max("grits_con")).first()
    assert 0.8 < grits[0] < 1 and grits[1] == 1.0


FAULTS = {
    "duplicate_id": {"id": "p.b01"}, "unknown_type": {"type": "blob"}, "reading_order": {"reading_order": 9}, "bad_id": {"id": "q"}, "bbox": {"x1": 5000.0}, "list_items": {"type": "list", "items": ["other"]}, "caption_for": {"caption_for": "nowhere"}, "no_text": {"text": ""},
}


@pytest.mark.parametrize("rule", FAULTS)
def test_every_rule_catches_its_mutation(spark, rule):
    schema = "page_id string, id string, block_ix long, reading_order long, type string, text string, x0 double, y0 double, x1 double, y1 double, items array<string>, caption_for string"
    page = [{"page_id": "p", "id": f"p.b{i + 1:02d}", "block_ix": i, "reading_order": i + 1, "type": "paragraph", "text": "t", "x0": 1.0, "y0": 1.0 + i, "x1": 9.0, "y1": 2.0 + i, "items": None, "caption_for": None} for i in range(4)]
    quality.assert_clean(quality.violations(spark.createDataFrame(page, schema), 100, 100))
    page[2] |= FAULTS[rule]
    found = quality.violations(spark.createDataFrame(page, schema), 100, 100)
    assert rule in {r["rule"] for r in found.collect()}
    with pytest.raises(ValueError, match=rule):
        quality.assert_clean(found)


def test_layout_folds(spark):
    lines = spark.createDataFrame([(1, 0, "paragraph", 10.0, "a", 0.0, 0.0, 50.0, 10.0), (1, 1, "paragraph", 10.0, " b ", 0.0, 12.0, 50.0, 22.0), (1, 2, "paragraph", 10.0, "far", 0.0, 60.0, 50.0, 70.0), (1, 3, "heading", 10.0, "h", 0.0, 71.0, 50.0, 80.0)], "k int, ix long, kind string, base double, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r["type"], r["text"]) for r in layout.group_paragraphs(lines, ["k"]).orderBy("block_ix").collect()] == [("paragraph", "a b"), ("paragraph", "far"), ("heading", "h")]


def pages():
    return [{"page_id": f"p{i}", "blocks": [{"id": f"p{i}.b01", "type": "heading", "text": "Grün", "bbox": [0, 0, 1, 1]}, {"type": "figure", "bbox": [0, 0, 1, 1]}]} for i in range(3)]


def test_json_sources_and_stream(spark, tmp_path):
    folder = tmp_path / "run"
    folder.mkdir()
    for p in pages():
        (folder / f"{p['page_id']}.json").write_text(json.dumps(p, indent=1))
    run = ir.scan_pages(spark, str(folder), "r")
    assert [(r["page_id"], r["block_ix"], r["text"]) for r in ir.blocks(run, "run").where("block_ix = 0").orderBy("page_id").collect()] == [(f"p{i}", 0, "Grün") for i in range(3)]
    both, missing = ir.joined(run, run.where("page_id <> 'p2'"))
    assert both.count() == 2 and [r[0] for r in missing.collect()] == ["p2.json"]
    with pytest.raises(Exception, match="mismatch"):
        ir.joined(run, run.withColumn("page_id", F.lit("x")))[0].collect()
    ir.write_json(run.select("page_id"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    stream = incremental.block_counts(incremental.first_arrivals(incremental.page_stream(spark, str(folder))))
    for _ in range(2):
        incremental.run_once(stream, str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "counts")).collect())) == [(f"p{i}", 2, 1) for i in range(3)]
