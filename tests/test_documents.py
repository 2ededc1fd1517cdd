"""Native documents on small cases worked out by hand."""

from foliometer.operators import documents, quality


def block(kind, top=0.0, content=None, html=None, blocks=None, lines=True):
    spans = [{"spans": [{"content": content, "html": html}]}, {"spans": None}] if lines else None
    return {"type": kind, "bbox": [0.0, top, 5.0, top + 1], "lines": spans, "blocks": blocks}


def page(spark, **sides):
    schema = "k int, " + ", ".join(f"{c} array<{documents.NESTED}>" for c in ("para_blocks", "preproc_blocks", "discarded_blocks"))
    return spark.createDataFrame([{"k": 1, "para_blocks": None, "preproc_blocks": None, "discarded_blocks": None} | sides], schema)


def test_tables_of_nested_blocks(spark):
    html = "<table><tr><th>a</th></tr><tr><td>b</td></tr></table>"
    inner = [block("table_caption", content="Cap"), block("table_body", html=html), block("table_footnote", content="note")]
    blocks = [block("table", blocks=inner, lines=False), block("table", content="as  it stands"), block("table", html="<tbody>"), block("image"), block("text", content=" "), block("text", content="a \n b"), block("odd", blocks=[block("text", content="in")], content="own")]
    got = documents.convert(page(spark, para_blocks=blocks), ["k"], "para_blocks").orderBy("ix").collect()
    assert [(r["ix"], r["type"], r["text"], r["caption"]) for r in got] == [(0, "table", None, "Cap note"), (1, "paragraph", "as  it stands", None), (3, "figure", None, None), (5, "paragraph", "a b", None), (6, "paragraph", "in own", None)]
    assert got[0]["structure"]["header_rows"] == 1 and [c["text"] for c in got[0]["structure"]["cells"]] == ["a", "b"]


def test_page_falls_back_and_takes_furniture_in(spark):
    sides = {"para_blocks": [], "preproc_blocks": [block("title", 100.0, "t"), block("text", 50.0, "x")], "discarded_blocks": [block("discarded", 500.0, "f"), block("discarded", 60.0, "h"), block("discarded", 1.0, "")]}
    got = documents.convert_page(page(spark, **sides), ["k"]).orderBy("position").collect()
    # one block has a smaller top than h, so it stands second; what comes later keeps its order
    assert [(r["position"], r["type"], r["text"]) for r in got] == [(0, "heading", "t"), (1, "header", "h"), (2, "paragraph", "x"), (3, "footer", "f")]
    assert not documents.convert_page(page(spark), ["k"]).collect()


def test_skipped_texts(spark):
    texts = spark.createDataFrame([(1, 0, "TEXT", "body"), (1, 1, "Page_Header", " top  line "), (1, 2, "page_footer", "foot"), (1, 3, "text", "seen"), (1, 4, "text", "  "), (1, 5, "text", None)], "p int, ix int, label string, text string")
    body = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "p int, ix int")
    assert sorted((r["ix"], r["part"], r["text"]) for r in documents.skipped(texts, body, ["p", "ix"]).collect()) == [(1, "header", "top line"), (2, "footer", "foot"), (3, "ocr", "seen")]


def test_page_rules(spark):
    schema = "page_id string, block_ix long, id string, type string, tracks array<string>, items array<string>, has_chart boolean, has_figure boolean"
    clean = [("p", 0, "a", "list", ["text"], ["x"], None, None), ("p", 1, "b", "chart", ["text", "chart_data"], None, True, None), ("p", 2, "c", "figure", [], None, None, True)]
    faulty = [("q", 0, "a", "list", ["hue"], [], None, None), ("q", 1, "b", "chart", ["text"], None, None, None), ("q", 2, "c", "figure", None, None, None, False), ("q", 3, "d", "list", ["text"], None, None, None)]
    blocks = spark.createDataFrame(clean + faulty, schema)
    pages = spark.createDataFrame([("p", ["a", "b", "c"]), ("q", ["b", "a", "c", "d"]), ("empty", [])], "page_id string, reading_order array<string>")
    tracks = spark.createDataFrame([("p", "text", True, 2), ("p", "table", True, 0), ("q", "hue", False, 9), ("q", "text", True, 3), ("q", "table", True, None)], "page_id string, track string, applicable boolean, n_blocks long")
    found = quality.payload_violations(blocks).unionByName(quality.page_violations(pages, blocks, tracks)).collect()
    assert sorted(tuple(r) for r in found) == sorted([("q", "unknown_track", "a"), ("q", "list_without_items", "a"), ("q", "list_without_items", "d"), ("q", "chart_payload", "b"), ("q", "figure_payload", "c"), ("q", "page_reading_order", ""), ("q", "page_track", "hue"), ("q", "track_blocks", "text")])
