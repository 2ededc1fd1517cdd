"""Queries of sources, adapters, data quality, composites and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import adapters, alignment, grid, layout, quality
from ..sources import ir
from .fixtures import BLOCKS, CELLS, coarse, gold_blocks, gold_cells, gold_tables, read

Q: dict[str, tuple] = {}

# -- sources


def gold_json(s, sf) -> DataFrame:
    """A JSON text per document, in the form of a gold page's blocks."""
    b = F.struct(F.format_string("p%d.b%02d", "doc_id", F.col("block_ix") + 1).alias("id"), "type", (F.col("block_ix") + 1).cast("int").alias("reading_order"), "text", F.array("x0", "y0", "x1", "y1").alias("bbox"))
    pages = gold_blocks(s, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ix", b.alias("b")))).alias("bs"))
    return pages.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("page_id"), F.transform("bs", lambda x: x["b"]).alias("blocks"))).alias("json"))


def parsed(s, sf) -> DataFrame:
    return gold_json(s, sf).select("doc_id", F.from_json("json", ir.PAGE).alias("p")).select("doc_id", "p.*")


Q["scan_gold"] = (lambda s, sf: ir.blocks(parsed(s, sf), "doc_id").select("doc_id", "block_ix", "id", "type", "text", F.col("bbox")[0].alias("x0")), f"WITH {BLOCKS} SELECT doc_id, block_ix, format('p{{}}.b{{:02d}}', doc_id, block_ix + 1) AS id, type, text, x0 FROM gold_blocks")
Q["run_gold_join"] = (
    lambda s, sf: ir.joined(parsed(s, sf).where("doc_id % 3 <> 0").withColumn("file_name", F.concat("page_id", F.lit(".json"))), parsed(s, sf).withColumn("file_name", F.concat("page_id", F.lit(".json"))))[0].select("doc_id", F.size("gold_blocks").alias("n")),
    f"WITH {BLOCKS} SELECT doc_id, count(*)::INTEGER AS n FROM gold_blocks WHERE doc_id % 3 <> 0 GROUP BY 1",
)
Q["run_gold_anti"] = (
    lambda s, sf: ir.joined(parsed(s, sf).withColumn("file_name", F.concat("page_id", F.lit(".json"))), parsed(s, sf).where("doc_id % 3 <> 0").withColumn("file_name", F.concat("page_id", F.lit(".json"))))[1],
    "SELECT doc_id || '.json' AS file_name FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL",
)
Q["page_id_guard"] = (
    lambda s, sf: ir.joined(*[parsed(s, sf).withColumn("file_name", F.concat("page_id", F.lit(".json"))) for _ in range(2)])[0].select("doc_id", (F.col("page_id") == F.col("gold_id")).alias("ok"), F.size("blocks").alias("n")),
    f"WITH {BLOCKS} SELECT doc_id, true AS ok, count(*)::INTEGER AS n FROM gold_blocks GROUP BY 1",
)
Q["lines_filter_sort"] = (
    lambda s, sf: gold_blocks(s, sf).where(F.trim("text") != "").withColumn("ix", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("y0", 1), "x0"))).select("doc_id", "ix", F.md5("text").alias("digest")),
    f"WITH {BLOCKS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0)::INTEGER AS ix, md5(text) AS digest FROM gold_blocks WHERE trim(text) <> ''",
)
Q["line_attrs"] = (
    lambda s, sf: gold_blocks(s, sf).where("text IS NOT NULL").withColumn("spans", F.transform(F.split("text", " "), lambda w, i: F.struct((8.0 + F.length(w) % 5).alias("size"), F.when(w.rlike("^[A-Z]"), "Sans-Bold").otherwise("Sans").alias("font")))).select("doc_id", "block_ix", F.array_max(F.transform("spans", lambda x: x["size"])).alias("size"), F.exists("spans", lambda x: x["font"].rlike("Bold|Black")).alias("bold")),
    f"WITH {BLOCKS} SELECT doc_id, block_ix, list_max(list_transform(string_split(text, ' '), lambda w: 8.0 + length(w) % 5))::DOUBLE AS size, len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[A-Z]'))) > 0 AS bold FROM gold_blocks WHERE text IS NOT NULL",
)
Q["dump_modes"] = (
    lambda s, sf: gold_blocks(s, sf).where("text IS NOT NULL").select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("mode"), c.cast("long").alias("n")) for n, c in (("blocks", F.lit(1)), ("chars", F.length("text")), ("words", F.size(t.tokens(F.col("text")))))]))).groupBy("doc_id", "mode").agg(F.sum("n").alias("n")),
    f"WITH {BLOCKS}, w AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM gold_blocks WHERE text IS NOT NULL) SELECT doc_id, 'blocks' AS mode, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT doc_id, 'chars', sum(length(text))::BIGINT FROM w GROUP BY 1 UNION ALL SELECT doc_id, 'words', sum(CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END)::BIGINT FROM w GROUP BY 1",
)
Q["figure_min_size"] = (lambda s, sf: gold_blocks(s, sf).where("type = 'figure'").withColumn("w", F.col("block_ix") % 20).where("w >= 8 AND y1 - y0 >= 8").select("doc_id", "block_ix", "w"), f"WITH {BLOCKS} SELECT doc_id, block_ix, block_ix % 20 AS w FROM gold_blocks WHERE type = 'figure' AND block_ix % 20 >= 8")
Q["ordinal_page_map"] = (
    lambda s, sf: read(s, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("pages")).select("conv_id", F.posexplode("pages").alias("ordinal", "role")).join(F.broadcast(s.createDataFrame([(0, "p04"), (1, "p13"), (2, "p22"), (3, "p27"), (4, "p30")], "ordinal int, page_id string")), "ordinal").select("conv_id", "page_id", "role"),
    "SELECT conv_id, CASE k WHEN 1 THEN 'p04' WHEN 2 THEN 'p13' WHEN 3 THEN 'p22' WHEN 4 THEN 'p27' ELSE 'p30' END AS page_id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k FROM conversations) WHERE k <= 5",
)
Q["literal_lookup"] = (lambda s, sf: read(s, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")

# -- adapters: documents as one parser's nested pages


def nested(s, sf) -> DataFrame:
    b = gold_blocks(s, sf)
    raw = F.when(F.col("type") == "heading", "title").when(F.col("type") == "figure", "image").when(F.col("type") == "footer", "discarded").when(F.col("block_ix") % 5 == 4, "interline_equation").otherwise("text")
    half = F.floor(F.length("text") / 2).cast("int")
    span = lambda c: F.array(F.struct(c.alias("content"), F.lit(None).cast("string").alias("html")))
    lines = F.when(F.col("text").isNull(), F.array()).otherwise(F.array(F.struct(span(F.substring(F.col("text"), F.lit(1), half)).alias("spans")), F.struct(span(F.substring(F.col("text"), half + 1, F.length("text"))).alias("spans"))))
    block = F.struct(raw.alias("type"), F.array("x0", "y0", "x1", "y1").alias("bbox"), lines.alias("lines"))
    pages = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ix", "type", block.alias("b")))).alias("bs"))
    pick = lambda furniture: F.transform(F.filter("bs", lambda x: (x["type"] == "footer") == F.lit(furniture)), lambda x: x["b"]).cast(f"array<{adapters.NESTED}>")
    return pages.select("doc_id", pick(False).alias("para_blocks"), pick(True).alias("discarded_blocks"))


_RAW = BLOCKS + """, raw AS (
  SELECT *, CASE type WHEN 'heading' THEN 'title' WHEN 'figure' THEN 'image' WHEN 'footer' THEN 'discarded' ELSE CASE WHEN block_ix % 5 = 4 THEN 'interline_equation' ELSE 'text' END END AS raw_type,
    concat_ws(' ', nullif(substr(text, 1, length(text) // 2), ''), nullif(substr(text, length(text) // 2 + 1), '')) AS halves FROM gold_blocks
)"""
Q["map_types"] = (lambda s, sf: nested(s, sf).select("doc_id", F.explode(F.concat("para_blocks", "discarded_blocks")).alias("b")).groupBy("doc_id", adapters.map_types(F.col("b.type")).alias("type")).agg(F.count("*").alias("n")), f"WITH {_RAW} SELECT doc_id, CASE raw_type WHEN 'title' THEN 'heading' WHEN 'image' THEN 'figure' WHEN 'discarded' THEN 'footer' ELSE 'paragraph' END AS type, count(*) AS n FROM raw GROUP BY 1, 2")
Q["collect_text"] = (lambda s, sf: nested(s, sf).select("doc_id", F.posexplode(F.col("para_blocks")).alias("k", "b")).select("doc_id", "k", F.md5(adapters.collect_text(F.col("b"))).alias("digest")), f"WITH {_RAW} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) - 1)::INTEGER AS k, md5(coalesce(halves, '')) AS digest FROM raw WHERE type <> 'footer'")


def _tables(s, sf):
    cells = gold_cells(s, sf).where("row = 0").groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: F.concat(F.lit("<td>"), x["text"], F.lit("</td>"))), "").alias("h"))
    span = F.array(F.struct(F.lit("x").alias("content"), F.lit("none").alias("html")), F.struct(F.lit("").alias("content"), F.concat(F.lit("<tr>"), "h").alias("html")))
    return cells.select("table_id", F.struct(F.lit("table").alias("type"), F.array(F.lit(0.0)).alias("bbox"), F.array(F.struct(span.alias("spans"))).alias("lines")).cast(adapters.NESTED).alias("b"))


Q["find_html"] = (lambda s, sf: _tables(s, sf).select("table_id", adapters.find_html(F.col("b")).alias("html")), f"WITH {CELLS} SELECT table_id, '<tr>' || string_agg('<td>' || text || '</td>', '' ORDER BY col) AS html FROM gold_cells WHERE row = 0 GROUP BY 1")
Q["convert_block"] = (
    lambda s, sf: adapters.convert_blocks(nested(s, sf), ["doc_id"], "para_blocks").groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    f"""WITH {_RAW}, c AS (SELECT doc_id, CASE raw_type WHEN 'title' THEN 'heading' WHEN 'image' THEN 'figure' ELSE 'paragraph' END AS type, trim(regexp_replace(coalesce(halves, ''), '\\s+', ' ', 'g')) AS x FROM raw WHERE type <> 'footer')
    SELECT doc_id, type, count(*) AS n, sum(length(x))::BIGINT AS chars FROM c WHERE type = 'figure' OR x <> '' GROUP BY 1, 2""",
)
Q["convert_furniture"] = (lambda s, sf: adapters.convert_blocks(nested(s, sf), ["doc_id"], "discarded_blocks", furniture=True).select("doc_id", "type"), f"WITH {_RAW} SELECT doc_id, CASE WHEN y0 > 400 THEN 'footer' ELSE 'header' END AS type FROM raw WHERE type = 'footer' AND trim(coalesce(halves, '')) <> ''")
Q["collect_skipped"] = (
    lambda s, sf: gold_blocks(s, sf).where("text <> ''").join(gold_blocks(s, sf).where("type IN ('paragraph', 'heading')").select("doc_id", "block_ix"), ["doc_id", "block_ix"], "left_anti").select("doc_id", "block_ix", F.when(F.col("type") == "footer", "furniture").otherwise("ocr").alias("part")),
    f"WITH {BLOCKS} SELECT doc_id, block_ix, CASE WHEN type = 'footer' THEN 'furniture' ELSE 'ocr' END AS part FROM gold_blocks WHERE text <> '' AND type NOT IN ('paragraph', 'heading')",
)
Q["ocr_to_chart"] = (
    lambda s, sf: gold_blocks(s, sf).where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", r"[ \n]")).alias("w")).where("w <> ''").groupBy("doc_id").agg(F.count(F.when(t.is_tick(F.col("w")), 1)).alias("n_ticks"), F.count_distinct(F.when(~t.is_tick(F.col("w")), F.col("w"))).alias("n_labels")),
    f"WITH {BLOCKS}, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM gold_blocks WHERE text IS NOT NULL) SELECT doc_id, count(*) FILTER (regexp_full_match(w, '[-+]?\\d+(\\.\\d+)?%?')) AS n_ticks, count(DISTINCT w) FILTER (NOT regexp_full_match(w, '[-+]?\\d+(\\.\\d+)?%?')) AS n_labels FROM w WHERE w <> '' GROUP BY 1",
)

# -- quality


def dirty(s, sf) -> DataFrame:
    """Gold blocks with some faults, each at a place that depends on the block's number."""
    b = gold_blocks(s, sf).withColumn("page_id", F.col("doc_id").cast("string"))
    b = b.withColumn("id", F.format_string("%s.b%02d", "page_id", F.when(F.col("block_ix") == 13, 13).otherwise(F.col("block_ix") + 1)))
    return b.select("page_id", "block_ix", "id", (F.col("block_ix") + F.when(F.col("block_ix") == 17, 2).otherwise(1)).alias("reading_order"), F.when(F.col("block_ix") == 19, "blob").otherwise(F.col("type")).alias("type"), "text", "x0", F.when(F.col("block_ix") == 23, F.col("y1")).otherwise(F.col("y0")).alias("y0"), "x1", "y1", F.when((F.col("type") == "list") & (F.col("block_ix") % 4 == 0), F.array("text", F.lit("more"))).alias("items"), F.when(F.col("block_ix") == 5, F.lit("none")).alias("caption_for"))


_FOUND = BLOCKS + """, found AS (
  SELECT doc_id, 'duplicate_id' AS rule FROM gold_blocks WHERE block_ix = 13
  UNION ALL SELECT doc_id, 'bad_id' FROM gold_blocks WHERE block_ix = 13
  UNION ALL SELECT doc_id, 'reading_order' FROM gold_blocks WHERE block_ix = 17
  UNION ALL SELECT doc_id, 'unknown_type' FROM gold_blocks WHERE block_ix = 19
  UNION ALL SELECT doc_id, 'bbox' FROM gold_blocks WHERE block_ix = 23
  UNION ALL SELECT doc_id, 'list_items' FROM gold_blocks WHERE type = 'list' AND block_ix % 4 = 0 AND block_ix <> 19
  UNION ALL SELECT doc_id, 'caption_for' FROM gold_blocks WHERE block_ix = 5
  UNION ALL SELECT doc_id, 'no_text' FROM gold_blocks WHERE (type <> 'figure' OR block_ix = 19) AND coalesce(text, '') = ''
)"""
Q["dq_violations"] = (lambda s, sf: quality.violations(dirty(s, sf), 620.0, 1e6).groupBy("page_id", "rule").agg(F.count("*").alias("n")), f"WITH {_FOUND} SELECT doc_id::VARCHAR AS page_id, rule, count(*) AS n FROM found GROUP BY 1, 2")
Q["dq_summary"] = (lambda s, sf: quality.summary(quality.violations(dirty(s, sf), 620.0, 1e6)), f"WITH {_FOUND} SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS n_pages FROM found GROUP BY 1")

# -- reports

Q["track_counts"] = (lambda s, sf: gold_blocks(s, sf).select("doc_id", coarse(F.col("type")).alias("track")).groupBy("doc_id", "track").agg(F.count("*").alias("n_blocks")), f"WITH {BLOCKS} SELECT doc_id, CASE type WHEN 'footer' THEN 'furniture' WHEN 'paragraph' THEN 'text' ELSE type END AS track, count(*) AS n_blocks FROM gold_blocks GROUP BY 1, 2")


Q["sim_matrix"] = (
    lambda s, sf: read(s, sf, "benchmark").select("item_id", F.explode(F.split(t.normalize(F.col("text")), " ")).alias("w")).distinct().groupBy("item_id").agg(F.collect_list("w").alias("ws")).select("item_id", F.explode("ws").alias("a"), "ws").select("item_id", "a", F.explode("ws").alias("b")).groupBy("item_id").agg(F.round(F.sum(t.similarity(F.col("a"), F.col("b"))), 4).alias("total")),
    None,
)
def _cut_rows(tables):
    """Tables without the cells of their third row; the shape is what the rest reaches."""
    kept = tables.withColumn("cells", F.filter("cells", lambda c: c["row"] != 2))
    reach = lambda a, n: F.array_max(F.transform("cells", lambda c: c[a] + c[n]))
    return kept.select("table_id", "cells", reach("row", "rowspan").alias("n_rows"), reach("col", "colspan").alias("n_cols"))


Q["nw_align"] = (lambda s, sf: grid.align_rows(gold_tables(s, sf), _cut_rows(gold_tables(s, sf)), ["table_id"]), None)


Q["convert_page"] = (
    lambda s, sf: adapters.convert_blocks(nested(s, sf), ["doc_id"], "para_blocks").withColumn("side", F.lit("body")).unionByName(adapters.convert_blocks(nested(s, sf), ["doc_id"], "discarded_blocks", furniture=True).withColumn("side", F.lit("extra"))).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count(F.when(F.col("side") == "extra", 1)).alias("n_furniture")),
    f"""WITH {_RAW} SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (type = 'footer') AS n_furniture FROM raw WHERE type = 'figure' OR trim(coalesce(halves, '')) <> '' GROUP BY 1""",
)
Q["row_cluster"] = (lambda s, sf: layout.row_clusters(gold_blocks(s, sf), ["doc_id"], "y0", ["x0"], 4.0).groupBy("doc_id", "cluster").agg(F.count("*").alias("n")), f"WITH {BLOCKS} SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY y0) - 1 AS cluster, count(*) AS n FROM gold_blocks GROUP BY doc_id, y0")
