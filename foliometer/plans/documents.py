"""Queries of whole native pages, page files and streams of them, and rules on pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents, quality
from ..sources import ir, store
from ..streaming import incremental
from .fixtures import BLOCKS, gold_blocks
from .pages import gold_json

Q: dict[str, tuple] = {}

# -- page files


def page_files(s, sf) -> str:
    """A folder of files with a page on each line."""
    path = store.shared_path(s, "pages")
    gold_json(s, sf).select("json").write.text(path)
    renamed = f"{path}-json"
    s.read.text(path).select(F.from_json("value", ir.PAGE).alias("p")).select("p.*").write.json(renamed)
    return renamed


def streamed(s, sf) -> DataFrame:
    out = store.shared_path(s, "counts")
    pages = incremental.page_stream(s, page_files(s, sf), lines=True)
    incremental.run_once(incremental.block_counts(incremental.first_arrivals(pages)), f"{out}/rows", f"{out}/state").awaitTermination()
    return s.read.schema("page_id string, n_blocks int, n_text int").parquet(f"{out}/rows")


Q["scan_ir_json"] = (
    lambda s, sf: ir.blocks(ir.scan_pages(s, page_files(s, sf), "r", lines=True), "run").select("run", "page_id", "block_ix", "type", F.md5("text").alias("digest"), F.col("bbox")[1].alias("y0")),
    f"WITH {BLOCKS} SELECT 'r' AS run, doc_id::VARCHAR AS page_id, block_ix, type, md5(text) AS digest, y0 FROM gold_blocks",
)
Q["page_stream"] = (streamed, f"WITH {BLOCKS} SELECT doc_id::VARCHAR AS page_id, count(*)::INTEGER AS n_blocks, count(*) FILTER (text <> '')::INTEGER AS n_text FROM gold_blocks GROUP BY 1")

# -- native pages


def native(s, sf) -> DataFrame:
    """Documents as nested native pages: titles, texts, lists of two blocks, tables with HTML and a caption, tables without, images."""
    b = gold_blocks(s, sf)
    raw = F.when(F.col("type") == "footer", "discarded").when(F.col("text").isNull(), "image").otherwise(F.element_at(F.array(*map(F.lit, ("title", "text", "list", "table", "table"))), (F.col("block_ix") % 5 + 1).cast("int")))
    nothing = F.lit(None).cast("string")
    lines = lambda content, html=nothing: F.array(F.struct(F.array(F.struct(content.alias("content"), html.alias("html"))).alias("spans")))
    inner = lambda kind, x: F.struct(F.lit(kind).alias("type"), F.array(F.lit(0.0)).alias("bbox"), x.alias("lines"))
    html = F.concat(F.lit("<table><tr><th>"), F.md5("text"), F.lit("</th></tr><tr><td>x</td></tr></table>"))
    table = (raw == "table") & (F.col("block_ix") % 5 == 3)
    nested = F.when(raw == "list", F.array(inner("text", lines(F.col("text"))), inner("text", lines(F.lit("end"))))).when(table, F.array(inner("table_caption", lines(F.concat(F.lit("Table "), F.col("block_ix").cast("string")))), inner("table_body", lines(nothing, html))))
    own = F.when(raw.isin("list", "image") | table, F.lit(None)).otherwise(lines(F.col("text")))
    block = F.struct(raw.alias("type"), F.array("x0", "y0", "x1", "y1").alias("bbox"), own.alias("lines"), nested.alias("blocks"))
    pages = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ix", "type", block.alias("b")))).alias("bs"))
    pick = lambda furniture: F.transform(F.filter("bs", lambda x: (x["type"] == "footer") == F.lit(furniture)), lambda x: x["b"]).cast(f"array<{documents.NESTED}>")
    odd = F.col("doc_id") % 2 == 1
    return pages.select("doc_id", F.when(~odd, pick(False)).alias("para_blocks"), F.when(odd, pick(False)).alias("preproc_blocks"), pick(True).alias("discarded_blocks"))


_NATIVE = BLOCKS + r""", native AS (
  SELECT *, CASE WHEN type = 'footer' THEN 'discarded' WHEN text IS NULL THEN 'image' ELSE ['title', 'text', 'list', 'html', 'bare'][block_ix % 5 + 1] END AS raw_type FROM gold_blocks
), filled AS (
  SELECT doc_id, block_ix, y0, raw_type,
    CASE raw_type WHEN 'image' THEN 'figure' WHEN 'title' THEN 'heading' WHEN 'list' THEN 'list' WHEN 'html' THEN 'table' WHEN 'discarded' THEN CASE WHEN y0 > 400 THEN 'footer' ELSE 'header' END ELSE 'paragraph' END AS kind,
    CASE WHEN raw_type IN ('image', 'html') THEN NULL WHEN raw_type = 'bare' THEN text WHEN raw_type = 'list' THEN trim(regexp_replace(text || ' end', '\s+', ' ', 'g')) ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS content,
    CASE WHEN raw_type = 'html' THEN 'Table ' || block_ix END AS caption, CASE WHEN raw_type = 'html' THEN md5(text) END AS first_cell
  FROM native
), converted AS (SELECT * FROM filled WHERE content IS NULL OR content <> '')"""


def shown() -> list:
    return [F.col("type"), F.md5("text").alias("digest"), F.col("caption"), F.col("structure.cells")[0]["text"].alias("first_cell"), F.coalesce("structure.header_rows", F.lit(0)).alias("header_rows"), F.coalesce(F.size("structure.cells"), F.lit(0)).alias("n_cells")]


_SHOWN_SQL = "kind AS type, md5(content) AS digest, caption, first_cell, CASE WHEN first_cell IS NOT NULL THEN 1 ELSE 0 END::INTEGER AS header_rows, CASE WHEN first_cell IS NOT NULL THEN 2 ELSE 0 END::INTEGER AS n_cells"

Q["convert_nested"] = (
    lambda s, sf: documents.convert(native(s, sf).withColumn("body", F.coalesce("para_blocks", "preproc_blocks")), ["doc_id"], "body").select("doc_id", *shown()),
    f"WITH {_NATIVE} SELECT doc_id, {_SHOWN_SQL} FROM converted WHERE raw_type <> 'discarded'",
)
Q["assemble_page"] = (
    lambda s, sf: documents.convert_page(native(s, sf), ["doc_id"]).select("doc_id", "position", *shown()),
    f"""WITH {_NATIVE}, body AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) - 1 AS r FROM converted WHERE raw_type <> 'discarded'
    ), extra AS (SELECT f.*, (SELECT count(*) FROM body b WHERE b.doc_id = f.doc_id AND b.y0 < f.y0) AS p FROM converted f WHERE raw_type = 'discarded'
    ), placed AS (SELECT b.*, (r + CASE WHEN r >= p THEN 1 ELSE 0 END)::BIGINT AS position FROM body b LEFT JOIN (SELECT doc_id, p FROM extra) USING (doc_id))
    SELECT doc_id, position, {_SHOWN_SQL} FROM placed UNION ALL SELECT doc_id, p, {_SHOWN_SQL} FROM extra""",
)

_LABELS = [*documents.LABEL_MAP, "stamp", "TABLE"]
Q["map_labels"] = (
    lambda s, sf: gold_blocks(s, sf).select("doc_id", documents.map_labels(F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("block_ix") % len(_LABELS) + 1).cast("int"))).alias("type")).groupBy("doc_id", "type").agg(F.count("*").alias("n")),
    f"WITH {BLOCKS}, labels(label, kind) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in documents.LABEL_MAP.items())}) SELECT doc_id, coalesce(kind, 'paragraph') AS type, count(*) AS n FROM gold_blocks LEFT JOIN labels ON label = lower({_LABELS!r}[block_ix % {len(_LABELS)} + 1]) GROUP BY 1, 2",
)


def _texts(s, sf) -> DataFrame:
    label = F.when(F.col("type") == "footer", "page_footer").when(F.col("block_ix") % 7 == 3, "page_header").otherwise("text")
    return gold_blocks(s, sf).select("doc_id", "block_ix", label.alias("label"), "text")


Q["skipped_texts"] = (
    lambda s, sf: documents.skipped(_texts(s, sf), _texts(s, sf).where("block_ix % 3 <> 1"), ["doc_id", "block_ix"]).select("doc_id", "block_ix", "part", F.md5("text").alias("digest")),
    rf"WITH {BLOCKS}, t AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM gold_blocks WHERE block_ix % 3 = 1) SELECT doc_id, block_ix, CASE WHEN type = 'footer' THEN 'footer' WHEN block_ix % 7 = 3 THEN 'header' ELSE 'ocr' END AS part, md5(x) AS digest FROM t WHERE x <> ''",
)

# -- rules


def _marked(s, sf) -> DataFrame:
    """Gold blocks with tracks and payloads, some of them faulty."""
    b = gold_blocks(s, sf)
    track = F.when(F.col("block_ix") % 19 == 18, "colour").when(F.col("type") == "footer", "furniture").when(F.col("type") == "figure", "chart_data").otherwise("text")
    kind = F.when((F.col("type") == "figure") & (F.col("block_ix") % 2 == 1), "chart").otherwise(F.col("type"))
    return b.select(F.col("doc_id").cast("string").alias("page_id"), "block_ix", F.format_string("%d.b%02d", "doc_id", F.col("block_ix") + 1).alias("id"), kind.alias("type"), F.array(track).alias("tracks"), F.when((F.col("type") == "list") & (F.col("block_ix") % 4 == 0), F.array("text")).alias("items"), (F.col("block_ix") % 3 == 0).alias("has_chart"), (F.col("block_ix") % 4 == 0).alias("has_figure"))


def page_rules(s, sf) -> DataFrame:
    blocks = _marked(s, sf)
    ids = blocks.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "id"))), lambda x: x["id"]).alias("ids"), F.count(F.when(F.array_contains("tracks", "text"), 1)).alias("n"))
    third = F.col("page_id").cast("long") % 3 == 0
    pages = ids.select("page_id", F.when(third, F.reverse("ids")).otherwise(F.col("ids")).alias("reading_order"))
    told = ids.select("page_id", F.lit("text").alias("track"), F.lit(True).alias("applicable"), (F.col("n") + F.when(F.col("page_id").cast("long") % 5 == 0, 1).otherwise(0)).alias("n_blocks"))
    told = told.unionByName(ids.where("cast(page_id AS long) % 7 = 0").select("page_id", F.lit("colour").alias("track"), F.lit(False).alias("applicable"), F.lit(None).cast("long").alias("n_blocks")))
    return quality.payload_violations(blocks).unionByName(quality.page_violations(pages, blocks, told)).groupBy("page_id", "rule").agg(F.count("*").alias("n"))


Q["dq_page_rules"] = (
    page_rules,
    f"""WITH {BLOCKS}, found AS (
      SELECT doc_id, 'unknown_track' AS rule FROM gold_blocks WHERE block_ix % 19 = 18
      UNION ALL SELECT doc_id, 'list_without_items' FROM gold_blocks WHERE type = 'list' AND block_ix % 4 <> 0
      UNION ALL SELECT doc_id, 'chart_payload' FROM gold_blocks WHERE type = 'figure' AND block_ix % 2 = 1 AND block_ix % 3 <> 0
      UNION ALL SELECT doc_id, 'figure_payload' FROM gold_blocks WHERE type = 'figure' AND block_ix % 2 = 0 AND block_ix % 4 <> 0
      UNION ALL SELECT doc_id, 'page_reading_order' FROM gold_blocks WHERE doc_id % 3 = 0 GROUP BY 1 HAVING count(*) > 1
      UNION ALL SELECT doc_id, 'page_track' FROM gold_blocks WHERE doc_id % 7 = 0 GROUP BY 1
      UNION ALL SELECT doc_id, 'track_blocks' FROM gold_blocks WHERE doc_id % 5 = 0 GROUP BY 1
    ) SELECT doc_id::VARCHAR AS page_id, rule, count(*) AS n FROM found GROUP BY 1, 2""",
)
