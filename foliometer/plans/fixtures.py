"""Views over the synthetic tables that give the evaluation operators blocks, tables and charts to work on, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Coarse types of blocks; the rest of an engine's own names count as themselves.
COARSE = {
    "title": "heading", "heading": "heading", "banner": "heading",
    "paragraph": "text", "caption": "text", "footnote": "text",
    "list": "list", "table": "table", "chart": "figure", "figure": "figure",
    "header": "furniture", "footer": "furniture",
}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_type(ix, n) -> F.Column:
    """The type of the block that line ix of n lines is."""
    return F.when(ix % 11 == 10, "figure").when(ix == 0, "heading").when((ix == n - 1) & (n >= 4), "footer").when(ix % 7 == 6, "list").otherwise("paragraph")


def gold_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, block_ix, n, type, text, x0, y0, x1, y1: each line of a document is a block of a two-column page."""
    lines = read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("lines"))
    b = lines.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("block_ix", "text"))
    kind = line_type(F.col("block_ix"), F.col("n"))
    x0, y0 = 20.0 + 300 * (F.col("block_ix") % 2), 10.0 + 12 * F.floor(F.col("block_ix") / 2)
    return b.select("doc_id", F.col("block_ix").cast("long"), F.col("n").cast("long"), kind.alias("type"), F.when(kind != "figure", F.col("text")).alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 280).alias("x1"), (y0 + 10).alias("y1"))


BLOCKS = """
lines AS (
  SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_ix
  FROM documents WHERE text IS NOT NULL
), kinds AS (
  SELECT *, CASE WHEN block_ix % 11 = 10 THEN 'figure' WHEN block_ix = 0 THEN 'heading' WHEN block_ix = n - 1 AND n >= 4 THEN 'footer' WHEN block_ix % 7 = 6 THEN 'list' ELSE 'paragraph' END AS type
  FROM lines
), gold_blocks AS (
  SELECT doc_id, block_ix::BIGINT AS block_ix, n::BIGINT AS n, type, CASE WHEN type <> 'figure' THEN t END AS text,
         (20 + 300 * (block_ix % 2))::DOUBLE AS x0, (10 + 12 * (block_ix // 2))::DOUBLE AS y0, (300 + 300 * (block_ix % 2))::DOUBLE AS x1, (20 + 12 * (block_ix // 2))::DOUBLE AS y1
  FROM kinds
)"""


_ITEM = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey")
_HEAD = [(0, 0, 2, 1, "Item"), (0, 1, 1, 2, "Amounts"), (0, 3, 1, 2, "Rates"), (0, 5, 2, 1, "Flag"), (1, 1, 1, 1, "Qty"), (1, 2, 1, 1, "Price"), (1, 3, 1, 1, "Discount"), (1, 4, 1, 1, "Tax")]


def _item_texts(item=None) -> F.Column:
    """The texts of a line item, of the row's or of a struct's columns."""
    of = F.col if item is None else item.__getitem__
    num = lambda c: F.round(of(c) * 100).cast("long").cast("string")
    return F.array(of("l_linenumber").cast("string"), num("l_quantity"), num("l_extendedprice"), F.when(of("l_discount") == 0, "N/A").otherwise(num("l_discount")), num("l_tax"), of("l_returnflag"))


def _head() -> F.Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, ("row", "col", "rowspan", "colspan", "text"), strict=True)]) for c in _HEAD])


def gold_cells(spark: SparkSession, sf: str) -> DataFrame:
    """table_id, row, col, rowspan, colspan, text, is_header: one table per order, two header rows and a row per line item."""
    item = Window.partitionBy("l_orderkey").orderBy(*_ITEM)
    li = read(spark, sf, "lineitem").withColumn("row", F.row_number().over(item) + 1)
    body = li.select(F.col("l_orderkey").alias("table_id"), "row", F.posexplode(_item_texts()).alias("col", "text")).select("table_id", "row", "col", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), "text", F.lit(False).alias("is_header"))
    top = li.select(F.col("l_orderkey").alias("table_id")).distinct().select("table_id", F.inline(_head())).withColumn("is_header", F.lit(True))
    return top.unionByName(body)


def gold_tables(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """table_id, cells, n_rows, n_cols: the tables of `gold_cells`, a row each; with only (table_id), no other ones are put together.

    An order's items are collected as they are and become cells in their row, so that no cell is a row of its own in a shuffle.
    """
    li = read(spark, sf, "lineitem")
    if only is not None:
        least, most = only.agg(F.min("table_id"), F.max("table_id")).first()  # spares the join what cannot be in it
        li = li.where(F.col("l_orderkey").between(least, most)).join(only.select(F.col("table_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    items = li.select("l_orderkey", F.struct(*_ITEM).alias("item")).groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    cell = lambda r, c, x: F.struct((r + 2).alias("row"), c.alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), x.alias("text"), F.lit(False).alias("is_header"))
    body = F.flatten(F.transform("items", lambda i, r: F.transform(_item_texts(i), lambda x, c: cell(r, c, x))))
    head = F.transform(_head(), lambda c: F.struct(*[c[n].alias(n) for n in ("row", "col", "rowspan", "colspan", "text")], F.lit(True).alias("is_header")))
    return items.select("table_id", F.concat(head, body).alias("cells"), (F.size("items") + 2).alias("n_rows"), F.lit(6).alias("n_cols"))


CELLS = """
item_rows AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, l_partkey, l_suppkey) + 1 AS r
  FROM lineitem
), body AS (
  SELECT l_orderkey AS table_id, r::INTEGER AS row, generate_subscripts(v, 1)::INTEGER - 1 AS col, unnest(v) AS text
  FROM (SELECT *, [l_linenumber::VARCHAR, round(l_quantity * 100)::BIGINT::VARCHAR, round(l_extendedprice * 100)::BIGINT::VARCHAR, CASE WHEN l_discount = 0 THEN 'N/A' ELSE round(l_discount * 100)::BIGINT::VARCHAR END, round(l_tax * 100)::BIGINT::VARCHAR, l_returnflag] AS v FROM item_rows)
), head(row, col, rowspan, colspan, text) AS (
  VALUES (0, 0, 2, 1, 'Item'), (0, 1, 1, 2, 'Amounts'), (0, 3, 1, 2, 'Rates'), (0, 5, 2, 1, 'Flag'), (1, 1, 1, 1, 'Qty'), (1, 2, 1, 1, 'Price'), (1, 3, 1, 1, 'Discount'), (1, 4, 1, 1, 'Tax')
), gold_cells AS (
  SELECT o.table_id, row, col, rowspan, colspan, text, true AS is_header FROM (SELECT DISTINCT l_orderkey AS table_id FROM lineitem) o, head
  UNION ALL SELECT table_id, row, col, 1, 1, text, false FROM body
)"""


def charts(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, label, event_type: the marks of one chart per user."""
    label = F.concat_ws("-", "event_type", F.get_json_object("props", "$.k"))
    return read(spark, sf, "events").select("user_id", label.alias("label"), "event_type")


CHARTS = """
charts AS (SELECT user_id, concat_ws('-', event_type, json_extract_string(props, '$.k')) AS label, event_type FROM events)"""


def y_sorted(blocks: DataFrame) -> DataFrame:
    """blocks with pred_ix: their rank from top to bottom, ignoring columns."""
    order = Window.partitionBy("doc_id").orderBy(F.round("y0", 1), "x0", "block_ix")
    return blocks.withColumn("pred_ix", F.row_number().over(order).cast("long") - 1)


def coarse(c) -> F.Column:
    out = F.lit(None).cast("string")
    for name, kind in COARSE.items():
        out = F.when(c == name, kind).otherwise(out)
    return out


COARSE_SQL = "coarse(type, kind) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in COARSE.items()) + ")"
