"""Parser-native nested JSON to blocks: type vocabularies, gathered text, pages by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One parser's block types and what they are here; others are paragraphs.
TYPE_MAP = {
    "title": "heading", "text": "paragraph", "list": "list", "index": "paragraph", "image": "figure", "table": "table",
    "equation": "paragraph", "interline_equation": "paragraph", "chart": "figure", "code": "paragraph", "discarded": "footer",
}

NESTED = "struct<type:string,bbox:array<double>,lines:array<struct<spans:array<struct<content:string,html:string>>>>>"


def map_types(raw: Column) -> Column:
    out = F.lit("paragraph")
    for name, kind in TYPE_MAP.items():
        out = F.when(raw == name, kind).otherwise(out)
    return out


def _spans(block: Column) -> Column:
    """All spans of a block's lines; lines without any are passed over."""
    return F.flatten(F.filter(F.transform(block["lines"], lambda line: line["spans"]), lambda s: s.isNotNull()))


def collect_text(block: Column) -> Column:
    """The content of all spans, in order, joined by spaces."""
    return F.coalesce(F.array_join(F.filter(F.transform(_spans(block), lambda s: s["content"]), lambda c: c.isNotNull() & (c != "")), " "), F.lit(""))


def find_html(block: Column) -> Column:
    """The first span's html that holds a tag of a table."""
    return F.try_element_at(F.filter(F.transform(_spans(block), lambda s: s["html"]), lambda h: h.contains("<t")), F.lit(1))


def bbox_of(block: Column) -> Column:
    """Four numbers to one decimal; without any, a unit box."""
    box = F.when(F.size(block["bbox"]) == 4, block["bbox"]).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    return F.transform(box, lambda v: F.round(v, 1))


def convert_blocks(pages: DataFrame, keys: list[str], blocks: str, furniture: bool = False) -> DataFrame:
    """keys, block_ix, type, text, html, bbox of the pages' native blocks; those without text, table or figure go.

    Furniture is a footer below 400 points, else a header.
    """
    b = pages.select(*keys, F.posexplode(blocks).alias("block_ix", "b"))
    b = b.select(*keys, F.col("block_ix").cast("long"), map_types(F.col("b.type")).alias("type"), F.trim(F.regexp_replace(collect_text(F.col("b")), r"(?U)\s+", " ")).alias("text"), find_html(F.col("b")).alias("html"), bbox_of(F.col("b")).alias("bbox"))
    kind = F.when((F.col("type") == "table") & F.col("html").isNull(), "paragraph").when(F.lit(furniture) & ~F.col("type").isin("table", "figure"), F.when(F.col("bbox")[1] > 400, "footer").otherwise("header")).otherwise(F.col("type"))
    return b.withColumn("type", kind).where("type = 'figure' OR html IS NOT NULL AND type = 'table' OR text <> ''")
