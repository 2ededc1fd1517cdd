"""Whole pages from parsers' own documents: nested blocks, texts outside the body, and furniture put where its box says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import adapters, layout
from .html_table import html_cells, structure

# Another parser's labels and what they are here; others are paragraphs. Items of lists are grouped later.
LABEL_MAP = {
    "title": "title", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "caption": "caption",
    "footnote": "footnote", "page_header": "header", "page_footer": "footer", "list_item": "list_item", "table": "table",
    "picture": "figure", "chart": "figure", "formula": "paragraph", "code": "paragraph", "form": "paragraph",
    "key_value_region": "paragraph", "document_index": "paragraph",
}

#: A native block that may hold others, which stand before its own lines.
NESTED = f"{adapters.NESTED[:-1]},blocks:array<{adapters.NESTED}>>"


def map_labels(raw: Column) -> Column:
    pairs = [F.lit(x) for pair in LABEL_MAP.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(raw)), F.lit("paragraph"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def gathered(block: Column, kinds: Sequence[str] | None = None) -> Column:
    """The text of the blocks inside and then of the block's own lines; with kinds, of inner blocks of those types alone."""
    inner = block["blocks"] if kinds is None else F.filter(block["blocks"], lambda b: b["type"].isin(*kinds))
    texts = F.coalesce(F.transform(inner, adapters.collect_text), F.array().cast("array<string>"))
    if kinds is None:
        texts = F.concat(texts, F.array(adapters.collect_text(block)))
    return F.array_join(F.filter(texts, lambda x: x != ""), " ")


def first_html(block: Column) -> Column:
    inner = F.filter(F.transform(block["blocks"], adapters.find_html), lambda h: h.isNotNull())
    return F.coalesce(F.try_element_at(inner, F.lit(1)), adapters.find_html(block))


def convert(pages: DataFrame, keys: Sequence[str], blocks: str, furniture: bool = False) -> DataFrame:
    """keys, ix, type, text, caption, structure, bbox of native blocks.

    A table is its HTML as cells, with the text of its captions and notes; where there is no HTML
    with a row, it is a paragraph of its text as it stands. Tables and figures have no text, blocks
    of other types without any go. Furniture below 400 points is a footer, else a header.
    """
    b = pages.select(*keys, F.posexplode(blocks).alias("ix", "b"))
    kind = adapters.map_types(F.col("b.type"))
    b = b.select(*keys, F.col("ix").cast("long"), kind.alias("kind"), gathered(F.col("b")).alias("raw"), F.when(kind == "table", first_html(F.col("b"))).alias("html"), F.when(kind == "table", F.nullif(gathered(F.col("b"), ("table_caption", "table_footnote")), F.lit(""))).alias("caption"), adapters.bbox_of(F.col("b")).alias("bbox"))
    b = b.withColumn("structure", structure(html_cells(F.col("html"))))
    bare = (F.col("kind") == "table") & F.col("structure").isNull()
    plain = ~F.col("kind").isin("table", "figure")
    region = F.when(F.col("bbox")[1] > 400, "footer").otherwise("header")
    kind = F.when(bare, "paragraph").when(plain & F.lit(furniture), region).otherwise(F.col("kind"))
    text = F.when(bare, F.col("raw")).when(plain, collapsed(F.col("raw")))
    return b.select(*keys, "ix", kind.alias("type"), text.alias("text"), "caption", "structure", "bbox").where("text IS NULL OR text <> ''")


def convert_page(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, position and the columns of convert: the body in its own order, discarded blocks after as many as have a smaller top.

    The body is para_blocks, or preproc_blocks where there are none.
    """
    pages = pages.withColumn("_body", F.when(F.size("para_blocks") > 0, F.col("para_blocks")).otherwise(F.col("preproc_blocks")))
    body, extra = convert(pages, keys, "_body"), convert(pages, keys, "discarded_blocks", furniture=True)
    tops = [x.select(*keys, "ix", F.col("bbox")[1].alias("y0")) for x in (body, extra)]
    order = layout.insert_by_top(*tops, keys)
    both = body.withColumn("source", F.lit("body")).unionByName(extra.withColumn("source", F.lit("extra")))
    return both.join(order, [*keys, "source", "ix"]).drop("source", "ix")


def skipped(texts: DataFrame, body: DataFrame, keys: Sequence[str]) -> DataFrame:
    """texts (keys, label, text and more) that are not in body (keys), with part: header, footer, or ocr for what a picture holds."""
    out = texts.join(body.select(*keys).distinct(), [*keys], "left_anti").withColumn("text", collapsed(F.col("text"))).where("text <> ''")
    label = F.lower("label")
    return out.withColumn("part", F.when(label == "page_header", "header").when(label == "page_footer", "footer").otherwise("ocr"))
