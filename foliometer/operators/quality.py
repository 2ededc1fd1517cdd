"""Data-quality rules over gold pages: each gives rows (page_id, rule, detail), and a union of them is the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("title", "heading", "banner", "paragraph", "caption", "footnote", "list", "table", "chart", "figure", "header", "footer")

TRACKS = ("text", "structure", "table", "chart_data", "furniture", "cell_style")


def _hits(df: DataFrame, rule: str, where, detail=None) -> DataFrame:
    return df.where(where).select("page_id", F.lit(rule).alias("rule"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def violations(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """blocks: page_id, id, block_ix, reading_order, type, text, x0, y0, x1, y1, items (texts, or null), caption_for."""
    twice = blocks.groupBy("page_id", "id").count().where("count > 1")
    targets = blocks.select("page_id", F.col("id").alias("caption_for"))
    rules = [
        _hits(twice, "duplicate_id", F.lit(True), F.col("id")),
        _hits(blocks, "unknown_type", ~F.col("type").isin(*TYPES), F.col("type")),
        _hits(blocks, "reading_order", F.col("reading_order") != F.col("block_ix") + 1, F.col("id")),
        _hits(blocks, "bad_id", F.col("id") != F.format_string("%s.b%02d", F.col("page_id").cast("string"), F.col("block_ix") + 1), F.col("id")),
        _hits(blocks, "bbox", ~((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")) & (F.col("x0") >= -1) & (F.col("y0") >= -1) & (F.col("x1") <= width + 1) & (F.col("y1") <= height + 1)), F.col("id")),
        _hits(blocks, "list_items", (F.col("type") == "list") & F.col("items").isNotNull() & (F.coalesce("text", F.lit("")) != F.array_join("items", "\n")), F.col("id")),
        _hits(blocks.where("caption_for IS NOT NULL").join(targets, ["page_id", "caption_for"], "left_anti"), "caption_for", F.lit(True), F.col("caption_for")),
        _hits(blocks, "no_text", ~F.col("type").isin("figure", "chart", "table") & (F.coalesce("text", F.lit("")) == ""), F.col("id")),
    ]
    return reduce(DataFrame.unionByName, rules)


def payload_violations(blocks: DataFrame) -> DataFrame:
    """blocks: page_id, id, type, tracks, items (texts, or null), has_chart, has_figure; no shuffle."""
    strange = F.filter("tracks", lambda x: ~x.isin(*TRACKS))
    rules = [
        _hits(blocks, "unknown_track", F.size(strange) > 0, F.col("id")),
        _hits(blocks, "list_without_items", (F.col("type") == "list") & (F.coalesce(F.size("items"), F.lit(0)) < 1), F.col("id")),
        _hits(blocks, "chart_payload", (F.col("type") == "chart") & ~F.coalesce("has_chart", F.lit(False)), F.col("id")),
        _hits(blocks, "figure_payload", (F.col("type") == "figure") & ~F.coalesce("has_figure", F.lit(False)), F.col("id")),
    ]
    return reduce(DataFrame.unionByName, rules)


def page_violations(pages: DataFrame, blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rules on whole pages: their order of ids, and what they say of each track.

    pages: page_id, reading_order (ids); blocks: page_id, block_ix, id, tracks;
    tracks: page_id, track, applicable, n_blocks (null: not stated).
    """
    ids = blocks.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "id"))), lambda x: x["id"]).alias("ids"))
    order = pages.join(ids, "page_id", "left").where(~F.col("reading_order").eqNullSafe(F.coalesce("ids", F.array().cast("array<string>"))))
    actual = blocks.select("page_id", F.explode(F.array_distinct("tracks")).alias("track")).groupBy("page_id", "track").agg(F.count("*").alias("actual"))
    told = tracks.join(actual, ["page_id", "track"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    rules = [
        _hits(order, "page_reading_order", F.lit(True)),
        _hits(tracks, "page_track", ~F.col("track").isin(*TRACKS), F.col("track")),
        _hits(told, "track_blocks", F.coalesce("applicable", F.lit(False)) & F.col("n_blocks").isNotNull() & (F.col("n_blocks") != F.col("actual")), F.col("track")),
    ]
    return reduce(DataFrame.unionByName, rules)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


def assert_clean(found: DataFrame) -> None:
    """Raise with the counts by rule if there is any violation."""
    rows = summary(found).collect()  # at most one row per rule
    if rows:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']}" for r in sorted(rows)))
