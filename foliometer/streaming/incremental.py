"""Scoring of pages as they arrive: a stream of page files, each scored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ir


def page_stream(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pages of a folder as a stream, one per file or per line, with the time each file was changed."""
    pages = spark.readStream.schema(ir.PAGE).option("multiLine", not lines).option("pathGlobFilter", "*.json").json(path)
    return pages.select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def first_arrivals(pages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each page_id once within the watermark."""
    return pages.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["page_id"])


def block_counts(pages: DataFrame) -> DataFrame:
    """page_id, n_blocks, n_text: what can be said of a page by itself, without a shuffle."""
    return pages.select("page_id", F.size("blocks").alias("n_blocks"), F.size(F.filter("blocks", lambda b: F.coalesce(b["text"], F.lit("")) != "")).alias("n_text"))


def run_once(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append whatever is there to Parquet, exactly once, and stop."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
