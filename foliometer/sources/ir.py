"""Pages of gold and of parser runs: JSON files in, blocks as rows; JSON and Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BBOX = "bbox array<double>"
CELL = "struct<row:int,col:int,rowspan:int,colspan:int,text:string,is_header:boolean>"
STRUCTURE = f"struct<n_rows:int,n_cols:int,header_rows:int,cells:array<{CELL}>,ambiguities:array<struct<cells:array<string>,encoded_as:string,accepted_alternative:string,reason:string>>>"
CHART = "struct<chart_type:string,data_labels:array<string>,marks:struct<n:int,by_class:map<string,int>>,axes:struct<x:struct<label:string>,y:struct<label:string>>>"
BLOCK = f"struct<id:string,type:string,reading_order:int,text:string,bbox:array<double>,level:int,caption_for:string,items:array<struct<text:string,level:int,marker_raw:string>>,structure:{STRUCTURE},chart:{CHART}>"
PAGE = f"page_id string, parser struct<name:string,version:string>, page struct<width_pt:double,height_pt:double,orientation:string>, reading_order array<string>, blocks array<{BLOCK}>"


def scan_pages(spark: SparkSession, path: str, run: str | None = None, lines: bool = False) -> DataFrame:
    """One row per JSON file of a folder, or per line of its files, with the file name and the run's name; the schema is given, not inferred."""
    pages = spark.read.schema(PAGE).option("multiLine", not lines).json(path, pathGlobFilter="*.json")
    pages = pages.select("*", F.col("_metadata.file_name").alias("file_name"))
    return pages if run is None else pages.withColumn("run", F.lit(run))


def blocks(pages: DataFrame, *keys: str) -> DataFrame:
    return pages.select(*keys, "page_id", F.posexplode("blocks").alias("block_ix", "b")).select(*keys, "page_id", F.col("block_ix").cast("long"), "b.*")


def joined(run: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages that gold has as well, guarded by their ids, and the file names that it has not."""
    g = gold.select("file_name", F.col("page_id").alias("gold_id"), F.col("blocks").alias("gold_blocks"))
    both = run.join(g, "file_name")
    guard = F.when(F.col("page_id").eqNullSafe(F.col("gold_id")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("page_id mismatch: "), F.coalesce("page_id", F.lit("null")))).cast("boolean"))
    return both.where(guard), run.join(g, "file_name", "left_anti").select("file_name")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as UTF-8 JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
