"""Tables that several parts of a plan read, written once to the folder that all nodes share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that setting is empty (a session of tests, on one machine) a folder of the machine is taken; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Let Arrow batches of this session hold at most so many rows: of whole pages, the default of 10,000 is no bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once and read back from Parquet in a shared folder, which cuts its lineage."""
    path, schema = shared_path(df.sparkSession, tag), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
