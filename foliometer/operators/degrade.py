"""Controlled degradations of a lossless prediction, each a DataFrame to a DataFrame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET = "abcdefghijklmnopqrstuvwxyz "
_LETTERS = np.frombuffer(ALPHABET.encode("utf-32-le"), dtype="<u4")


def text_only(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("type") != "chart") & (F.coalesce("text", F.lit("")) != "")).withColumn("type", F.lit("paragraph"))


def dropped_na_cells(cells: DataFrame, keys: list[str], header_rows: int) -> DataFrame:
    """Body cells without a value go, and the rest of a row moves up to consecutive columns."""
    kept = cells.where((F.col("row") < header_rows) | ~F.trim(F.coalesce("text", F.lit(""))).isin("", "N/A"))
    rank = F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col")) - 1
    return kept.withColumn("col", F.when(F.col("row") < header_rows, F.col("col")).otherwise(rank))


def flat_header(cells: DataFrame) -> DataFrame:
    return cells.withColumn("rowspan", F.lit(1)).withColumn("colspan", F.lit(1))


def noise_seed(key: F.Column) -> F.Column:
    """Where the generator of noise starts, from the md5 of key; a column of its own, so that it is hashed once for a text."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def noise(texts, starts, one_in: int = 50):
    """Each text with one character in `one_in` replaced by one of the alphabet, by a generator that starts from its seed; all of a text's characters at once."""
    for x, first in zip(texts, starts, strict=True):
        if x:
            u = ((int(first) + np.arange(len(x), dtype=np.int64) * 7919) * 48271) % 2147483647
            at = np.flatnonzero(u % one_in == 0)
            chars = np.frombuffer(x.encode("utf-32-le"), dtype="<u4").copy()
            chars[at] = _LETTERS[u[at] // one_in % len(ALPHABET)]
            x = chars.tobytes().decode("utf-32-le")
        yield x


def noisy_text(text: Column, start: Column, one_in: int = 50) -> Column:
    """`noise` of a column of texts."""

    @F.pandas_udf(T.StringType())
    def noisy(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series(list(noise(texts, starts, one_in)), dtype=object)

    return noisy(text, start)


@F.pandas_udf(T.ArrayType(T.StringType()))
def noisy_texts(texts: pd.Series, starts: pd.Series) -> pd.Series:
    """`noise` of a column of lists of texts, with a seed for each."""
    return pd.Series([None if x is None else list(noise(x, seeds)) for x, seeds in zip(texts, starts, strict=True)], dtype=object)


def merged_paragraphs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block_ix (of the first), type, text: runs of paragraphs become one, joined by spaces."""
    w = Window.partitionBy(*keys).orderBy("block_ix")
    starts = F.when((F.col("type") == "paragraph") & (F.lag("type").over(w) == "paragraph"), 0).otherwise(1)
    runs = blocks.withColumn("s", starts).withColumn("run", F.sum("s").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return runs.groupBy(*keys, "run").agg(F.min("block_ix").alias("block_ix"), F.min("type").alias("type"), F.when(F.count("text") > 0, joined).alias("text")).drop("run")


def no_chart_labels(chart: F.Column) -> F.Column:
    """A chart that was found, and nothing in it read."""
    out = chart.withField("labels", F.array().cast("array<string>")).withField("n", F.lit(0).cast("long"))
    return out.withField("by_class", F.create_map().cast("map<string,bigint>")).withField("x", F.lit(None).cast("string")).withField("y", F.lit(None).cast("string"))


def half_labels(labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The half, rounded down, of each key's labels that come first by md5."""
    w = Window.partitionBy(*keys)
    ranked = labels.withColumn("r", F.row_number().over(w.orderBy(F.md5(label), label))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("r") <= F.floor(F.col("n") / 2)).drop("r", "n")
