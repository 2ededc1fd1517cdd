"""Set and multiset agreement of two tables of labelled values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prf


def set_prf(gold: DataFrame, pred: DataFrame, keys: Sequence[str], value: str, examples: int = 0) -> DataFrame:
    """keys, tp, fp, fn, precision, recall, f1 over distinct values; keys of either side.

    With examples, also missed and spurious: so many values of one side only, the smallest.
    """
    both = gold.select(*keys, value, F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select(*keys, value, F.lit(0), F.lit(1)))
    seen = both.groupBy(*keys, value).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    only = lambda one, other, name: F.slice(F.array_sort(F.collect_list(F.when((F.col(one) == 1) & (F.col(other) == 0), F.col(value)))), 1, examples).alias(name)
    named = [only("g", "p", "missed"), only("p", "g", "spurious")] if examples else []
    counts = seen.groupBy(*keys).agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("p").alias("np"), F.sum("g").alias("ng"), *named)
    p, r, f = prf(F.col("tp"), F.col("ng"), F.col("np"))
    return counts.select(*keys, "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), f.alias("f1"), *(["missed", "spurious"] if examples else []))


def bag_f1(gold: DataFrame, pred: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, precision, recall, f1 over multisets of rows: INTERSECT ALL by counts, in one shuffle."""
    both = gold.select(*keys, *values, F.lit(1).alias("g"), F.lit(0).alias("p")).union(pred.select(*keys, *values, F.lit(0), F.lit(1)))
    counts = both.groupBy(*keys, *values).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    total = counts.groupBy(*keys).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("g").alias("ng"), F.sum("p").alias("np"))
    p, r, f = prf(F.col("tp"), F.col("ng"), F.col("np"))
    return total.select(*keys, p.alias("precision"), r.alias("recall"), f.alias("f1"))


def histogram_similarity(gold: DataFrame, pred: DataFrame, keys: Sequence[str], bin: str, count: str) -> DataFrame:
    """keys, similarity: one less half the absolute difference of the normalised histograms."""
    both = gold.select(*keys, bin, F.col(count).alias("g"), F.lit(0).alias("p")).union(pred.select(*keys, bin, F.lit(0), F.col(count)))
    bins = both.groupBy(*keys, bin).agg(F.sum("g").cast("double").alias("g"), F.sum("p").cast("double").alias("p"))
    total = bins.groupBy(*keys).agg(F.sum("g").alias("ng"), F.sum("p").alias("np"), F.collect_list(F.struct("g", "p")).alias("bins"))  # a page's classes: a handful
    apart = F.aggregate("bins", F.lit(0.0), lambda a, b: a + F.abs(b["g"] / F.col("ng") - b["p"] / F.col("np")))
    return total.select(*keys, F.when((F.col("ng") == 0) & (F.col("np") == 0), 1.0).when((F.col("ng") == 0) | (F.col("np") == 0), 0.0).otherwise(1 - apart / 2).alias("similarity"))


def bag_difference(gold: DataFrame, pred: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, dropped, invented: EXCEPT ALL both ways, rows that differ only."""
    both = gold.select(*keys, value, F.lit(1).alias("d")).union(pred.select(*keys, value, F.lit(-1)))
    out = both.groupBy(*keys, value).agg(F.sum("d").alias("d")).where("d <> 0")
    return out.select(*keys, value, F.greatest("d", F.lit(0)).alias("dropped"), F.greatest(-F.col("d"), F.lit(0)).alias("invented"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], identity: str) -> DataFrame:
    """keys whose identities are not distinct, with how many rows and how many identities."""
    out = df.groupBy(*keys).agg(F.count(identity).alias("n_rows"), F.countDistinct(identity).alias("n_ids"))
    return out.where("n_rows <> n_ids")
