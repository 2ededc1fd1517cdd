"""Scores of pages: tracks from pairs, weighted composites, and means over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import f1


def structure_track(gold: DataFrame, pred: DataFrame, pairs: DataFrame, tau: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, block_precision, block_recall, block_f1, type_strict, type_coarse, tau, spurious, score.

    gold, pred: keys, ix, type, kind (coarse); pairs: keys, gold_ix, pred_ix; tau: over pairs of body blocks.
    Gold furniture, and what is paired with it, does not count.
    """
    g = gold.select(*keys, F.col("ix").alias("gold_ix"), F.col("type").alias("gt"), F.col("kind").alias("gk"))
    p = pred.select(*keys, F.col("ix").alias("pred_ix"), F.col("type").alias("pt"), F.col("kind").alias("pk"))
    both = g.join(pairs.select(*keys, "gold_ix", "pred_ix"), [*keys, "gold_ix"], "left").join(p, [*keys, "pred_ix"], "full")
    body = F.col("gk").isNotNull() & (F.col("gk") != "furniture")
    paired = F.col("gk").isNotNull() & F.col("pk").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    out = both.groupBy(*keys).agg(n(body).alias("n_gold"), n(F.col("pk").isNotNull() & (body | F.col("gk").isNull())).alias("n_pred"), n(body & paired).alias("tp"), n(body & paired & (F.col("gt") == F.col("pt"))).alias("strict"), n(body & paired & (F.col("gk") == F.col("pk"))).alias("coarse"), n(F.col("gk").isNull()).alias("spurious"))
    return structure_of(out.join(tau, [*keys], "left").withColumn("tau", F.coalesce("tau", F.lit(1.0))), keys)


def structure_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The structure track of its counts: keys, n_gold, n_pred, tp, strict, coarse, tau, spurious."""
    precision = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.when(F.col("n_gold") == 0, 1.0).otherwise(0.0))
    recall = F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(1.0)
    share = lambda c: F.when(F.col("tp") > 0, F.col(c) / F.col("tp")).otherwise(0.0)
    out = counts.select(*keys, precision.alias("block_precision"), recall.alias("block_recall"), f1(precision, recall).alias("block_f1"), share("strict").alias("type_strict"), share("coarse").alias("type_coarse"), "tau", "spurious")
    return out.withColumn("score", (F.col("block_f1") + F.col("type_coarse") + F.col("tau")) / 3)


def furniture_track(gold: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_gold, n_found, score: the share of gold furniture that is paired; keys without furniture have no row."""
    f = gold.where("kind = 'furniture'").select(*keys, F.col("ix").alias("gold_ix"))
    out = f.join(pairs.select(*keys, "gold_ix", "pred_ix"), [*keys, "gold_ix"], "left").groupBy(*keys).agg(F.count("*").alias("n_gold"), F.count("pred_ix").alias("n_found"))
    return out.withColumn("score", F.col("n_found") / F.col("n_gold"))


def composite(scores: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, composite: weighted mean over the tracks that a page has, 0 without any; weights: profile, track, weight.

    scores carry keys, profile, track, score. Weights are a small dimension, joined by profile and track.
    """
    both = scores.where("score IS NOT NULL").join(weights, ["profile", "track"], "left")
    total = F.sum(F.when(F.col("weight").isNotNull(), F.col("weight")))
    return both.groupBy(*keys).agg(F.coalesce(F.sum(F.col("score") * F.col("weight")) / total, F.lit(0.0)).alias("composite"))


def compare(composites: DataFrame, keys: Sequence[str], one: str, other: str) -> DataFrame:
    """keys, gap: the composite of run one less that of run other, for the pages that both have."""
    of = lambda r: F.max(F.when(F.col("run") == r, F.col("composite")))
    both = composites.where(F.col("run").isin(one, other)).groupBy(*keys).agg(of(one).alias("_0"), of(other).alias("_1"), F.count_distinct("run").alias("_n"))
    return both.where("_n = 2").select(*keys, (F.col("_0") - F.col("_1")).alias("gap"))


def pivot_tracks(scores: DataFrame, keys: Sequence[str], tracks: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).pivot("track", list(tracks)).agg(F.avg("score"))
