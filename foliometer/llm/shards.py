"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards; a node's weight is the sum of its
shards'. A key descends from the root: at each level every child draws
ln(u) / weight, with u a hash of (key, child) in (0, 1], and the largest draw
wins, so each child is taken in proportion to its weight. A draw depends only on
the key, the child's own name and its own weight. Hence a change of weights
moves keys only between subtrees whose weights change and their siblings' losses
to them: a child that grows only gains, and below an unchanged node nothing moves.

A shard added inside an old rack would also let keys come in from other racks and
land beside it. So a layout grows by regions: up to `base` shards stand in full
regions, and each further shard is a region by itself. Then one more shard takes
rows only into itself (law `key`), for every number of shards from base on.

Nulls and ties: a null key draws like a value of its own; a null text has no bytes.
Rows that repeat a key lie in its shard; rows alike in key, size and checksum are
interchangeable and get slots side by side. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, table, written

Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def layout(shards: int, base: int = 40, racks: int = 2, per_rack: int = 5) -> Tree:
    """A tree of equal weights: full regions up to base, then one region for each further shard."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for k in range(shards):
        region = k // (racks * per_rack) if k < base else f"+{k}"
        rack = k // per_rack % racks if k < base else 0
        tree.setdefault(f"region {region}", {}).setdefault(f"region {region} rack {rack}", {})[k] = 1.0
    return tree


def _draw(key: Column, name: str, weight: float) -> Column:
    # 53 bits of the hash, as a number in (0, 1]
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + F.lit(1.0)) / F.lit(float(1 << 53))
    return F.ln(u) / F.lit(float(weight))


def _winner(key: Column, children: Mapping[str, float]) -> Column:
    """The name of the child with the largest draw; ties go to the first name."""
    live = sorted(n for n, w in children.items() if w > 0)
    if len(live) == 1:
        return F.lit(live[0])
    draws = [F.struct(_draw(key, n, children[n]).alias("draw"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, n in enumerate(live)]
    return F.array_max(F.array(*draws)).getField("name")


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key, as a column expression: one descent, no join."""
    weights = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}
    totals = {r: sum(w.values()) for r, w in weights.items()}
    if not any(w > 0 for w in totals.values()):
        raise ValueError("no shard has a positive weight")
    region = _winner(key, totals)
    out = F.lit(None).cast("string")
    for r, racks in tree.items():
        if totals[r] <= 0:
            continue
        inner = F.lit(None).cast("string")
        rack = _winner(key, weights[r])
        for k, shards in racks.items():
            if weights[r][k] > 0:
                inner = F.when(rack == k, _winner(key, {f"shard {s}": w for s, w in shards.items()})).otherwise(inner)
        out = F.when(region == r, inner).otherwise(out)
    return F.regexp_replace(out, "^shard ", "").cast("int")


def assign(docs: DataFrame, shards: int = 40, base: int | None = None, buckets: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard.

    base: the number of shards that the layout began with, `shards` if it begins now. grown_shard is what shards + 1 with the same base will give.
    """
    base = shards if base is None else base
    if not 1 <= base <= shards:
        raise ValueError("base is the number of shards that the layout began with: from 1 to shards")
    text = F.coalesce("text", F.lit(""))
    key = F.col("doc_id")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shard_of(key, layout(shards, base)).alias("shard"), shard_of(key, layout(shards + 1, base)).alias("grown_shard"))
    # rows alike are counted before the shuffle and numbered together
    alike = written(rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("n")), "shards")
    placed = running(alike, ["shard"], ["doc_id", "size", "text_crc32"], F.col("n"), "first", buckets)
    placed = placed.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
