"""Page geometry: unions, containment, bands, islands and folds of positioned lines."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_bbox(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.round(F.min("x0"), 1).alias("x0"), F.round(F.min("y0"), 1).alias("y0"), F.round(F.max("x1"), 1).alias("x1"), F.round(F.max("y1"), 1).alias("y1"))


def inside(inner: str, outer: str, pad: float = 2.0) -> F.Column:
    """Whether the box of columns inner.* lies in that of outer.*, give or take pad."""
    a, b = (lambda c: F.col(f"{inner}.{c}")), (lambda c: F.col(f"{outer}.{c}"))
    return (a("x0") >= b("x0") - pad) & (a("y0") >= b("y0") - pad) & (a("x1") <= b("x1") + pad) & (a("y1") <= b("y1") + pad)


def classify_lines(y: F.Column, size: F.Column, bold: F.Column, length: F.Column, base: F.Column, page_h: F.Column) -> F.Column:
    """Header and footer by band, title and heading by size or weight, else paragraph."""
    return F.when((y > page_h * 0.90) | (y < page_h * 0.04), F.when(y > page_h * 0.5, "footer").otherwise("header")).when(size >= base * 1.45, "title").when((size >= base * 1.12) | (bold & (length < 90)), "heading").otherwise("paragraph")


def body_size(lines: DataFrame, keys: Sequence[str], size: str, text: str) -> DataFrame:
    """keys, body_size: the size that most characters have; the smaller of two."""
    chars = lines.groupBy(*keys, F.round(size, 1).alias("s")).agg(F.sum(F.length(text)).alias("n"))
    return chars.groupBy(*keys).agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body_size"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: F.Column, name: str) -> DataFrame:
    """df with the number, from 0, of the island each row is in; a new one begins where breaks holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_b", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("_b").over(w) - 1).drop("_b")


def group_paragraphs(lines: DataFrame, keys: Sequence[str], gap: float = 0.75) -> DataFrame:
    """keys, block_ix, type, text, x0, y0, x1, y1: consecutive paragraph lines that overlap the block so far and follow closely.

    lines: keys, ix, kind, base, text and a box. The box grows with the block, so this is a fold over a page's lines.
    """
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        blocks: list[dict] = []
        for r in page.sort_values("ix").itertuples():
            last = blocks[-1] if blocks else None
            if last and last["type"] == r.kind == "paragraph" and r.x0 <= last["x1"] and r.x1 >= last["x0"] and r.y0 - last["bottom"] < gap * max(r.base, 1.0):
                last["texts"].append(r.text)
                last.update(x0=min(last["x0"], r.x0), y0=min(last["y0"], r.y0), x1=max(last["x1"], r.x1), y1=max(last["y1"], r.y1), bottom=r.y1)
            else:
                blocks.append({"type": r.kind, "texts": [r.text], "x0": r.x0, "y0": r.y0, "x1": r.x1, "y1": r.y1, "bottom": r.y1})
        rows = [[*key, i, b["type"], " ".join(" ".join(b["texts"]).split()), b["x0"], b["y0"], b["x1"], b["y1"]] for i, b in enumerate(blocks)]
        return pd.DataFrame(rows, columns=[*keys, "block_ix", "type", "text", "x0", "y0", "x1", "y1"])

    return lines.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block_ix long, type string, text string, x0 double, y0 double, x1 double, y1 double")


def insert_by_top(body: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, source, ix, position: extra blocks put into the body's order, each after as many blocks as have a smaller top."""
    kinds = {f.name: f.dataType.simpleString() for f in body.schema.fields}

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [("body", r.ix, r.y0) for r in a.sort_values("ix").itertuples()]
        for r in b.sort_values("ix").itertuples():
            out.insert(sum(t < r.y0 for _, _, t in out), ("extra", r.ix, r.y0))
        return pd.DataFrame([[*key, s, i, p] for p, (s, i, _) in enumerate(out)], columns=[*keys, "source", "ix", "position"])

    sides = [x.select(*keys, "ix", "y0").groupBy(*keys) for x in (body, extra)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", source string, ix long, position long")


def row_clusters(boxes: DataFrame, keys: Sequence[str], y: str, rest: Sequence[str], slack: float) -> DataFrame:
    """boxes with the number of the row each is in: a row is open for those less than slack below its first.

    A row's first decides, not the one before, so this folds over the page's sorted tops: distinct ones, in one array.
    """
    tops = boxes.groupBy(*keys).agg(F.array_sort(F.collect_set(y)).alias("ys"))
    start = F.array().cast("array<double>")
    firsts = F.aggregate("ys", start, lambda acc, v: F.when((F.size(acc) == 0) | (v - F.element_at(acc, -1) >= slack), F.concat(acc, F.array(v))).otherwise(acc))
    rows = tops.select(*keys, firsts.alias("firsts"))
    return boxes.join(rows, [*keys]).withColumn("cluster", (F.size(F.filter("firsts", lambda v: v <= F.col(y))) - 1).cast("long")).drop("firsts")
