"""Chart evaluation: banding, axis transforms, palette classes, label and mark agreement."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_band(radius: Column) -> Column:
    return F.when(radius >= 60, "large").when(radius >= 28, "medium").otherwise("small")


def nearest_class(rgb: tuple[Column, Column, Column], palette: Mapping[str, tuple[int, int, int]]) -> Column:
    """The palette's class at the smallest squared distance; the first of equals."""
    far = lambda c: sum(((x - v) * (x - v) for x, v in zip(rgb, c, strict=True)), F.lit(0))
    return F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(palette.items())])).getField("n")


def axis_percent(pixel: Column, low: Column, high: Column, first: float, last: float) -> Column:
    """A pixel between two gridlines, on the axis that runs from first to last."""
    return F.lit(first) + (pixel - low) * (last - first) / (high - low)


def blob_passes(area: Column, width: Column, height: Column) -> Column:
    fill, aspect = area / (width * height), width / height
    return (area >= 150) & (F.least(width, height) >= 10) & (fill >= 0.62) & (aspect >= 0.55) & (aspect <= 1.8)


def chart_score(labels: Column, count: Column, histogram: Column, axes: Column) -> Column:
    return 0.55 * labels + 0.15 * count + 0.15 * histogram + 0.15 * axes
