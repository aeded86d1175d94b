"""Thresholds, masks and overviews of pixels in long form: one row a pixel, groups of chips or tiles.

What needs a pixel's neighbours works on blocks (``operators.blocks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaled(pixels: DataFrame, *, key: str = "chip", value: str = "value", limit: float = 2.0) -> DataFrame:
    """Groups whose largest value is over ``limit`` divided by it, as indices may come in whole numbers."""
    largest = pixels.groupBy(key).agg(F.max(value).alias("__largest"))
    over = F.col("__largest") > limit
    return pixels.join(largest, key).withColumn(value, F.when(over, F.col(value) / F.col("__largest")).otherwise(F.col(value))).drop("__largest")


def otsu_thresholds(pixels: DataFrame, *, key: str = "chip", value: str = "value", bins: int = 256) -> DataFrame:
    """Threshold of each group with the largest variance between classes.

    A histogram of ``bins`` equal bins per group is aggregated first, so the windows run over
    bins and not over pixels.  A group of one single value has that value as its threshold.
    """
    low, high = F.min(value).alias("low"), F.max(value).alias("high")
    ranges = pixels.where(F.col(value).isNotNull()).groupBy(key).agg(low, high)
    width = (F.col("high") - F.col("low")) / bins
    slot = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(value) - F.col("low"), width))).cast("int")
    binned = pixels.where(F.col(value).isNotNull()).join(ranges, key).withColumn("bin", F.coalesce(slot, F.lit(0)))
    histogram = binned.groupBy(key, "bin", "low", "high").agg(F.count("*").alias("n"))
    centre = F.col("low") + (F.col("bin") + 0.5) * width
    histogram = histogram.withColumn("centre", centre)
    upto = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    sums = histogram.withColumns(
        {
            "w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("centre")).over(upto),
            "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("centre")).over(whole),
        }
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - F.try_divide(F.col("s") - F.col("s0"), w1)
    sums = sums.withColumn("between", F.round(F.col("w0") * w1 * gap * gap, 6))
    best = F.max_by(F.col("centre"), F.struct(F.col("between"), -F.col("bin")))
    return sums.groupBy(key).agg(F.when(F.min("low") == F.max("high"), F.min("low")).otherwise(best).alias("threshold"))


def water_mask(pixels: DataFrame, *, key: str = "chip", value: str = "value") -> DataFrame:
    """Add ``mask``: at or over the group's Otsu threshold, or 0 where it has none, as no value is known."""
    found = pixels.join(otsu_thresholds(pixels, key=key, value=value), key, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    return found.withColumn("mask", F.coalesce(F.col(value) >= F.col("threshold"), F.lit(False)))


def pyramid(pixels: DataFrame, levels: tuple = (2, 4, 8, 16, 32), *, key: str = "chip", value: str = "value") -> DataFrame:
    """Averaged overviews: one row a cell and level."""

    def level(k: int) -> DataFrame:
        at = [F.floor(F.col(c) / k).cast("int").alias(c) for c in ("row", "col")]
        return pixels.groupBy(key, *at).agg(F.avg(value).alias(value)).withColumn("level", F.lit(k))

    out = level(levels[0])
    for k in levels[1:]:
        out = out.unionByName(level(k))
    return out
