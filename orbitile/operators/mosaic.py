"""Composites: best pixel by quality, median, mean, first, and feathered merging."""

from __future__ import annotations

from functools import reduce

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.operators import blocks
from orbitile.sources.storage import stored

from .bands import STANDARD

CELL = ("tile_id", "row", "col")


def quality_mosaic(pixels: DataFrame, *, mode: str = "band", cell: tuple = CELL, bands: list[str] = STANDARD, quality: str = "quality", seq: str = "scene_id") -> DataFrame:
    """The best scene's value in every cell; ties go to the smallest ``seq``.

    ``band``: for each band the best scene that has it, so gaps fill from the next best.
    ``pixel``: all bands from the best scene that has red, green and blue.
    The order key is unique, and the aggregates combine before the shuffle.
    """
    order = F.struct(F.col(quality), -F.col(seq))
    if mode == "band":
        picked = [F.max_by(F.col(b), F.when(F.col(b).isNotNull(), order)).alias(b) for b in bands]
        return pixels.groupBy(*cell).agg(*picked)
    whole = F.col("B4").isNotNull() & F.col("B3").isNotNull() & F.col("B2").isNotNull()
    best = F.max_by(F.struct(*bands), F.when(whole, order)).alias("b")
    return pixels.groupBy(*cell).agg(best).select(*cell, "b.*")


def best_with_step(pixels: DataFrame, *, cell: tuple = CELL, bands: list[str] = STANDARD) -> DataFrame:
    """For every cell and band the best scene's value, as above, with that scene's ``step``: a struct a band."""
    order = F.struct(F.col("quality"), -F.col("scene_id"))
    picked = [F.max_by(F.struct(F.col(b).alias("value"), "step"), F.when(F.col(b).isNotNull(), order)).alias(b) for b in bands]
    return pixels.groupBy(*cell).agg(*picked)


def steps_of(cells: DataFrame, *, cell: tuple = CELL) -> DataFrame:
    return cells.select(*cell, *[F.col(f"{b}.step").alias(b) for b in cells.columns if b not in cell])


def until_step(cells: DataFrame, *, cell: tuple = CELL, bands: list[str] = STANDARD) -> DataFrame:
    """The values of steps up to ``last_step``; later ones are null."""
    return cells.select(*cell, *[F.when(F.col(f"{b}.step") <= F.col("last_step"), F.col(f"{b}.value")).alias(b) for b in bands])


def median_mosaic(pixels: DataFrame, *, cell: tuple = CELL, bands: list[str] = STANDARD) -> DataFrame:
    return pixels.groupBy(*cell).agg(*[F.median(b).alias(b) for b in bands])


def mean_mosaic(pixels: DataFrame, *, cell: tuple = CELL, bands: list[str] = STANDARD) -> DataFrame:
    return pixels.groupBy(*cell).agg(*[F.avg(b).alias(b) for b in bands])


def first_mosaic(pixels: DataFrame, *, cell: tuple = CELL, bands: list[str] = STANDARD, seq: str = "scene_id") -> DataFrame:
    """The first known value of each band in order of ``seq``."""
    return pixels.groupBy(*cell).agg(*[F.min_by(F.col(b), F.when(F.col(b).isNotNull(), F.col(seq))).alias(b) for b in bands])


def coverage(pixels: DataFrame, *, keys: list[str], bands: tuple = ("B4", "B3", "B2")) -> DataFrame:
    """Share of valid cells of each group, averaged over the visible bands."""
    shares = [F.avg(F.col(b).isNotNull().cast("double")) for b in bands]
    return pixels.groupBy(*keys).agg((sum(shares[1:], shares[0]) / len(bands)).alias("coverage"))


def feather_weight(row: Column, col: Column, height: Column, width: Column, feather: int, *, mode: str = "intent") -> Column:
    """Cosine ramp over ``feather`` pixels from the edge, 1 further inside.

    ``intent`` rises from 0 at the edge; ``literal`` falls from 1 at the edge and jumps back.
    """
    d = F.least(row, col, height - 1 - row, width - 1 - col).cast("double")
    wave = F.cos(math.pi * d / float(feather))
    ramp = 0.5 * (1.0 - wave) if mode == "intent" else 0.5 * (1.0 + wave)
    return F.when(d < feather, ramp).otherwise(1.0)


def feather_merge(pixels: DataFrame, *, keys: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """Weighted mean of overlapping pixels; null where all weights are 0."""
    v = F.when(F.col(value).isNotNull(), F.col(weight))
    return pixels.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * v), F.sum(v)).alias(value))


def place_tiles(tiles: DataFrame, *, keys: list[str], step: str = "step") -> DataFrame:
    """Pixels (keys, x0, y0, step, row, col, ...) of tiles on the grid of their mosaic: ``row`` and ``col`` become places
    in it, ``height`` and ``width`` are its size.

    x0 and y0 are a tile's first outer corner in metres.  The mosaic's grid starts at the smallest x0 and the
    largest y0; both, and its far edges, come from one aggregation.
    """
    c = F.col
    edges = {"__x": F.min("x0"), "__y": F.max("y0"), "__right": F.max(c("x0") + (c("col") + 1) * c(step)), "__low": F.min(c("y0") - (c("row") + 1) * c(step)), "__step": F.min(step)}
    extent = tiles.groupBy(*[c(k).alias(f"__{k}") for k in keys]).agg(*[v.alias(k) for k, v in edges.items()])
    met = [c(k).eqNullSafe(c(f"__{k}")) for k in keys]
    out = tiles.join(extent, reduce(lambda a, b: a & b, met))
    size = {"height": F.ceil((c("__y") - c("__low")) / c("__step") - 1e-6), "width": F.ceil((c("__right") - c("__x")) / c("__step") - 1e-6)}
    at = {"row": c("row") + F.rint((c("__y") - c("y0")) / c(step)), "col": c("col") + F.rint((c("x0") - c("__x")) / c(step))}
    return out.withColumns({k: v.cast("int") for k, v in (size | at).items()}).drop(*edges, *[f"__{k}" for k in keys])


def merge_tiles(tiles: DataFrame, side: int, feather: int, radius: int, *, keys: list[str], fill_from: int = 4, block: int = blocks.BLOCK) -> DataFrame:
    """Square tiles (keys, band, x0, y0, step, row, col, value) as one mosaic: (keys, band, row, col, value).

    Tiles are placed by their corners and feathered where they overlap; after that, gaps of the bands from
    ``fill_from`` on take the nearest value within ``radius``, in blocks.  Places that no tile covers stay out.
    """
    c = F.col
    weight = feather_weight(c("row"), c("col"), F.lit(side), F.lit(side), feather)
    placed = place_tiles(tiles.withColumn("weight", weight), keys=keys)
    merged = stored(feather_merge(placed, keys=[*keys, "band", "row", "col"]), "merged")
    frame = placed.agg(F.max("height"), F.max("width")).first()
    if frame[0] is None:
        return merged
    named = [*keys, "band"]
    grids = blocks.to_blocks(merged.where(c("band") >= fill_from), keys=named, value="value", height=frame[0], width=frame[1], block=block)
    filled = blocks.to_pixels(blocks.fill_nearest(grids, radius, keys=named, block=block), keys=named, block=block)
    covered = merged.select(*named, "row", "col")
    return filled.join(covered, [*named, "row", "col"], "left_semi").unionByName(merged.where(c("band") < fill_from).select(*filled.columns))
