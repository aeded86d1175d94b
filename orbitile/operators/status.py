"""Outcome of a tile as one ordered decision, and checks before anything is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.functions import geo


def tile_status(scenes: Column, bands: Column, megabytes: Column, valid_share: Column, error: Column) -> Column:
    """The first reason that stops a tile, else ok.

    No scene, bands that lack red, green and blue (null), a tile over the safe size, an error
    while fetching, or a result without valid pixels.
    """
    return (
        F.when(error.isNotNull(), "error")
        .when(F.coalesce(scenes, F.lit(0)) == 0, "no_imagery")
        .when(bands.isNull(), "missing_bands")
        .when(megabytes * 1024 * 1024 > geo.SAFE_BYTES, "tile_too_large")
        .when(F.coalesce(valid_share, F.lit(0.0)) <= 0, "validation_failed")
        .otherwise("ok")
    )


def safe_to_drop(intermediates: DataFrame, outputs: DataFrame) -> DataFrame:
    """Intermediates of the months all of whose outputs are valid."""
    done = outputs.groupBy("year", "month").agg(F.min(F.col("valid").cast("int")).alias("ok")).where("ok = 1")
    return intermediates.join(done.select("year", "month"), ["year", "month"], "left_semi")
