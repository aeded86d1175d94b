"""Spectral indices as column expressions.  An unknown band or a zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def mndwi(green: Column, swir1: Column) -> Column:
    """Only where short-wave infrared is positive."""
    return F.when(swir1 > 0, normalized_difference(green, swir1))


def evi(nir: Column, red: Column, blue: Column) -> Column:
    below = nir + 6.0 * red - 7.5 * blue + 1.0
    return F.when(below > 0, 2.5 * (nir - red) / below)


def savi(nir: Column, red: Column) -> Column:
    return F.try_divide(1.5 * (nir - red), nir + red + 0.5)


def fvi(nir: Column, swir1: Column) -> Column:
    return F.when(swir1 > 0, normalized_difference(nir, swir1))


def avi(vegetation: Column, water: Column) -> Column:
    """Vegetation near the water line: the vegetation index scaled down by the water index, where that is small."""
    return F.when(F.abs(water) < 0.3, vegetation * (1.0 - F.abs(water)))


def with_indices(pixels: DataFrame) -> DataFrame:
    """Add NDVI, NDWI, MNDWI, EVI, SAVI, FVI and AVI to pixels with the six standard bands.

    AVI takes MNDWI as its water index, or NDWI where that is null.
    """
    c = F.col
    out = pixels.withColumns(
        {
            "NDVI": ndvi(c("B8"), c("B4")), "NDWI": ndwi(c("B3"), c("B8")), "MNDWI": mndwi(c("B3"), c("B11")),
            "EVI": evi(c("B8"), c("B4"), c("B2")), "SAVI": savi(c("B8"), c("B4")), "FVI": fvi(c("B8"), c("B11")),
        }
    )
    return out.withColumn("AVI", avi(c("NDVI"), F.coalesce("MNDWI", "NDWI")))


def mosaic_indices(mosaic: DataFrame, bands: tuple[str, ...] = ("B4", "B3", "B2", "B8", "B11", "B12")) -> DataFrame:
    """The indices of a finished mosaic: all of them if it has the six standard bands, else it stays as it is.

    A cell without a positive short-wave band has neither MNDWI nor FVI, so a mosaic without any has none.
    """
    return with_indices(mosaic) if set(bands) <= set(mosaic.columns) else mosaic
