"""Pixel masks as boolean columns; an unknown input counts as masked."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the quality flags.
CLOUD, SHADOW, CIRRUS, DILATED, SNOW = 3, 4, 8, 1, 5


def known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def bit_clear(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << bit)) == 0


def scene_class_ok(scl: Column) -> Column:
    """Vegetation, bare ground, water or unclassified."""
    return known(scl.between(4, 7))


def optical_ok(scl: Column, cloud_probability: Column | None, bands: Sequence[Column]) -> Column:
    """Usable class, cloud probability under 30 where there is one, and positive visible bands."""
    ok = scl.between(4, 7)
    if cloud_probability is not None:
        ok = ok & (cloud_probability < 30)
    return known(reduce(lambda a, b: a & (b > 0), bands, ok))


def flags_ok(flags: Column, bands: Sequence[Column] = ()) -> Column:
    """No cloud, shadow, cirrus, dilated cloud or snow bit, and bands within (0, 10000)."""
    ok = reduce(lambda a, b: a & bit_clear(flags, b), (SHADOW, CIRRUS, DILATED, SNOW), bit_clear(flags, CLOUD))
    return known(reduce(lambda a, b: a & (b > 0) & (b < 10000), bands, ok))


def flags_ok_basic(flags: Column) -> Column:
    return known(bit_clear(flags, CLOUD) & bit_clear(flags, SHADOW) & bit_clear(flags, CIRRUS))


def dark_enough(red: Column, green: Column, limit: float = 0.6) -> Column:
    """The simple brightness test of sensors without quality flags."""
    return known((red + green) / 2.0 < limit)


def all_nonzero(*bands: Column) -> Column:
    return known(reduce(lambda a, b: a & (b != 0), bands, F.lit(True)))


def valid_pixel(value: Column, nodata: float | None = None) -> Column:
    """Finite and not nodata nor zero; without a nodata value, finite and positive."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return known(finite & ((value != nodata) & (value != 0) if nodata is not None else value > 0))


def masked(ok: Column, *names: str) -> dict[str, Column]:
    """Columns that are null where the mask fails."""
    return {n: F.when(ok, F.col(n)) for n in names}
