"""Scene scores as column expressions: cloud fraction, completeness, quality, gap filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the quality score; completeness comes on top, so they add up to 1.10.
WEIGHTS = {"cloud": 0.25, "sun": 0.15, "view": 0.10, "valid": 0.15, "temporal": 0.05, "resolution": 0.30, "completeness": 0.10}
EXCELLENT = 0.85


def clamp01(x: Column) -> Column:
    """x between 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def cloud_fraction(*percents: Column, mask_mean: Column | None = None) -> Column:
    """First known cloud percentage as a fraction, else one minus the mean of the valid mask, else 0.5."""
    known = F.coalesce(*percents)
    other = F.coalesce(1.0 - mask_mean, F.lit(0.5)) if mask_mean is not None else F.lit(0.5)
    return F.when(known.isNotNull(), clamp01(known / 100.0)).otherwise(other)


def valid_fraction(*percents: Column, mask_mean: Column | None = None) -> Column:
    """The mean of the valid mask where no cloud percentage is known, else 0.5."""
    if mask_mean is None:
        return F.lit(0.5)
    return F.when(F.coalesce(*percents).isNull(), F.coalesce(mask_mean, F.lit(0.5))).otherwise(F.lit(0.5))


def coarse_cloud_fraction(bit_mean: Column, *percents: Column, mask_mean: Column) -> Column:
    """For sensors with a one-bit cloud flag: its mean, else percentages, else the mask, else 0.5."""
    known = F.coalesce(*percents)
    return F.coalesce(clamp01(bit_mean), clamp01(known / 100.0), 1.0 - mask_mean, F.lit(0.5))


def sun_score(zenith: Column) -> Column:
    low = F.greatest(F.lit(0.2), 1.0 - (zenith - 60.0) / 60.0)
    return F.when(zenith.isNull() | (zenith < 30), 1.0).when(zenith > 60, low).otherwise(1.0 - (zenith - 30.0) / 100.0)


def view_score(zenith: Column) -> Column:
    return F.when(zenith > 10, F.greatest(F.lit(0.5), 1.0 - (zenith - 10.0) / 40.0)).otherwise(1.0)


def temporal_score(days: Column, max_days: Column) -> Column:
    """Highest in the middle of the period, with a small bonus for early days far from it."""
    d = F.abs(days - max_days / 2.0)
    far = F.greatest(F.lit(0.5), 0.7 - (d - 30.0) / max_days * 0.5) + F.greatest(F.lit(0.0), 0.3 - days / max_days * 0.2)
    steps = F.when(d <= 5, 1.0).when(d <= 15, 0.95 - (d - 5.0) / 200.0).when(d <= 30, 0.85 - (d - 15.0) / 150.0)
    return F.when(days.isNull(), 1.0).otherwise(steps.otherwise(F.least(F.lit(1.0), far)))


def resolution_score(metres: Column) -> Column:
    # fixed values: score by native resolution
    steps = ((4, 1.0), (15, 0.95), (30, 0.85), (60, 0.60), (250, 0.40), (400, 0.25))
    found = reduce(lambda c, s: c.when(metres <= s[0], s[1]), steps, F.when(metres.isNull() | (metres == 0), 1.0))
    return found.otherwise(0.15)


def completeness_score(share: Column) -> Column:
    return F.when(share.isNull(), 1.0).when(share < 0.7, 0.7 * share).when(share < 0.9, 0.7 + 1.5 * (share - 0.7)).otherwise(1.0)


def quality_score(
    cloud: Column, sun: Column, view: Column, valid: Column, days: Column, max_days: Column, resolution: Column, completeness: Column
) -> Column:
    """Weighted quality of a scene, 0 to 1.  Every unknown but the cloud fraction counts as ideal."""
    parts = {
        "cloud": F.greatest(F.lit(0.0), 1.0 - 1.5 * cloud),
        "sun": sun_score(sun),
        "view": view_score(view),
        "valid": F.when(valid.isNull(), 1.0).otherwise(F.greatest(F.lit(0.3), valid)),
        "temporal": temporal_score(days, max_days),
        "resolution": resolution_score(resolution),
        "completeness": completeness_score(completeness),
    }
    return sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())


def band_completeness(bands: Column) -> Column:
    """Share of the wanted bands among the names in an array.

    Without red, green and blue it is 0.  Else 0.2, 0.6 by near and short-wave infrared, and
    0.2 by water and vegetation indices.  A name SR_B1 tells the older naming, in which the
    numbers are one lower.
    """

    def has(*names: str) -> Column:
        return F.coalesce(reduce(lambda a, b: a | b, (F.array_contains(bands, n) for n in names)), F.lit(False))

    old = has("SR_B1")
    red = has("B4") | F.when(old, has("SR_B3")).otherwise(has("SR_B4"))
    green = has("B3") | F.when(old, has("SR_B2")).otherwise(has("SR_B3"))
    blue = has("B2") | old | has("SR_B2")
    nir = has("B8") | F.when(old, has("SR_B4")).otherwise(has("SR_B5") | (has("B4") & has("SR_B4")))
    swir1 = has("B11") | F.when(old, has("SR_B5")).otherwise(has("SR_B6", "B5"))
    swir2 = has("B12", "SR_B7", "B7")
    infrared = (nir.cast("int") + swir1.cast("int") + swir2.cast("int")) / 3.0
    indices = F.when(has("NDWI", "MNDWI"), 1.0).otherwise(0.5) * F.when(has("NDVI"), 1.0).otherwise(0.5)
    return F.when(red & green & blue, 0.2 + infrared * 0.6 + indices * 0.2).otherwise(0.0)


def gap_fill_score(resolution: Column, day_distance: Column, quality: Column) -> Column:
    """Rank of a candidate for filling gaps: resolution first, then nearness in time, then quality."""
    near = F.when(day_distance <= 10, 0.15 * (1.0 - day_distance / 10.0)).when(day_distance <= 30, 0.05 * (1.0 - (day_distance - 10.0) / 20.0))
    return 0.7 / (1.0 + resolution / 30.0) + near.otherwise(0.0) + 0.15 * quality


def sensor_adjusted(score: Column, sensor: Column, acquired: Column, with_l4: Column, with_l5: Column) -> Column:
    """Penalties and boosts by sensor; the last two columns tell which neighbours are present."""
    day = F.lit
    overlap = acquired.between(day("1984-03-01").cast("date"), day("1993-12-14").cast("date"))
    boosted = F.least(F.lit(1.0), score * 1.05)
    return (
        F.when((sensor == "LANDSAT_4") & (overlap | with_l5), score * 0.92)
        .when((sensor == "LANDSAT_4") & (acquired >= day("1983-01-01").cast("date")), boosted)
        .when((sensor == "LANDSAT_5") & with_l4, boosted)
        .when((sensor == "LANDSAT_7") & (acquired >= day("2003-05-31").cast("date")), score * 0.5)
        .when(sensor.startswith("MODIS"), score * 0.5)
        .otherwise(score)
    )


def score_class(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def tests_before_lowering(candidates: Column) -> Column:
    """Candidates to test before a threshold is lowered: fewer where few exist."""
    return F.when(candidates <= 3, 1).when(candidates <= 10, 2).otherwise(3)


def relaxed_quality(iteration: Column) -> Column:
    """Least quality that gap filling accepts in an iteration."""
    return F.greatest(F.lit(0.2), 0.5 - 0.05 * iteration)
