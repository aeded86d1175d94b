"""Band mapping: sensor preparation, standard schema, harmonization, download selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitile.functions import masks

STANDARD = ["B4", "B3", "B2", "B8", "B11", "B12"]

# Raw band of each standard band, by family of sensors.
BAND_MAPS = {
    "SENTINEL": {b: b for b in STANDARD},
    "LANDSAT_OLD": {"B2": "SR_B1", "B3": "SR_B2", "B4": "SR_B3", "B8": "SR_B4", "B11": "SR_B5", "B12": "SR_B7"},
    "LANDSAT_NEW": {"B2": "SR_B2", "B3": "SR_B3", "B4": "SR_B4", "B8": "SR_B5", "B11": "SR_B6", "B12": "SR_B7"},
    "LANDSAT_RAW": {"B2": "B1", "B3": "B2", "B4": "B3", "B8": "B4", "B11": "B5", "B12": "B7"},
    "SPOT": {"B3": "XS1", "B4": "XS2", "B8": "XS3"},
    "SPOT_4": {"B3": "B1", "B4": "B2", "B8": "B3", "B11": "MIR"},
    "MSS": {"B3": "SR_B1", "B4": "SR_B2", "B8": "SR_B3", "B11": "SR_B4"},
    "MODIS": {"B4": "sur_refl_b01", "B3": "sur_refl_b04", "B2": "sur_refl_b03", "B8": "sur_refl_b02", "B11": "sur_refl_b06", "B12": "sur_refl_b07"},
    "ASTER": {"B4": "VNIR_Band3N", "B3": "VNIR_Band2", "B2": "VNIR_Band1", "B8": "VNIR_Band3N", "B11": "SWIR_Band4", "B12": "SWIR_Band6"},
    "VIIRS": {"B4": "I1", "B3": "M3", "B2": "I3", "B8": "I2", "B11": "M11", "B12": "M12"},
}
# Factors of the reflectance bands, blue estimated from green, brightness limits.
SCALES = {"MODIS": 0.0001}
BLUE_FROM_GREEN = {"SPOT": 0.9, "SPOT_4": 0.9, "MSS": 0.85}
BLUE_FROM_GREEN_STANDARD = 0.875
BRIGHTNESS = {"SPOT": 0.6, "SPOT_4": 0.6, "MSS": 0.6, "AVHRR": 0.7}
# Standard band = a * proxy + b for the last-resort sensor, from its vegetation index or its two channels.
FROM_NDVI = {"B4": (0.5, 0.3), "B3": (0.5, 0.4), "B2": (0.4, 0.3), "B8": (0.6, 0.5)}
# Linear harmonization out = a * band + b.
HARMONIZATION = {
    "S2_to_LS": (0.98, 0.01), "LS_to_S2": (1.02, -0.01), "SPOT_to_LS": (1.00, 0.00), "LS_to_SPOT": (1.00, 0.00),
    "MSS_to_LS": (0.95, 0.02), "LS_to_MSS": (1.05, -0.02), "AVHRR_to_LS": (0.98, 0.01), "LS_to_AVHRR": (1.02, -0.01),
}
COARSE_FACTOR = 1.05


def _raw(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("double") if name in df.columns else F.lit(None).cast("double")


def prepare(raw: DataFrame, family: str) -> DataFrame:
    """Add the six standard bands to the raw pixels of one family; those it lacks are null.

    Sensors without a blue band get it from green, sensors without flags lose their brightest
    pixels, and flagged pixels (state_1km or QF1, bit 0) are masked.
    """
    if family == "AVHRR":
        out = raw.withColumns(_last_resort_bands(raw))
    else:
        scale, source = SCALES.get(family, 1.0), BAND_MAPS[family]
        bands = {b: _raw(raw, source[b]) * scale if b in source else F.lit(None).cast("double") for b in STANDARD}
        if family in BLUE_FROM_GREEN:
            bands["B2"] = bands["B3"] * BLUE_FROM_GREEN[family]
        out = raw.withColumns({f"__{b}": c for b, c in bands.items()})
        out = out.drop(*STANDARD).withColumnsRenamed({f"__{b}": b for b in STANDARD})
    ok = F.lit(True)
    if family in BRIGHTNESS:
        ok = masks.dark_enough(F.col("B4"), F.col("B3"), BRIGHTNESS[family])
    for flags in ("state_1km", "QF1"):
        if flags in raw.columns:
            ok = ok & masks.known(masks.bit_clear(F.col(flags), 0))
    return out.withColumns(masks.masked(ok, *STANDARD))


def _last_resort_bands(raw: DataFrame) -> dict[str, Column]:
    if "NDVI" in raw.columns:
        bands = {b: _raw(raw, "NDVI") * a + c for b, (a, c) in FROM_NDVI.items()}
    elif {"ch1", "ch2"} <= set(raw.columns):
        red = _raw(raw, "ch1")
        bands = {"B4": red, "B3": red * 0.9, "B2": red * 0.8, "B8": _raw(raw, "ch2")}
    else:
        proxy = _raw(raw, raw.columns[0])
        bands = {"B4": proxy, "B3": proxy * 0.9, "B2": proxy * 0.8, "B8": proxy * 1.1}
    return bands | {b: F.lit(None).cast("double") for b in ("B11", "B12")}


def standardize(raw: DataFrame, family: str) -> DataFrame:
    """Only the standard bands, and quality if there is one, with keys kept.

    A band that already has its standard name wins over the mapped raw one, except in
    families whose raw names clash with standard ones.
    """
    clash = family in ("SPOT_4", "LANDSAT_RAW")
    source = BAND_MAPS[family]
    bands = {}
    for b in STANDARD:
        own = F.lit(None).cast("double") if clash else _raw(raw, b)
        bands[b] = F.coalesce(own, _raw(raw, source[b])) if b in source else own
    if family in BLUE_FROM_GREEN:
        bands["B2"] = F.coalesce(bands["B2"], bands["B3"] * BLUE_FROM_GREEN_STANDARD)
    used = {*STANDARD, *source.values()}
    keys = [F.col(f"`{c}`") for c in raw.columns if c not in used]
    return raw.select(*keys, *[c.cast("float").cast("double").alias(b) for b, c in bands.items()])


def landsat_naming(columns: list[str]) -> str:
    """Which of the three namings of Landsat bands a table has: surface reflectance with or without band 1, or raw."""
    if any(c.startswith("SR_B") for c in columns):
        return "LANDSAT_OLD" if "SR_B1" in columns else "LANDSAT_NEW"
    return "LANDSAT_RAW"


def harmonization_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, a, b) for m, (a, b) in HARMONIZATION.items()], "mode string, a double, b double")


def harmonize(pixels: DataFrame, mode: str | Column) -> DataFrame:
    """The six bands as a * x + b; other columns pass; an unknown mode changes nothing."""
    m = F.lit(mode) if isinstance(mode, str) else mode
    a = F.coalesce(F.create_map(*[F.lit(x) for k, (v, _) in HARMONIZATION.items() for x in (k, v)])[m], F.lit(1.0))
    b = F.coalesce(F.create_map(*[F.lit(x) for k, (_, v) in HARMONIZATION.items() for x in (k, v)])[m], F.lit(0.0))
    return pixels.withColumns({c: F.col(c) * a + b for c in STANDARD})


def harmonize_coarse(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: F.col(c) * COARSE_FACTOR for c in STANDARD})


def download_bands(names: Column) -> Column:
    """Names to deliver, in order, from an array of those present; null without red, green and blue."""

    def has(*options: str) -> Column:
        return F.filter(F.array(*[F.lit(o) for o in options]), lambda o: F.array_contains(names, o))

    def first(*options: str) -> Column:
        return F.slice(has(*options), 1, 1)

    rgb = has("B4", "B3", "B2")
    rgb = F.when(F.size(rgb) < 3, F.concat(rgb, has("SR_B4", "SR_B3", "SR_B2"))).otherwise(rgb)
    rest = (first("B8", "SR_B5"), first("B11", "SR_B6"), first("B12", "SR_B7"), first("MNDWI", "NDWI"), has("NDVI", "EVI", "SAVI", "AVI", "FVI"))
    return F.when(F.size(rgb) >= 3, F.concat(rgb, *rest))


def pivot_bands(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Long (keys, band, value) to one column a band; the list of names saves a pass over the data."""
    return long.groupBy(*keys).pivot("band", names).agg(F.first("value"))


def band_priority(name: Column, order: list[str]) -> Column:
    """Place of the first listed name contained in a band's name, else 9999."""
    found = [F.when(F.upper(name).contains(n.upper()), k) for k, n in enumerate(order)]
    return F.coalesce(*found, F.lit(9999))
