"""Queries over pixels: preparation, masks, indices, composites and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitile.functions import masks
from orbitile.functions.indices import with_indices
from orbitile.operators import bands as bd
from orbitile.operators import blocks as bk
from orbitile.operators import mosaic as mo
from orbitile.operators import raster as ra

from . import views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SIX = ["B4", "B3", "B2", "B8", "B11", "B12"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(names: list[str], digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def rounded_sql(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}::DOUBLE, {digits}) AS {n}" for n in names)


INDEX_SQL = """, ix AS (SELECT *, (B8 - B4) / nullif(B8 + B4, 0) AS NDVI, (B3 - B8) / nullif(B3 + B8, 0) AS NDWI,
  CASE WHEN B11 > 0 THEN (B3 - B11) / nullif(B3 + B11, 0) END AS MNDWI,
  CASE WHEN B8 + 6 * B4 - 7.5 * B2 + 1 > 0 THEN 2.5 * (B8 - B4) / (B8 + 6 * B4 - 7.5 * B2 + 1) END AS EVI,
  1.5 * (B8 - B4) / nullif(B8 + B4 + 0.5, 0) AS SAVI, CASE WHEN B11 > 0 THEN (B8 - B11) / nullif(B8 + B11, 0) END AS FVI FROM v_acq
), av AS (SELECT *, CASE WHEN abs(coalesce(MNDWI, NDWI)) < 0.3 THEN NDVI * (1 - abs(coalesce(MNDWI, NDWI))) END AS AVI FROM ix)"""
INDICES = ["NDVI", "NDWI", "MNDWI", "EVI", "SAVI", "FVI", "AVI"]


@query(views.with_views("v_acq", INDEX_SQL + f" SELECT pixel_id, {rounded_sql(INDICES)} FROM av"))
def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indices(views.acquisitions(spark, sf_dir)).select("pixel_id", *rounded(INDICES))


@query(views.with_views("v_acq", """ SELECT pixel_id, scl BETWEEN 4 AND 7 AS class_ok, coalesce(scl BETWEEN 4 AND 7 AND qa % 101 < 30 AND B4 > 0 AND B3 > 0 AND B2 > 0, false) AS optical_ok,
  (qa & 8) = 0 AND (qa & 16) = 0 AND (qa & 256) = 0 AND (qa & 2) = 0 AND (qa & 32) = 0 AND B4 > 0 AND B4 < 10000 AND B3 > 0 AND B3 < 10000 AS flags_ok,
  (qa & 8) = 0 AND (qa & 16) = 0 AND (qa & 256) = 0 AS basic_ok, (qa & 1) = 0 AS bit0_ok, (B4 + B3) / 2 < 0.6 AS dark, (B4 + B3) / 2 < 0.7 AS dark_coarse,
  coalesce(B4 <> 0 AND B3 <> 0 AND B11 <> 0, false) AS nonzero, coalesce(B11 > 0, false) AS valid, coalesce(B11 <> 0.5 AND B11 <> 0, false) AS valid_nodata,
  qa % 101 < 40 AS probability_ok FROM v_acq"""))
def pixel_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return views.acquisitions(spark, sf_dir).select(
        "pixel_id", masks.scene_class_ok(c("scl")).alias("class_ok"), masks.optical_ok(c("scl"), c("qa") % 101, [c("B4"), c("B3"), c("B2")]).alias("optical_ok"),
        masks.flags_ok(c("qa"), [c("B4"), c("B3")]).alias("flags_ok"), masks.flags_ok_basic(c("qa")).alias("basic_ok"), masks.known(masks.bit_clear(c("qa"), 0)).alias("bit0_ok"),
        masks.dark_enough(c("B4"), c("B3")).alias("dark"), masks.dark_enough(c("B4"), c("B3"), 0.7).alias("dark_coarse"),
        masks.all_nonzero(c("B4"), c("B3"), c("B11")).alias("nonzero"), masks.valid_pixel(c("B11")).alias("valid"), masks.valid_pixel(c("B11"), 0.5).alias("valid_nodata"),
        masks.known(c("qa") % 101 < 40).alias("probability_ok"),
    )


@query(views.with_views("v_acq", """ SELECT sensor, tile_id, count(*) AS n, count(B4) AS kept, sum(CASE WHEN sensor = 'LANDSAT_7' AND acquired > DATE '2001-05-31' AND share < 0.7 THEN 1 ELSE 0 END)::BIGINT AS striped
  FROM (SELECT *, ((B4 IS NOT NULL)::INT + (B11 IS NOT NULL)::INT + (B12 IS NOT NULL)::INT) / 3.0 AS share FROM v_acq) GROUP BY ALL"""))
def stripe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes after the scan-line failure (here: a day within the test range) that are too incomplete to use."""
    known = [F.col(b).isNotNull().cast("int") for b in ("B4", "B11", "B12")]
    share = sum(known[1:], known[0]) / 3.0
    bad = (F.col("sensor") == "LANDSAT_7") & (F.col("acquired") > F.lit("2001-05-31").cast("date")) & (share < 0.7)
    return views.acquisitions(spark, sf_dir).groupBy("sensor", "tile_id").agg(F.count("*").alias("n"), F.count("B4").alias("kept"), F.count_if(bad).alias("striped"))


def _raw(spark: SparkSession, sf_dir: str, names: dict[str, str], *extra: str) -> DataFrame:
    """Pixels whose bands carry a family's raw names."""
    a = views.acquisitions(spark, sf_dir)
    return a.select("pixel_id", *extra, *[F.col(b).alias(raw) for raw, b in names.items()])


@query(views.with_views("v_acq", f""" SELECT pixel_id, {rounded_sql(SIX, 9)} FROM (
  SELECT pixel_id, CASE WHEN ok THEN B4 * 0.0001 END AS B4, CASE WHEN ok THEN B3 * 0.0001 END AS B3, CASE WHEN ok THEN B2 * 0.0001 END AS B2,
         CASE WHEN ok THEN B8 * 0.0001 END AS B8, CASE WHEN ok THEN B11 * 0.0001 END AS B11, CASE WHEN ok THEN B12 * 0.0001 END AS B12
  FROM (SELECT *, (qa & 1) = 0 AS ok FROM v_acq))"""))
def prepare_modis(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {f"sur_refl_b{k}": b for k, b in (("01", "B4"), ("04", "B3"), ("03", "B2"), ("02", "B8"), ("06", "B11"), ("07", "B12"))}
    raw = _raw(spark, sf_dir, names, F.col("qa").alias("state_1km"))
    return bd.prepare(raw, "MODIS").select("pixel_id", *rounded(SIX, 9))


@query(views.with_views("v_acq", f" SELECT pixel_id, {rounded_sql(SIX)} FROM (SELECT pixel_id, B8 AS B4, B3, B2, B8, B11, B12 FROM v_acq)"))
def prepare_aster(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"VNIR_Band3N": "B8", "VNIR_Band2": "B3", "VNIR_Band1": "B2", "SWIR_Band4": "B11", "SWIR_Band6": "B12"}
    return bd.prepare(_raw(spark, sf_dir, names), "ASTER").select("pixel_id", *rounded(SIX))


@query(views.with_views("v_acq", f" SELECT pixel_id, {rounded_sql(SIX)} FROM (SELECT pixel_id, CASE WHEN (qa & 1) = 0 THEN B4 END AS B4, CASE WHEN (qa & 1) = 0 THEN B3 END AS B3, CASE WHEN (qa & 1) = 0 THEN B2 END AS B2, CASE WHEN (qa & 1) = 0 THEN B8 END AS B8, CASE WHEN (qa & 1) = 0 THEN B11 END AS B11, CASE WHEN (qa & 1) = 0 THEN B12 END AS B12 FROM v_acq)"))
def prepare_viirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"I1": "B4", "M3": "B3", "I3": "B2", "I2": "B8", "M11": "B11", "M12": "B12"}
    return bd.prepare(_raw(spark, sf_dir, names, F.col("qa").alias("QF1")), "VIIRS").select("pixel_id", *rounded(SIX))


def _dark_sql(blue: float, swir: str, limit: float = 0.6) -> str:
    one = lambda e: f"CASE WHEN (B4 + B3) / 2 < {limit} THEN {e} END"
    names = {"B4": "B4", "B3": "B3", "B2": f"B3 * {blue}", "B8": "B8", "B11": swir, "B12": "NULL"}
    return views.with_views("v_acq", f" SELECT pixel_id, {', '.join(f'round(({one(e)})::DOUBLE, 6) AS {b}' for b, e in names.items())} FROM v_acq")


@query(_dark_sql(0.9, "NULL"))
def prepare_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.prepare(_raw(spark, sf_dir, {"XS1": "B3", "XS2": "B4", "XS3": "B8"}), "SPOT").select("pixel_id", *rounded(SIX))


@query(_dark_sql(0.9, "B11"))
def prepare_spot4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.prepare(_raw(spark, sf_dir, {"B1": "B3", "B2": "B4", "B3": "B8", "MIR": "B11"}), "SPOT_4").select("pixel_id", *rounded(SIX))


@query(_dark_sql(0.85, "B11"))
def prepare_mss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.prepare(_raw(spark, sf_dir, {"SR_B1": "B3", "SR_B2": "B4", "SR_B3": "B8", "SR_B4": "B11"}), "MSS").select("pixel_id", *rounded(SIX))


@query(views.with_views("v_acq", f""", n AS (SELECT pixel_id, B4 - B3 AS v FROM v_acq), p AS (SELECT pixel_id, 0.5 * v + 0.3 AS B4, 0.5 * v + 0.4 AS B3, 0.4 * v + 0.3 AS B2, 0.6 * v + 0.5 AS B8 FROM n)
SELECT pixel_id, {', '.join(f'round(CASE WHEN (B4 + B3) / 2 < 0.7 THEN {b} END::DOUBLE, 6) AS {b}' for b in SIX[:4])}, NULL::DOUBLE AS B11, NULL::DOUBLE AS B12 FROM p"""))
def prepare_avhrr_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.acquisitions(spark, sf_dir).select("pixel_id", (F.col("B4") - F.col("B3")).alias("NDVI"))
    return bd.prepare(raw, "AVHRR").select("pixel_id", *rounded(SIX))


@query(views.with_views("v_acq", f""", p AS (SELECT pixel_id, B4, B4 * 0.9 AS B3, B4 * 0.8 AS B2, B8 FROM v_acq)
SELECT pixel_id, {', '.join(f'round(CASE WHEN (B4 + B3) / 2 < 0.7 THEN {b} END::DOUBLE, 6) AS {b}' for b in SIX[:4])}, NULL::DOUBLE AS B11, NULL::DOUBLE AS B12 FROM p"""))
def prepare_avhrr_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.prepare(_raw(spark, sf_dir, {"ch1": "B4", "ch2": "B8"}), "AVHRR").select("pixel_id", *rounded(SIX))


def _landsat(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Flag mask, standard bands and indices of one Landsat naming."""
    raw = _raw(spark, sf_dir, {v: k for k, v in bd.BAND_MAPS[family].items()}, "qa")
    out = bd.prepare(raw, bd.landsat_naming(raw.columns))
    ok = masks.flags_ok(F.col("qa"), [F.col(b) for b in ("B4", "B3", "B2")])
    return with_indices(out.withColumns(masks.masked(ok, *SIX))).select("pixel_id", *rounded([*SIX, "NDVI", "MNDWI"]))


_LANDSAT_SQL = views.with_views("v_acq", f""", m AS (SELECT * EXCLUDE (B4, B3, B2, B8, B11, B12), {', '.join(f'CASE WHEN ok THEN {b} END AS {b}' for b in SIX)} FROM (
  SELECT *, (qa & 314) = 0 AND B4 > 0 AND B4 < 10000 AND B3 > 0 AND B3 < 10000 AND B2 > 0 AND B2 < 10000 AS ok FROM v_acq))
SELECT pixel_id, {rounded_sql(SIX)}, round((B8 - B4) / nullif(B8 + B4, 0), 6) AS NDVI, round(CASE WHEN B11 > 0 THEN (B3 - B11) / nullif(B3 + B11, 0) END, 6) AS MNDWI FROM m""")


@query(_LANDSAT_SQL)
def prepare_landsat_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landsat(spark, sf_dir, "LANDSAT_OLD")


@query(_LANDSAT_SQL)
def prepare_landsat_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landsat(spark, sf_dir, "LANDSAT_NEW")


@query(_LANDSAT_SQL)
def prepare_landsat_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landsat(spark, sf_dir, "LANDSAT_RAW")


@query(views.with_views("v_acq", f""" SELECT pixel_id, {', '.join(f'round(CASE WHEN ok THEN {b} END::DOUBLE, 6) AS {b}' for b in SIX)} FROM (
  SELECT *, scl BETWEEN 4 AND 7 AND qa % 101 < 30 AND B4 > 0 AND B3 > 0 AND B2 > 0 AS ok FROM v_acq)"""))
def prepare_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.acquisitions(spark, sf_dir)
    ok = masks.optical_ok(F.col("scl"), F.col("qa") % 101, [F.col(b) for b in ("B4", "B3", "B2")])
    return a.withColumns(masks.masked(ok, *SIX)).select("pixel_id", *rounded(SIX))


@query(views.with_views("v_acq", """ SELECT pixel_id, round(B4::FLOAT::DOUBLE, 6) AS B4, round(B3::FLOAT::DOUBLE, 6) AS B3, round((B3::FLOAT::DOUBLE * 0.875), 5) AS B2, round(B8::FLOAT::DOUBLE, 6) AS B8,
  round(B11::FLOAT::DOUBLE, 6) AS B11, NULL::DOUBLE AS B12 FROM v_acq"""))
def standardized_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir, {"SR_B1": "B3", "SR_B2": "B4", "SR_B3": "B8", "SR_B4": "B11"})
    return bd.standardize(raw, "MSS").select("pixel_id", *rounded(["B4", "B3"]), F.round("B2", 5).alias("B2"), *rounded(["B8", "B11", "B12"]))


@query(views.with_views("v_acq", f""", h AS (SELECT *, CASE WHEN sensor LIKE 'SPOT%' THEN 1.00 WHEN sensor = 'LANDSAT_5' THEN 1.02 WHEN sensor = 'LANDSAT_7' THEN 0.95 ELSE 1 END AS a,
  CASE WHEN sensor = 'LANDSAT_5' THEN -0.01 WHEN sensor = 'LANDSAT_7' THEN 0.02 ELSE 0 END AS b FROM v_acq)
SELECT pixel_id, {', '.join(f'round((CASE WHEN sensor LIKE $$MODIS%$$ THEN {x} * 1.05 ELSE {x} * a + b END)::DOUBLE, 9) AS {x}' for x in SIX)} FROM h"""))
def harmonized_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.acquisitions(spark, sf_dir)
    mode = F.when(F.col("sensor").startswith("SPOT"), "SPOT_to_LS").when(F.col("sensor") == "LANDSAT_5", "LS_to_S2").when(F.col("sensor") == "LANDSAT_7", "MSS_to_LS").otherwise("NONE")
    coarse = bd.harmonize_coarse(a.where(F.col("sensor").startswith("MODIS")))
    return bd.harmonize(a.where(~F.col("sensor").startswith("MODIS")), mode).unionByName(coarse).select("pixel_id", *rounded(SIX, 9))


_MODES = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in bd.HARMONIZATION.items())


@query(views.with_views("v_acq", f", t(mode, a, b) AS (VALUES {_MODES}), q AS (SELECT CASE qa % 4 WHEN 0 THEN 'MSS_to_LS' WHEN 1 THEN 'LS_to_S2' WHEN 2 THEN 'SPOT_to_LS' ELSE 'other' END AS mode, B4 FROM v_acq) SELECT mode, coalesce(a, 1.0::DOUBLE) AS a, coalesce(b, 0.0::DOUBLE) AS b, count(*) AS n FROM q LEFT JOIN t USING (mode) GROUP BY ALL"))
def harmonization_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and offset of the pixels' modes; a mode that the table lacks changes nothing."""
    k = F.col("qa") % 4
    mode = F.when(k == 0, "MSS_to_LS").when(k == 1, "LS_to_S2").when(k == 2, "SPOT_to_LS").otherwise("other")
    counted = views.acquisitions(spark, sf_dir).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))
    joined = counted.join(F.broadcast(bd.harmonization_table(spark)), "mode", "left")  # a constant of a few rows
    return joined.select("mode", F.coalesce("a", F.lit(1.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"), "n")


_PRESENT = ["B4", "B3", "B2", "SR_B4", "SR_B3", "SR_B2", "B8", "SR_B5", "B11", "SR_B6", "B12", "SR_B7", "MNDWI", "NDWI", "NDVI", "EVI", "SAVI", "AVI", "FVI"]


@query(f"""WITH k AS (SELECT DISTINCT (o_orderkey * 104729) % 524288 AS code FROM orders
), b AS (SELECT code, list_filter({_PRESENT}, lambda x: (code >> (list_position({_PRESENT}, x) - 1)) & 1 = 1) AS s FROM k
), r AS (SELECT code, s, list_filter(['B4', 'B3', 'B2'], lambda x: list_contains(s, x)) AS rgb FROM b
), r2 AS (SELECT code, s, CASE WHEN len(rgb) < 3 THEN rgb || list_filter(['SR_B4', 'SR_B3', 'SR_B2'], lambda x: list_contains(s, x)) ELSE rgb END AS rgb FROM r)
SELECT code, CASE WHEN len(rgb) >= 3 THEN array_to_string(rgb || list_filter(['B8', 'SR_B5'], lambda x: list_contains(s, x))[1:1] || list_filter(['B11', 'SR_B6'], lambda x: list_contains(s, x))[1:1]
  || list_filter(['B12', 'SR_B7'], lambda x: list_contains(s, x))[1:1] || list_filter(['MNDWI', 'NDWI'], lambda x: list_contains(s, x))[1:1]
  || list_filter(['NDVI', 'EVI', 'SAVI', 'AVI', 'FVI'], lambda x: list_contains(s, x)), ',') ELSE 'missing_bands' END AS bands FROM r2""")
def download_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = views.read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 104729 % 524288).alias("code")).distinct()
    present = F.filter(F.array(*[F.when(F.shiftright("code", k) % 2 == 1, n) for k, n in enumerate(_PRESENT)]), lambda b: b.isNotNull())
    return codes.select("code", F.coalesce(F.array_join(bd.download_bands(present), ","), F.lit("missing_bands")).alias("bands"))


@query(views.with_views("v_acq", f" SELECT pixel_id, {rounded_sql(SIX)} FROM v_acq"))
def bands_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-band rows (as from an archive of one file a band) back to one row a pixel.

    Pixels of one number are told apart by their place among those, which is the same in every run but for equal rows.
    """
    place = F.row_number().over(Window.partitionBy("pixel_id").orderBy(*SIX))
    a = views.acquisitions(spark, sf_dir).select("pixel_id", *SIX, place.alias("place"))
    long = a.select("pixel_id", "place", F.explode(F.create_map(*[x for b in SIX for x in (F.lit(b), F.col(b))])).alias("band", "value"))
    return bd.pivot_bands(long, ["pixel_id", "place"], SIX).select("pixel_id", *rounded(SIX))


# composites: the pixels of a tile on a 16 x 16 grid, several scenes to a cell

_STACK_SQL = """, stack AS (SELECT tile_id, (pixel_id % 16)::INTEGER AS row, (pixel_id // 16 % 16)::INTEGER AS col, pixel_id AS scene_id, B4, B3, CASE WHEN pixel_id % 5 <> 0 THEN B2 END AS B2, B8, B11, B12,
  round(((pixel_id * 31) % 1000) / 1000.0, 3)::DOUBLE AS quality FROM v_acq)"""


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.acquisitions(spark, sf_dir)
    k = F.col("pixel_id")
    return a.select(
        "tile_id", (k % 16).cast("int").alias("row"), F.floor(k / 16 % 16).cast("int").alias("col"), k.alias("scene_id"), "B4", "B3", F.when(k % 5 != 0, F.col("B2")).alias("B2"),
        "B8", "B11", "B12", F.round((k * 31 % 1000) / 1000.0, 3).alias("quality"),
    )


_PICK = ", ".join(f"arg_max({b}, round(quality * 1000)::HUGEINT * 10000000000000000 - scene_id) FILTER (WHERE {b} IS NOT NULL) AS {b}" for b in SIX)


@query(views.with_views("v_acq", _STACK_SQL + f" SELECT tile_id, row, col, {rounded_sql(SIX)} FROM (SELECT tile_id, row, col, {_PICK} FROM stack GROUP BY ALL)"))
def quality_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.quality_mosaic(_stack(spark, sf_dir)).select("tile_id", "row", "col", *rounded(SIX))


@query(views.with_views("v_acq", _STACK_SQL + f""" , best AS (SELECT *, row_number() OVER (PARTITION BY tile_id, row, col ORDER BY (B4 IS NOT NULL AND B3 IS NOT NULL AND B2 IS NOT NULL) DESC, quality DESC, scene_id) AS r,
  B4 IS NOT NULL AND B3 IS NOT NULL AND B2 IS NOT NULL AS whole FROM stack)
SELECT tile_id, row, col, {', '.join(f'round(CASE WHEN whole THEN {b} END::DOUBLE, 6) AS {b}' for b in SIX)} FROM best WHERE r = 1"""))
def quality_mosaic_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.quality_mosaic(_stack(spark, sf_dir), mode="pixel").select("tile_id", "row", "col", *rounded(SIX))


@query(views.with_views("v_acq", _STACK_SQL + f" SELECT tile_id, row, col, {', '.join(f'round(median({b}), 6) AS {b}' for b in SIX)} FROM stack GROUP BY ALL"))
def median_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.median_mosaic(_stack(spark, sf_dir)).select("tile_id", "row", "col", *rounded(SIX))


@query(views.with_views("v_acq", _STACK_SQL + f" SELECT tile_id, row, col, {', '.join(f'round(avg({b}), 9) AS {b}' for b in SIX)} FROM stack GROUP BY ALL"))
def mean_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.mean_mosaic(_stack(spark, sf_dir)).select("tile_id", "row", "col", *rounded(SIX, 9))


@query(views.with_views("v_acq", _STACK_SQL + f" SELECT tile_id, row, col, {', '.join(f'round(arg_min({b}, scene_id) FILTER (WHERE {b} IS NOT NULL), 6) AS {b}' for b in SIX)} FROM stack GROUP BY ALL"))
def first_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.first_mosaic(_stack(spark, sf_dir)).select("tile_id", "row", "col", *rounded(SIX))


@query(views.with_views("v_acq", _STACK_SQL + " SELECT tile_id, round((avg((B4 IS NOT NULL)::INT) + avg((B3 IS NOT NULL)::INT) + avg((B2 IS NOT NULL)::INT)) / 3, 6) AS coverage FROM stack GROUP BY tile_id"))
def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.coverage(_stack(spark, sf_dir), keys=["tile_id"]).withColumn("coverage", F.round("coverage", 6))


@query(views.with_views("v_acq", _STACK_SQL + """, coarse AS (SELECT tile_id, row // 4 AS r, col // 4 AS c, avg((B2 IS NOT NULL)::INT) AS v FROM stack GROUP BY ALL)
SELECT tile_id, round(avg((v >= 0.5)::INT), 6) AS coverage FROM coarse GROUP BY tile_id"""))
def coarse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage estimated on coarse cells, each valid if half of its pixels are."""
    coarse = _stack(spark, sf_dir).groupBy("tile_id", F.floor(F.col("row") / 4).alias("r"), F.floor(F.col("col") / 4).alias("c")).agg(F.avg(F.col("B2").isNotNull().cast("double")).alias("v"))
    return coarse.groupBy("tile_id").agg(F.round(F.avg((F.col("v") >= 0.5).cast("double")), 6).alias("coverage"))


# chips in groups: overlapping tiles, shifted by four columns each

_W = "CASE WHEN d < 3 THEN 0.5 * (1 {} cos(pi() * d / 3.0)) ELSE 1.0 END"


def _feather_sql(sign: str) -> str:
    return views.with_views("v_chip", f""", placed AS (SELECT grp, row, col + 4 * (chip % 3) AS x, value, least(row, col, 7 - row, 7 - col) AS d FROM v_chip
), w AS (SELECT grp, row, x, CASE WHEN value > 0 THEN value END AS value, {_W.format(sign)} AS w FROM placed)
SELECT grp, row, x, round(sum(value * w) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0), 4) AS value FROM w GROUP BY ALL""")


def _feather(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    c = views.chips(spark, sf_dir)
    w = mo.feather_weight(F.col("row"), F.col("col"), F.lit(8), F.lit(8), 3, mode=mode)
    c = c.withColumns({"x": F.col("col") + 4 * (F.col("chip") % 3), "weight": w, "value": F.when(masks.valid_pixel(F.col("value")), F.col("value"))})
    return mo.feather_merge(c, keys=["grp", "row", "x"]).withColumn("value", F.round("value", 4))


@query(_feather_sql("-"))
def feather_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feather(spark, sf_dir, "intent")


@query(_feather_sql("+"))
def feather_merge_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feather(spark, sf_dir, "literal")


_OTSU_SQL = """, ranges AS (SELECT chip, min(value) AS lo, max(value) AS hi FROM v_chip GROUP BY chip
), h AS (SELECT chip, lo, hi, bin, lo + (bin + 0.5::DOUBLE) * ((hi - lo) / 256) AS centre, count(*) AS n
         FROM (SELECT chip, lo, hi, coalesce(least(255, floor((value - lo) / nullif((hi - lo) / 256, 0)))::INT, 0) AS bin FROM v_chip JOIN ranges USING (chip)) GROUP BY ALL
), c AS (SELECT *, sum(n) OVER u AS w0, sum(n * centre) OVER u AS s0, sum(n) OVER p AS w, sum(n * centre) OVER p AS s FROM h
         WINDOW u AS (PARTITION BY chip ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY chip)
), b AS (SELECT *, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / nullif(w - w0, 0)) ** 2, 6) AS between_ FROM c
), t AS (SELECT chip, CASE WHEN lo = hi THEN lo ELSE centre END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY chip ORDER BY between_ DESC NULLS LAST, bin) AS r FROM b) WHERE r = 1)"""


@query(views.with_views("v_chip", _OTSU_SQL + " SELECT chip, round(threshold, 6) AS threshold FROM t"))
def otsu_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.otsu_thresholds(views.chips(spark, sf_dir)).select("chip", F.round("threshold", 6).alias("threshold"))


_MASK_SQL = _OTSU_SQL + ", m AS (SELECT chip, row, col, value >= threshold AS mask FROM v_chip JOIN t USING (chip))"


@query(views.with_views("v_chip", _MASK_SQL + " SELECT chip, row, col, mask FROM m"))
def water_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.water_mask(views.chips(spark, sf_dir)).select("chip", "row", "col", "mask")


#: Cells of a chip's side: each is a block of its own.
SIDE = 8


def _chip_blocks(pixels: DataFrame) -> DataFrame:
    return bk.to_blocks(pixels, keys=["chip"], value="value", height=SIDE, width=SIDE, block=SIDE)


def _chip_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = ra.water_mask(views.chips(spark, sf_dir))
    return _chip_blocks(mask.select("chip", "row", "col", F.col("mask").cast("int").alias("value")))


def _mask_pixels(blocks: DataFrame) -> DataFrame:
    return bk.to_pixels(blocks, keys=["chip"], block=SIDE).select("chip", "row", "col", (F.col("value") == 1).alias("mask"))


@query(views.with_views("v_chip", _MASK_SQL + """, d AS (SELECT a.chip, a.row, a.col, bool_or(b.mask) AS mask FROM m a JOIN m b ON a.chip = b.chip AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4 GROUP BY ALL)
SELECT a.chip, a.row, a.col, bool_and(b.mask) AS mask FROM d a JOIN d b ON a.chip = b.chip AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4 GROUP BY ALL"""))
def closed_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_pixels(bk.close_mask(_chip_masks(spark, sf_dir), 2, keys=["chip"], block=SIDE))


@query(views.with_views("v_chip", _MASK_SQL + " SELECT a.chip, a.row, a.col, bool_or(b.mask) AS mask FROM m a JOIN m b ON a.chip = b.chip AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL"))
def dilated_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_pixels(bk.dilate(_chip_masks(spark, sf_dir), bk.square(2), keys=["chip"], block=SIDE))


@query("WITH RECURSIVE " + views.SQL["v_chip"] + _MASK_SQL + """, seed AS (SELECT chip, row, col, row * 8 + col AS label FROM m WHERE mask
), reach AS (SELECT chip, row, col, label FROM seed UNION SELECT s.chip, s.row, s.col, r.label FROM reach r JOIN seed s ON s.chip = r.chip AND abs(s.row - r.row) + abs(s.col - r.col) = 1
), root AS (SELECT chip, row, col, min(label) AS label FROM reach GROUP BY ALL), n AS (SELECT chip, label, count(*) AS size FROM root GROUP BY ALL)
SELECT m.chip, m.row, m.col, coalesce(size >= 5, false) AS mask FROM m LEFT JOIN root USING (chip, row, col) LEFT JOIN n ON n.chip = root.chip AND n.label = root.label""")
def small_objects_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_pixels(bk.remove_small(_chip_masks(spark, sf_dir), 5, keys=["chip"], block=SIDE))


_GAP_SQL = ", g AS (SELECT chip, row, col, CASE WHEN value > 0.45 THEN value END AS value FROM v_chip)"


@query(views.with_views("v_chip", _GAP_SQL + """, near AS (SELECT a.chip, a.row, a.col, b.value AS v, row_number() OVER (PARTITION BY a.chip, a.row, a.col ORDER BY (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.row, b.col) AS r
  FROM g a JOIN g b ON a.chip = b.chip AND a.value IS NULL AND b.value IS NOT NULL AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9)
SELECT g.chip, g.row, g.col, round(coalesce(g.value, near.v), 6) AS value FROM g LEFT JOIN near ON near.chip = g.chip AND near.row = g.row AND near.col = g.col AND r = 1"""))
def nearest_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = views.chips(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0.45, F.col("value"))).select("chip", "row", "col", "value")
    filled = bk.fill_nearest(_chip_blocks(gaps), 3, keys=["chip"], block=SIDE)
    return bk.to_pixels(filled, keys=["chip"], block=SIDE).withColumn("value", F.round("value", 6))


@query(views.with_views("v_chip", " " + " UNION ALL ".join(f"SELECT chip, {k}::INTEGER AS level, (row // {k})::INTEGER AS row, (col // {k})::INTEGER AS col, round(avg(value), 6) AS value FROM v_chip GROUP BY ALL" for k in (2, 4, 8))))
def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.pyramid(views.chips(spark, sf_dir), (2, 4, 8)).select("chip", "level", "row", "col", F.round("value", 6).alias("value"))


@query(views.with_views("v_chip", """, fine AS (SELECT chip, y.r AS row, x.c AS col FROM (SELECT DISTINCT chip FROM v_chip), (SELECT unnest(range(16))::INTEGER AS r) y, (SELECT unnest(range(16))::INTEGER AS c) x
), at AS (SELECT *, greatest(0.0, least(7.0, (row + 0.5) / 2 - 0.5)) AS sr, greatest(0.0, least(7.0, (col + 0.5) / 2 - 0.5)) AS sc FROM fine)""".replace(" at AS", " spots AS") + """
SELECT a.chip, a.row, a.col, round(sum(p.value * (1 - abs(sr - p.row)) * (1 - abs(sc - p.col))) / sum((1 - abs(sr - p.row)) * (1 - abs(sc - p.col))), 6) AS value
FROM spots a JOIN v_chip p ON p.chip = a.chip AND abs(sr - p.row) < 1 AND abs(sc - p.col) < 1 GROUP BY ALL"""))
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = bk.resample(_chip_blocks(views.chips(spark, sf_dir)), 2, keys=["chip"], block=SIDE, method="linear")
    return bk.to_pixels(fine, keys=["chip"], block=2 * SIDE).withColumn("value", F.round("value", 6))


_CUBIC = "CASE WHEN abs({d}) <= 1 THEN 1.5 * abs({d}) ** 3 - 2.5 * {d} ** 2 + 1 WHEN abs({d}) < 2 THEN -0.5 * abs({d}) ** 3 + 2.5 * {d} ** 2 - 4 * abs({d}) + 2 ELSE 0 END"


@query(views.with_views("v_chip", f""", holes AS (SELECT chip, row, col, value FROM v_chip WHERE (chip * 7 + row * 5 + col * 3) % 23 <> 0
), fine AS (SELECT chip, y.r AS row, x.c AS col, (y.r + 0.5) / 2 - 0.5 AS sr, (x.c + 0.5) / 2 - 0.5 AS sc FROM (SELECT DISTINCT chip FROM v_chip), (SELECT unnest(range(16))::INTEGER AS r) y, (SELECT unnest(range(16))::INTEGER AS c) x
), taps AS (SELECT f.*, floor(sr) + i AS tr, floor(sc) + j AS tc FROM fine f, (SELECT unnest(range(-1, 3)) AS i), (SELECT unnest(range(-1, 3)) AS j)
), met AS (SELECT t.*, h.value, ({_CUBIC.format(d="(sr - tr)")}) * ({_CUBIC.format(d="(sc - tc)")}) AS w,
  greatest(0, 1 - abs(greatest(0, least(7, sr)) - h.row)) * greatest(0, 1 - abs(greatest(0, least(7, sc)) - h.col)) AS lin, h.row AS hr, h.col AS hc
  FROM taps t LEFT JOIN holes h ON h.chip = t.chip AND h.row = greatest(0, least(7, tr)) AND h.col = greatest(0, least(7, tc))
), cubic AS (SELECT chip, row, col, CASE WHEN count(*) = count(value) THEN sum(w * value) END AS v FROM met GROUP BY ALL
), linear AS (SELECT chip, row, col, sum(lin * value) / nullif(sum(lin), 0) AS v FROM (SELECT DISTINCT chip, row, col, hr, hc, lin, value FROM met WHERE value IS NOT NULL) GROUP BY ALL
) SELECT c.chip, c.row, c.col, round(coalesce(c.v, l.v), 6) AS value FROM cubic c LEFT JOIN linear l USING (chip, row, col) WHERE coalesce(c.v, l.v) IS NOT NULL"""))
def resampled_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic where all pixels around are known, bilinear over the known ones elsewhere."""
    px = views.chips(spark, sf_dir).where((F.col("chip") * 7 + F.col("row") * 5 + F.col("col") * 3) % 23 != 0)
    fine = bk.resample(_chip_blocks(px), 2, keys=["chip"], block=SIDE)
    return bk.to_pixels(fine, keys=["chip"], block=2 * SIDE).where("value IS NOT NULL").withColumn("value", F.round("value", 6))


@query(views.with_views("v_chip", " SELECT chip, CASE WHEN n = 0 THEN 'empty' WHEN n * 8 < 300 THEN 'too_small' WHEN bad > 0 THEN 'bad_values' ELSE 'ok' END AS status FROM (SELECT chip, count(*) FILTER (WHERE value > 0.5) AS n, count(*) FILTER (WHERE value > 0.95) AS bad FROM v_chip GROUP BY chip)"))
def chip_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered checks of a stored chip: empty, too small, bad values, ok."""
    n, bad = F.count_if(F.col("value") > 0.5), F.count_if(F.col("value") > 0.95)
    checked = views.chips(spark, sf_dir).groupBy("chip").agg(n.alias("n"), bad.alias("bad"))
    status = F.when(F.col("n") == 0, "empty").when(F.col("n") * 8 < 300, "too_small").when(F.col("bad") > 0, "bad_values").otherwise("ok")
    return checked.select("chip", status.alias("status"))


# mosaics: chips side by side, in blocks that their objects, holes and gaps cross

MOSAIC, CUT = 5 * SIDE, 20


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mosaic, row, col, value): five by five chips."""
    c, k = F.col, F.col("chip") % 25
    return views.chips(spark, sf_dir).select(
        F.floor(c("chip") / 25).alias("mosaic"), (F.floor(k / 5) * SIDE + c("row")).cast("int").alias("row"), (k % 5 * SIDE + c("col")).cast("int").alias("col"), "value"
    )


_MOSAIC_SQL = ", mo AS (SELECT chip // 25 AS mosaic, (chip % 25 // 5 * 8 + row)::INTEGER AS row, (chip % 5 * 8 + col)::INTEGER AS col, value FROM v_chip)"


def _mosaic_blocks(pixels: DataFrame, value: str = "value") -> DataFrame:
    return bk.to_blocks(pixels, keys=["mosaic"], value=value, height=MOSAIC, width=MOSAIC, block=CUT)


@query("WITH RECURSIVE " + views.SQL["v_chip"] + _MOSAIC_SQL + """, seed AS (SELECT mosaic, row, col, row * 40 + col AS label FROM mo WHERE value > 0.5
), reach AS (SELECT mosaic, row, col, label FROM seed UNION SELECT s.mosaic, s.row, s.col, r.label FROM reach r JOIN seed s ON s.mosaic = r.mosaic AND ((s.row = r.row AND s.col = r.col - 1) OR (s.row = r.row AND s.col = r.col + 1) OR (s.col = r.col AND s.row = r.row - 1) OR (s.col = r.col AND s.row = r.row + 1))
), root AS (SELECT mosaic, row, col, min(label) AS label FROM reach GROUP BY ALL), n AS (SELECT mosaic, label, count(*) AS size FROM root GROUP BY ALL)
SELECT mosaic, row, col FROM root JOIN n USING (mosaic, label) WHERE size >= 40""")
def mosaic_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of forty cells or more, also those that cross blocks."""
    mask = _mosaic(spark, sf_dir).withColumn("value", (F.col("value") > 0.5).cast("int"))
    kept = bk.remove_small(_mosaic_blocks(mask), 40, keys=["mosaic"], block=CUT)
    return bk.to_pixels(kept, keys=["mosaic"], block=CUT).where("value = 1").select("mosaic", "row", "col")


@query(views.with_views("v_chip", _MOSAIC_SQL + """, m AS (SELECT mosaic, row, col, value > 0.55 AS mask FROM mo
), near AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 4
), d AS (SELECT DISTINCT a.mosaic, a.row + i AS row, a.col + j AS col FROM m a, near WHERE mask AND a.row + i BETWEEN 0 AND 39 AND a.col + j BETWEEN 0 AND 39
), frame AS (SELECT mosaic, r::INTEGER AS row, c::INTEGER AS col FROM (SELECT DISTINCT mosaic FROM mo), (SELECT unnest(range(40)) AS r), (SELECT unnest(range(40)) AS c)
), gone AS (SELECT DISTINCT f.mosaic, f.row + i AS row, f.col + j AS col FROM (SELECT * FROM frame ANTI JOIN d USING (mosaic, row, col)) f, near)
SELECT mosaic, row, col FROM frame ANTI JOIN gone USING (mosaic, row, col) SEMI JOIN m USING (mosaic, row, col)"""))
def mosaic_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks closed across the borders of blocks; only places with a chip are listed."""
    mask = _mosaic(spark, sf_dir).withColumn("value", (F.col("value") > 0.55).cast("int"))
    closed = bk.to_pixels(bk.close_mask(_mosaic_blocks(mask), 2, keys=["mosaic"], block=CUT), keys=["mosaic"], block=CUT)
    return closed.where("value = 1").join(mask.select("mosaic", "row", "col"), ["mosaic", "row", "col"], "left_semi").select("mosaic", "row", "col")


@query(views.with_views("v_chip", _MOSAIC_SQL + """, band AS (SELECT mosaic, b::INTEGER AS band, row, col, CASE WHEN (row * 7 + col * 11 + mosaic + b) % 211 < 3 THEN value END AS value FROM mo, (SELECT unnest([3, 4]) AS b)
), near AS (SELECT a.mosaic, a.band, a.row, a.col, arg_min(b.value, ((a.row - b.row) ** 2 + (a.col - b.col) ** 2) * 10000 + b.row * 100 + b.col) AS v
  FROM band a JOIN band b ON a.mosaic = b.mosaic AND a.band = b.band AND a.band >= 4 AND a.value IS NULL AND b.value IS NOT NULL AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 400 GROUP BY ALL)
SELECT mosaic, band, row, col, round(coalesce(band.value, near.v), 6) AS value FROM band LEFT JOIN near USING (mosaic, band, row, col) WHERE coalesce(band.value, near.v) IS NOT NULL"""))
def mosaic_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of bands from the fourth on take the nearest value within twenty cells; those of the third stay."""
    c = F.col
    px = _mosaic(spark, sf_dir).withColumn("band", F.explode(F.array(F.lit(3), F.lit(4))))
    px = px.withColumn("value", F.when((c("row") * 7 + c("col") * 11 + c("mosaic") + c("band")) % 211 < 3, c("value")))
    blocks = bk.to_blocks(px, keys=["mosaic", "band"], value="value", height=MOSAIC, width=MOSAIC, block=CUT)
    filled = bk.fill_nearest(blocks, 20, keys=["mosaic", "band"], block=CUT, where=c("band") >= 4)
    held = px.select("mosaic", "band", "row", "col")
    out = bk.to_pixels(filled, keys=["mosaic", "band"], block=CUT).where("value IS NOT NULL").join(held, ["mosaic", "band", "row", "col"], "left_semi")
    return out.select("mosaic", "band", "row", "col", F.round("value", 6).alias("value"))


@query(views.with_views("v_chip", f""", t AS (SELECT grp, b::INTEGER AS band, row, col, 1000.0 + 40 * (chip % 3) AS x0, 5000.0 - 30 * (chip % 2) AS y0, CASE WHEN b = 1 OR value > 0.7 THEN value END AS value, least(row, col, 7 - row, 7 - col) AS d FROM v_chip, (SELECT unnest([1, 4]) AS b) WHERE grp % 2 = 0 OR chip % 3 > 0
), e AS (SELECT grp, min(x0) AS x, max(y0) AS y FROM t GROUP BY grp
), w AS (SELECT grp, band, (row + (y - y0) / 10)::INTEGER AS row, (col + (x0 - x) / 10)::INTEGER AS col, CASE WHEN value > 0 THEN value END AS value, {_W.format("-")} AS w FROM t JOIN e USING (grp)
), m AS (SELECT grp, band, row, col, sum(value * w) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0) AS value FROM w GROUP BY ALL
), near AS (SELECT a.grp, a.row, a.col, arg_min(b.value, ((a.row - b.row) ** 2 + (a.col - b.col) ** 2) * 10000 + b.row * 100 + b.col) AS v FROM m a JOIN m b ON a.grp = b.grp AND a.band = 4 AND b.band = 4 AND a.value IS NULL AND b.value IS NOT NULL AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9 GROUP BY ALL)
SELECT grp, band, row, col, round(coalesce(m.value, CASE WHEN band = 4 THEN near.v END), 4) AS value FROM m LEFT JOIN near USING (grp, row, col)"""))
def merged_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles placed by their corners, feathered, and then filled from the fourth band on."""
    c = F.col
    t = views.chips(spark, sf_dir).where((c("grp") % 2 == 0) | (c("chip") % 3 > 0)).withColumn("band", F.explode(F.array(F.lit(1), F.lit(4))))
    known = masks.valid_pixel(c("value")) & ((c("band") == 1) | (c("value") > 0.7))
    t = t.select("grp", "band", "row", "col", (1000.0 + 40 * (c("chip") % 3)).alias("x0"), (5000.0 - 30 * (c("chip") % 2)).alias("y0"), F.lit(10.0).alias("step"), F.when(known, c("value")).alias("value"))
    return mo.merge_tiles(t, SIDE, 3, 3, keys=["grp"], block=SIDE).select("grp", "band", "row", "col", F.round("value", 4).alias("value"))
