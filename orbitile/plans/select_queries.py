"""Queries over scene metadata: gating, scoring, selection and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitile.functions import scoring as sc
from orbitile.operators import selection as sel
from orbitile.sources.sensors import OPEN_END, SENSORS, families_available, operational, sensor_catalog

from . import views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
N_TESTS = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL pieces of the oracle, written from the definitions ---------------------------------

SENSOR_ROWS = ", ".join(f"('{n}', DATE '{s}', {f"DATE '{e}'" if e else 'NULL'}, {r}::DOUBLE, '{f}')" for n, s, e, r, f in SENSORS)
SENSOR_SQL = f"sensor_catalog(name, s, e, native_res, family) AS (VALUES {SENSOR_ROWS})"
CLOUD_SQL = "CASE WHEN cloud_pct IS NOT NULL THEN greatest(0.0, least(1.0, cloud_pct / 100.0)) ELSE coalesce(1.0 - mask_mean, 0.5) END"
VALID_SQL = "CASE WHEN cloud_pct IS NULL THEN coalesce(mask_mean, 0.5) ELSE 0.5 END"


def score_sql(cloud: str, sun: str, view: str, valid: str, days: str, span: str, res: str, share: str) -> str:
    d = f"abs({days} - {span} / 2.0)"
    return f"""(0.25 * greatest(0, 1 - 1.5 * ({cloud}))
      + 0.15 * CASE WHEN {sun} IS NULL OR {sun} < 30 THEN 1 WHEN {sun} > 60 THEN greatest(0.2, 1 - ({sun} - 60) / 60) ELSE 1 - ({sun} - 30) / 100 END
      + 0.10 * CASE WHEN {view} > 10 THEN greatest(0.5, 1 - ({view} - 10) / 40) ELSE 1 END
      + 0.15 * CASE WHEN {valid} IS NULL THEN 1 ELSE greatest(0.3, {valid}) END
      + 0.05 * CASE WHEN {days} IS NULL THEN 1 WHEN {d} <= 5 THEN 1 WHEN {d} <= 15 THEN 0.95 - ({d} - 5) / 200 WHEN {d} <= 30 THEN 0.85 - ({d} - 15) / 150
                    ELSE least(1, greatest(0.5, 0.7 - ({d} - 30) / {span} * 0.5) + greatest(0, 0.3 - {days}::DOUBLE / {span} * 0.2)) END
      + 0.30 * CASE WHEN {res} IS NULL OR {res} = 0 THEN 1 WHEN {res} <= 4 THEN 1 WHEN {res} <= 15 THEN 0.95 WHEN {res} <= 30 THEN 0.85
                    WHEN {res} <= 60 THEN 0.60 WHEN {res} <= 250 THEN 0.40 WHEN {res} <= 400 THEN 0.25 ELSE 0.15 END
      + 0.10 * CASE WHEN {share} IS NULL THEN 1 WHEN {share} < 0.7 THEN 0.7 * {share} WHEN {share} < 0.9 THEN 0.7 + 1.5 * ({share} - 0.7) ELSE 1 END
      )::DOUBLE / 1.10"""


RES_SQL = "CASE WHEN sensor = 'SENTINEL_2' THEN 10.0 WHEN sensor LIKE 'LANDSAT%' THEN 30.0 WHEN sensor LIKE 'MODIS%' THEN 250.0 ELSE 375.0 END"
SHARE_SQL = "((scene_id % 11) / 10.0)::DOUBLE"
SCORED_SQL = f""", scored AS (
  SELECT *, {CLOUD_SQL} AS cloud,
         {score_sql(CLOUD_SQL, 'sun_zenith', 'view_zenith', VALID_SQL, 'days', '30.0', f'({RES_SQL})', SHARE_SQL)}
         * CASE WHEN sensor LIKE 'MODIS%' THEN 0.5 ELSE 1.0 END AS score
  FROM v_scene)"""
TESTED_SQL = f"""{SCORED_SQL}, tested AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, sensor ORDER BY cloud_pct NULLS LAST, scene_id) AS t,
                        count(*) OVER (PARTITION BY tile_id, sensor) AS n FROM scored) WHERE t <= {N_TESTS}
), patient AS (SELECT *, CASE WHEN n <= 3 THEN 1 WHEN n <= 10 THEN 2 ELSE 3 END AS m FROM tested)"""


def ladder_sql(levels: list | str, pct: str = "p.cloud_pct") -> str:
    """The cloud ladder test by test: a recursive fold, unlike the closed form it checks; the levels may be a column."""
    at, last = levels if isinstance(levels, str) else f"[{', '.join(map(str, levels))}]", "len(lv) - 1"
    return f""", walk AS (
  SELECT tile_id, sensor, 0::BIGINT AS t, 0 AS l, 0 AS f, false AS done, 0::BIGINT AS scene_id, false AS arrives, false AS passes
  FROM (SELECT DISTINCT tile_id, sensor FROM patient)
  UNION ALL
  SELECT tile_id, sensor, t, l, f, done OR (arrives AND pct <= lv[f + 1]), scene_id, arrives, arrives AND pct <= lv[f + 1]
  FROM (SELECT *, CASE WHEN NOT done AND arrives AND t >= m THEN least(f0 + 1, {last}) ELSE f0 END AS f
        FROM (SELECT *, known IS NULL OR known <= lv[l + 1] AS arrives
              FROM (SELECT *, CASE WHEN NOT done AND t >= m THEN least(l0 + 1, {last}) ELSE l0 END AS l
                    FROM (SELECT p.tile_id, p.sensor, p.t, p.m, p.scene_id, {pct} AS known, round(p.cloud * 100, 9) AS pct, w.done, w.f AS f0, w.l AS l0, {at} AS lv
                    FROM walk w JOIN patient p ON p.tile_id = w.tile_id AND p.sensor = w.sensor AND p.t = w.t + 1))))
)"""


def with_recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


# --- scenes with scores ----------------------------------------------------------------------


def score_scenes(s: DataFrame) -> DataFrame:
    res = F.when(F.col("sensor") == "SENTINEL_2", 10.0).when(F.col("sensor").startswith("LANDSAT"), 30.0)
    res = res.when(F.col("sensor").startswith("MODIS"), 250.0).otherwise(375.0)
    pct, mask = F.col("cloud_pct"), F.col("mask_mean")
    cloud, valid = sc.cloud_fraction(pct, mask_mean=mask), sc.valid_fraction(pct, mask_mean=mask)
    span, share = F.lit(float(views.PERIOD_DAYS)), (F.col("scene_id") % 11) / 10.0
    score = sc.quality_score(cloud, F.col("sun_zenith"), F.col("view_zenith"), valid, F.col("days"), span, res, share)
    score = sc.sensor_adjusted(score, F.col("sensor"), F.col("acquired"), F.lit(False), F.lit(False))
    return s.withColumns({"cloud": cloud, "valid": valid, "resolution": res, "share": share, "score": score})


def scored_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_scenes(views.scenes(spark, sf_dir))


def tested_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tests of every tile and sensor, with the number of scenes they are from.

    The counts combine before their shuffle, the tests are cut before theirs, and only tests are scored.
    """
    s = views.scenes(spark, sf_dir)
    counts = s.groupBy(*sel.GROUP).agg(F.count("*").alias("n"))
    return score_scenes(sel.top_candidates(s, N_TESTS).join(counts, list(sel.GROUP)))


PATIENCE = sc.tests_before_lowering


def best_scene_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: gate by lifetime, score, rank, and take the best scene of every tile."""
    s = scored_scenes(spark, sf_dir)
    s = s.withColumns({"req_start": F.lit("2024-01-01").cast("date"), "req_end": F.lit("2024-01-31").cast("date")})
    s = operational(s, sensor_catalog(spark)).where("operational")
    best = sel.rank_results(s).where("is_selected")
    return best.select("tile_id", "scene_id", "sensor", F.round("score", 6).alias("score"), F.round("cloud", 6).alias("cloud"))


QUERIES["best_scene_per_tile"] = best_scene_per_tile
ORACLE_SQL["best_scene_per_tile"] = views.with_views(
    "v_scene",
    f"""{SCORED_SQL}, {SENSOR_SQL}
SELECT tile_id, scene_id, sensor, round(score, 6) AS score, round(cloud, 6)::DOUBLE AS cloud FROM (
  SELECT scored.*, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, scene_id) AS r
  FROM scored LEFT JOIN sensor_catalog ON sensor = name
  WHERE name IS NULL OR (DATE '2024-01-01' <= coalesce(e, DATE '{OPEN_END}') AND DATE '2024-01-31' >= s)) WHERE r = 1""",
)


@query(views.with_views("v_scene", f"{SCORED_SQL} SELECT scene_id, round(cloud, 6)::DOUBLE AS cloud, round({VALID_SQL}, 6)::DOUBLE AS valid, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS score_class FROM scored"))
def scene_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_scenes(spark, sf_dir)
    return s.select(
        "scene_id", F.round("cloud", 6).alias("cloud"), F.round("valid", 6).alias("valid"), F.round("score", 6).alias("score"), sc.score_class(F.col("score")).alias("score_class")
    )


@query(views.with_views("v_scene", """
SELECT scene_id, round(CASE WHEN scene_id % 3 = 0 THEN greatest(0.0, least(1.0, (scene_id % 13) / 10.0))
                            ELSE coalesce(CASE WHEN cloud_pct IS NOT NULL THEN greatest(0.0, least(1.0, cloud_pct / 100.0)) END, 1.0 - mask_mean, 0.5) END::DOUBLE, 6) AS cloud FROM v_scene"""))
def coarse_cloud_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.when(F.col("scene_id") % 3 == 0, (F.col("scene_id") % 13) / 10.0)
    cloud = sc.coarse_cloud_fraction(bit, F.col("cloud_pct"), mask_mean=F.col("mask_mean"))
    return views.scenes(spark, sf_dir).select("scene_id", F.round(cloud, 6).alias("cloud"))


NAMES = ["B4", "B3", "B2", "B8", "B11", "B12", "SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6", "SR_B7", "B5", "B7", "NDWI", "NDVI"]
_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


@query(f"""WITH k AS (SELECT DISTINCT (o_orderkey * 7919) % 131072 AS code FROM orders
), b AS (SELECT code, list_filter({_LIST}, lambda x: (code >> (list_position({_LIST}, x) - 1)) & 1 = 1) AS s FROM k
), h AS (SELECT code, s, list_contains(s, 'SR_B1') AS old FROM b
), c AS (SELECT code, s,
  (list_contains(s, 'B4') OR (old AND list_contains(s, 'SR_B3')) OR (NOT old AND list_contains(s, 'SR_B4')))
  AND (list_contains(s, 'B3') OR (old AND list_contains(s, 'SR_B2')) OR (NOT old AND list_contains(s, 'SR_B3')))
  AND (list_contains(s, 'B2') OR old OR list_contains(s, 'SR_B2')) AS rgb,
  (list_contains(s, 'B8') OR (old AND list_contains(s, 'SR_B4')) OR (NOT old AND (list_contains(s, 'SR_B5') OR (list_contains(s, 'B4') AND list_contains(s, 'SR_B4')))))::INT
  + (list_contains(s, 'B11') OR (old AND list_contains(s, 'SR_B5')) OR (NOT old AND (list_contains(s, 'SR_B6') OR list_contains(s, 'B5'))))::INT
  + (list_contains(s, 'B12') OR list_contains(s, 'SR_B7') OR list_contains(s, 'B7'))::INT AS ir FROM h)
SELECT code, round(CASE WHEN rgb THEN 0.2 + 0.6 * ir / 3.0 + 0.2 * (CASE WHEN list_contains(s, 'NDWI') THEN 1.0 ELSE 0.5 END)
  * (CASE WHEN list_contains(s, 'NDVI') THEN 1.0 ELSE 0.5 END) ELSE 0 END::DOUBLE, 6) AS share FROM c""")
def band_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = views.read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919 % 131072).alias("code")).distinct()
    bands = F.filter(F.array(*[F.when(F.shiftright("code", k) % 2 == 1, n) for k, n in enumerate(NAMES)]), lambda b: b.isNotNull())
    return codes.select("code", F.round(sc.band_completeness(bands), 6).alias("share"))


@query(views.with_views("v_scene", f"""{SCORED_SQL}
SELECT scene_id, round(0.7 / (1 + ({RES_SQL}) / 30.0) + CASE WHEN d <= 10 THEN 0.15 * (1 - d / 10.0) WHEN d <= 30 THEN 0.05 * (1 - (d - 10) / 20.0) ELSE 0 END
  + 0.15 * score, 9)::DOUBLE AS gap_score, round(greatest(0.2, 0.5 - 0.05 * (scene_id % 12)), 6)::DOUBLE AS floor
FROM (SELECT *, abs(days - scene_id % 45) AS d FROM scored)"""))
def gap_fill_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_scenes(spark, sf_dir)
    d = F.abs(F.col("days") - F.col("scene_id") % 45)
    gap = sc.gap_fill_score(F.col("resolution"), d, F.col("score"))
    return s.select("scene_id", F.round(gap, 9).alias("gap_score"), F.round(sc.relaxed_quality(F.col("scene_id") % 12), 6).alias("floor"))


@query("""
WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_shipdate::DATE - INTERVAL 4000 DAY AS d0,
                  ['LANDSAT_4', 'LANDSAT_5', 'LANDSAT_7', 'MODIS_AQUA', 'SENTINEL_2'][l_suppkey % 5 + 1] AS sensor, l_discount * 9.0 AS score,
                  l_partkey % 2 = 0 AS l4, l_partkey % 3 = 0 AS l5, l_linenumber AS k FROM lineitem
), t AS (SELECT *, CASE WHEN sensor = 'LANDSAT_7' THEN d0 + INTERVAL 5500 DAY ELSE d0 END::DATE AS d FROM s)
SELECT id, d::VARCHAR AS acquired, round(CASE
  WHEN sensor = 'LANDSAT_4' AND (l5 OR d BETWEEN DATE '1984-03-01' AND DATE '1993-12-14') THEN score * 0.92
  WHEN sensor = 'LANDSAT_4' AND d >= DATE '1983-01-01' THEN least(1.0, score * 1.05)
  WHEN sensor = 'LANDSAT_5' AND l4 THEN least(1.0, score * 1.05)
  WHEN sensor = 'LANDSAT_7' AND d >= DATE '2003-05-31' THEN score * 0.5
  WHEN sensor LIKE 'MODIS%' THEN score * 0.5 ELSE score END, 6)::DOUBLE AS score FROM t""")
def sensor_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.read(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(s) for s in ("LANDSAT_4", "LANDSAT_5", "LANDSAT_7", "MODIS_AQUA", "SENTINEL_2")])
    sensor = F.get(names, (F.col("l_suppkey") % 5).cast("int"))
    day = F.date_add(F.to_date("l_shipdate"), F.when(sensor == "LANDSAT_7", 1500).otherwise(-4000))
    score = sc.sensor_adjusted(F.col("l_discount") * 9.0, sensor, day, F.col("l_partkey") % 2 == 0, F.col("l_partkey") % 3 == 0)
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), day.cast("string").alias("acquired"), F.round(score, 6).alias("score"))


#: Months that orders ask for, spread from 1959 to 2038.
REQUESTED = "(SELECT o_orderkey, (date_trunc('month', o_orderdate) + to_months((o_orderkey % 74 - 33) * 12))::DATE AS m FROM orders)"


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.add_months(F.trunc("o_orderdate", "MM"), ((F.col("o_orderkey") % 74 - 33) * 12).cast("int")).alias("req_start"))


@query(f"""WITH {SENSOR_SQL}, r AS (SELECT DISTINCT m FROM {REQUESTED})
SELECT year(m) * 100 + month(m) AS req_id, family, bool_or(m <= coalesce(e, DATE '{OPEN_END}') AND last_day(m) >= s) AS available
FROM r, sensor_catalog WHERE family <> 'EVENT' GROUP BY ALL""")
def family_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with a sensor in operation in each month that is asked for."""
    months = _requested(spark, sf_dir).select("req_start").distinct()
    months = months.withColumns({"req_end": F.last_day("req_start"), "req_id": (F.year("req_start") * 100 + F.month("req_start")).cast("long")})
    return families_available(months, sensor_catalog(spark))


@query(views.with_views("v_acq", f""", {SENSOR_SQL}, q AS (SELECT pixel_id, CASE WHEN pixel_id % 10 = 0 THEN 'UNLISTED' ELSE sensor END AS sensor, acquired FROM v_acq)
SELECT pixel_id, name IS NULL OR (acquired <= coalesce(e, DATE '{OPEN_END}') AND acquired + 30 >= s) AS operational FROM q LEFT JOIN sensor_catalog ON sensor = name"""))
def sensor_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.acquisitions(spark, sf_dir)
    a = a.select("pixel_id", F.when(F.col("pixel_id") % 10 == 0, "UNLISTED").otherwise(F.col("sensor")).alias("sensor"), F.col("acquired").alias("req_start"))
    a = a.withColumn("req_end", F.date_add("req_start", 30))
    return operational(a, sensor_catalog(spark)).select("pixel_id", "operational")


@query(f"""WITH {SENSOR_SQL} SELECT o_orderkey AS id, count(*) FILTER (WHERE m <= coalesce(e, DATE '{OPEN_END}') AND last_day(m) >= s) AS flying, m < min(s) AS too_early FROM {REQUESTED}, sensor_catalog WHERE family <> 'EVENT' GROUP BY o_orderkey, m""")
def catalog_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sensors fly in the month of each request, and whether it starts before the earliest of them."""
    lives = [(start, end or OPEN_END) for _, start, end, _, family in SENSORS if family != "EVENT"]
    first, last = F.col("req_start"), F.last_day("req_start")
    flying = sum(((first <= F.lit(e).cast("date")) & (last >= F.lit(s).cast("date"))).cast("long") for s, e in lives)
    earliest = F.lit(min(s for s, _ in lives)).cast("date")
    return _requested(spark, sf_dir).select(F.col("o_orderkey").alias("id"), flying.alias("flying"), (first < earliest).alias("too_early"))


@query(views.with_views("v_scene", f"{TESTED_SQL} SELECT tile_id, sensor, t, scene_id, m FROM patient"))
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tested_scenes(spark, sf_dir).select("tile_id", "sensor", "t", "scene_id", PATIENCE(F.col("n")).alias("m"))


def _ladder(spark: SparkSession, sf_dir: str, levels: list) -> DataFrame:
    out = sel.cloud_ladder(tested_scenes(spark, sf_dir), PATIENCE(F.col("n")), levels)
    return out.select("scene_id", "t", "arrives", "passes")


_WALK = " SELECT scene_id, t, arrives, passes FROM walk WHERE t > 0"


@query(with_recursive(views.with_views("v_scene", TESTED_SQL + ladder_sql(sel.CLOUD_LEVELS) + _WALK)))
def cloud_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ladder(spark, sf_dir, sel.CLOUD_LEVELS)


@query(with_recursive(views.with_views("v_scene", TESTED_SQL + ladder_sql(sel.CLOUD_LEVELS_L4) + _WALK)))
def cloud_ladder_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ladder(spark, sf_dir, sel.CLOUD_LEVELS_L4)


@query(with_recursive(views.with_views("v_scene", TESTED_SQL + ladder_sql(sel.CLOUD_LEVELS_STEPS) + _WALK)))
def cloud_ladder_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ladder(spark, sf_dir, sel.CLOUD_LEVELS_STEPS)


def quality_sql(levels: list | str) -> str:
    at, last = levels if isinstance(levels, str) else f"[{', '.join(map(str, levels))}]", "len(lv) - 1"
    return f""", passing AS (SELECT p.*, w.passes FROM patient p JOIN walk w ON p.tile_id = w.tile_id AND p.sensor = w.sensor AND p.t = w.t
), judge AS (
  SELECT tile_id, sensor, 0::BIGINT AS t, 0 AS q, false AS done, 0::BIGINT AS scene_id, false AS accepted FROM (SELECT DISTINCT tile_id, sensor FROM patient)
  UNION ALL
  SELECT tile_id, sensor, t, q, done OR (passes AND s >= lv[q + 1]), scene_id, passes AND s >= lv[q + 1]
  FROM (SELECT *, CASE WHEN NOT done AND passes AND t >= m THEN least(q0 + 1, {last}) ELSE q0 END AS q
        FROM (SELECT p.tile_id, p.sensor, p.t, p.m, p.scene_id, p.passes, round(p.score, 9) AS s, j.done, j.q AS q0, {at} AS lv
        FROM judge j JOIN passing p ON p.tile_id = j.tile_id AND p.sensor = j.sensor AND p.t = j.t + 1))
)"""


def accepted_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = tested_scenes(spark, sf_dir)
    patience = PATIENCE(F.col("n"))
    return sel.quality_ladder(sel.cloud_ladder(tested, patience), patience)


JUDGED_SQL = TESTED_SQL + ladder_sql(sel.CLOUD_LEVELS) + quality_sql(sel.QUALITY_LEVELS)


@query(with_recursive(views.with_views("v_scene", JUDGED_SQL + " SELECT scene_id, t, accepted FROM judge WHERE t > 0")))
def quality_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted_scenes(spark, sf_dir).select("scene_id", "t", "accepted")


@query(with_recursive(views.with_views("v_scene", TESTED_SQL + ladder_sql(sel.CLOUD_LEVELS_STEPS) + quality_sql(sel.QUALITY_LEVELS_STEPS) + " SELECT scene_id, t, accepted FROM judge WHERE t > 0")))
def quality_ladder_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    patience = PATIENCE(F.col("n"))
    out = sel.cloud_ladder(tested_scenes(spark, sf_dir), patience, sel.CLOUD_LEVELS_STEPS)
    return sel.quality_ladder(out, patience, sel.QUALITY_LEVELS_STEPS).select("scene_id", "t", "accepted")


def selected_sql(excellent: str = "p.score >= 0.85", enough: str = "3", cloudiness: str = "cloud_pct", allowed: str = "true") -> str:
    return f""", stopped AS (
  SELECT p.*, j.accepted AND coalesce(sum(CASE WHEN j.accepted AND ({excellent}) THEN 1 ELSE 0 END) OVER (
           PARTITION BY p.tile_id, p.sensor ORDER BY p.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {enough} AS accepted
  FROM passing p JOIN judge j ON p.tile_id = j.tile_id AND p.sensor = j.sensor AND p.t = j.t
), kept AS (
  SELECT *, NOT accepted AS fallback FROM (
    SELECT *, bool_or(accepted) OVER (PARTITION BY tile_id, sensor) AS any_ok,
           row_number() OVER (PARTITION BY tile_id, sensor ORDER BY passes DESC, CASE WHEN passes THEN score END DESC NULLS LAST, {cloudiness} NULLS LAST, scene_id) AS r
    FROM stopped) WHERE accepted OR (NOT any_ok AND r = 1 AND {allowed})
)"""


SELECTED_SQL = JUDGED_SQL + selected_sql()


def selected_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted scenes of every tile and sensor, up to the third excellent one, or else the fallback."""
    return sel.with_fallback(sel.stop_after_excellent(accepted_scenes(spark, sf_dir)))


@query(with_recursive(views.with_views("v_scene", SELECTED_SQL + " SELECT tile_id, sensor, scene_id, t, fallback, round(score, 6) AS score FROM kept")))
def selected_scenes_by_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected_scenes(spark, sf_dir).select("tile_id", "sensor", "scene_id", "t", "fallback", F.round("score", 6).alias("score"))


def phase_sql(rows: str = "kept") -> str:
    return f""", graded AS (
  SELECT *, score >= 0.85 AS exc, row_number() OVER (PARTITION BY tile_id, sensor, score >= 0.85 ORDER BY score DESC, scene_id) AS k,
         bool_or(score >= 0.85) OVER (PARTITION BY tile_id) AS some_exc FROM {rows}
), phase AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, scene_id) AS phase_rank
  FROM graded WHERE NOT some_exc OR (exc AND k <= 3)) WHERE phase_rank <= 5)"""


PHASE_SQL = SELECTED_SQL + phase_sql()


@query(with_recursive(views.with_views("v_scene", PHASE_SQL + " SELECT tile_id, phase_rank, scene_id, round(score, 6) AS score FROM phase")))
def phase_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.phase_one(selected_scenes(spark, sf_dir)).select("tile_id", "phase_rank", "scene_id", F.round("score", 6).alias("score"))


@query(views.with_views("v_scene", f"""{TESTED_SQL}
SELECT scene_id, r AS score_rank, r = 1 AS is_selected, CASE WHEN r > 1 THEN r ELSE 0 END AS fallback_rank
FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, scene_id) AS r FROM tested)"""))
def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.rank_results(tested_scenes(spark, sf_dir)).select("scene_id", "score_rank", "is_selected", F.coalesce("fallback_rank", F.lit(0)).alias("fallback_rank"))


@query(views.with_views("v_scene", f"""{TESTED_SQL}, best AS (SELECT tile_id, sensor, max(score) AS top FROM tested GROUP BY ALL)
SELECT tile_id, sensor, t, scene_id, score FROM (
  SELECT t.tile_id, t.sensor, t.t, t.scene_id, round(t.score, 6) AS score, row_number() OVER (PARTITION BY t.tile_id, t.sensor ORDER BY t.t) AS r
  FROM tested t JOIN best b ON t.tile_id = b.tile_id AND t.sensor = b.sensor AND abs(t.score - b.top) < 0.01) WHERE r = 1"""))
def matched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = tested_scenes(spark, sf_dir)
    best = tested.groupBy("tile_id", "sensor").agg(F.max("score").alias("score"))
    return sel.match_selected(tested, best, 0.01).withColumn("score", F.round("score", 6))


# --- all sensors by the rules of their families -----------------------------------------------


def _literal(x) -> str:
    return f"{x}::DOUBLE[]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)


_RULE_ROWS = ", ".join(f"({', '.join(map(_literal, r))})" for r in sel.RULES)
_RULES_SQL = f"rules(family, cloud_levels, reads_metadata, quality_levels, tests, server_tests, enough, excellent_only, stands_in, by_cloud) AS (VALUES {_RULE_ROWS})"
_SUN_SQL = "CASE WHEN family NOT IN ('MODIS', 'ASTER', 'VIIRS') THEN sun_zenith END"
_VIEW_SQL = "CASE WHEN family = 'MODIS' THEN 15.0 WHEN family NOT IN ('LANDSAT', 'ASTER', 'VIIRS') THEN view_zenith END"


def fleet_sql(tests: str = "tests") -> str:
    """Scenes of sensors that fly in their tile's month, the tested ones scored, and the patience of their groups."""
    raw = score_sql(CLOUD_SQL, f"({_SUN_SQL})", f"({_VIEW_SQL})", VALID_SQL, "days", "30.0", "native_res", SHARE_SQL)
    return f""", {SENSOR_SQL}, {_RULES_SQL}, flying AS (
  SELECT v.*, c.native_res, c.family FROM v_fleet v JOIN sensor_catalog c ON v.sensor = c.name WHERE period_start <= coalesce(c.e, DATE '{OPEN_END}') AND period_end >= c.s
), counts AS (SELECT tile_id, sensor, count(*) AS n FROM flying GROUP BY ALL
), tiles AS (SELECT tile_id, bool_or(sensor = 'LANDSAT_4') AS l4, bool_or(sensor = 'LANDSAT_5') AS l5 FROM counts GROUP BY tile_id
), ruled AS (
  SELECT f.* REPLACE (CASE WHEN sensor = 'LANDSAT_4' AND period_start < DATE '{sel.L4_ALONE_BEFORE}' THEN {_literal(sel.CLOUD_LEVELS_L4)} ELSE cloud_levels END AS cloud_levels)
  FROM (SELECT flying.*, r.* EXCLUDE (family) FROM flying JOIN rules r USING (family)) f
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY tile_id, sensor ORDER BY CASE WHEN by_cloud THEN cloud_pct END NULLS LAST, CASE WHEN NOT by_cloud THEN acquired END, scene_id) AS t FROM ruled
), rated AS (
  SELECT o.*, n, l4, l5, {CLOUD_SQL} AS cloud, {raw} AS raw FROM ordered o JOIN counts USING (tile_id, sensor) JOIN tiles USING (tile_id) WHERE t <= {tests}
), patient AS (
  SELECT *, CASE WHEN n <= 3 THEN 1 WHEN n <= 10 THEN 2 ELSE 3 END AS m,
         round(CASE WHEN sensor = 'LANDSAT_4' AND (l5 OR acquired BETWEEN DATE '1984-03-01' AND DATE '1993-12-14') THEN raw * 0.92
              WHEN sensor = 'LANDSAT_4' AND acquired >= DATE '1983-01-01' THEN least(1.0, raw * 1.05) WHEN sensor = 'LANDSAT_5' AND l4 THEN least(1.0, raw * 1.05)
              WHEN sensor = 'LANDSAT_7' AND acquired >= DATE '2003-05-31' THEN raw * 0.5 WHEN sensor LIKE 'MODIS%' THEN raw * 0.5 ELSE raw END, 9)::DOUBLE AS score FROM rated)"""


_METADATA_SQL = "CASE WHEN reads_metadata THEN cloud_pct END"
_BY_RULES_SQL = (
    ladder_sql("p.cloud_levels", "CASE WHEN p.reads_metadata THEN p.cloud_pct END")
    + quality_sql("p.quality_levels")
    + selected_sql("NOT p.excellent_only OR p.score >= 0.85", "p.enough", f"coalesce({_METADATA_SQL}, cloud * 100)", "stands_in")
    + f""", taken AS (SELECT * FROM (SELECT *, bool_or(family <> '{sel.LAST_RESORT}') OVER (PARTITION BY tile_id) AS others FROM kept) WHERE family <> '{sel.LAST_RESORT}' OR NOT others)"""
)
FLEET_SQL = fleet_sql() + _BY_RULES_SQL


def fleet_tests(spark: SparkSession, sf_dir: str, *, server: bool = False) -> DataFrame:
    """Scored tests of all sensors that fly in the month of their tile."""
    catalog = sensor_catalog(spark)
    flying = operational(views.fleet(spark, sf_dir), catalog, start="period_start", end="period_end").where("operational").drop("operational")
    s = sel.tests_by_rules(flying, sel.sensor_rules(catalog), server=server)
    pct, mask, family = F.col("cloud_pct"), F.col("mask_mean"), F.col("family")
    cloud, valid = sc.cloud_fraction(pct, mask_mean=mask), sc.valid_fraction(pct, mask_mean=mask)
    sun = F.when(~family.isin("MODIS", "ASTER", "VIIRS"), F.col("sun_zenith"))
    view = F.when(family == "MODIS", 15.0).when(~family.isin("LANDSAT", "ASTER", "VIIRS"), F.col("view_zenith"))
    span, share = F.lit(float(views.PERIOD_DAYS)), (F.col("scene_id") % 11) / 10.0
    score = sc.quality_score(cloud, sun, view, valid, F.col("days"), span, F.col("native_res"), share)
    score = sc.sensor_adjusted(score, F.col("sensor"), F.col("acquired"), F.col("with_l4"), F.col("with_l5"))
    # rounded, so that equal scores tie and steps of thresholds are met
    return s.withColumns({"cloud": cloud, "resolution": F.col("native_res"), "score": F.round(score, 9)})


def fleet_selected(spark: SparkSession, sf_dir: str, *, server: bool = False) -> DataFrame:
    return sel.accepted_by_rules(fleet_tests(spark, sf_dir, server=server), PATIENCE(F.col("n")))


_TAKEN = " SELECT tile_id, family, sensor, scene_id, t, fallback, round(score, 6) AS score FROM taken"


def _taken(rows: DataFrame) -> DataFrame:
    return rows.select("tile_id", "family", "sensor", "scene_id", "t", "fallback", F.round("score", 6).alias("score"))


@query(with_recursive(views.with_views("v_scene v_fleet", FLEET_SQL + _TAKEN)))
def selected_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of every tile over all sensors, each by the rules of its family."""
    return _taken(fleet_selected(spark, sf_dir))


@query(with_recursive(views.with_views("v_scene v_fleet", fleet_sql("server_tests") + _BY_RULES_SQL + _TAKEN)))
def selected_by_family_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the numbers of tests of server mode."""
    return _taken(fleet_selected(spark, sf_dir, server=True))


@query(views.with_views("v_scene v_fleet", fleet_sql() + " SELECT tile_id, sensor, scene_id, t, m, round(score, 6) AS score FROM patient"))
def tests_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes that the rules test, in their order, scored with the adjustments of neighbouring sensors."""
    return fleet_tests(spark, sf_dir).select("tile_id", "sensor", "scene_id", "t", PATIENCE(F.col("n")).alias("m"), F.round("score", 6).alias("score"))


@query(with_recursive(views.with_views("v_scene v_fleet", FLEET_SQL + f" SELECT tile_id, scene_id FROM taken WHERE family = '{sel.LAST_RESORT}'")))
def last_resort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that only the coarsest sensor has, and its first acceptable scene."""
    return fleet_selected(spark, sf_dir).where(F.col("family") == sel.LAST_RESORT).select("tile_id", "scene_id")


_FIXED = "('MODIS', 'ASTER', 'VIIRS')"


@query(with_recursive(views.with_views("v_scene v_fleet", FLEET_SQL + f""" SELECT p.family, count(*) AS n, count_if(p.passes) AS below_cut, count_if(p.passes AND round(p.score, 9) >= p.quality_levels[1]) AS above_floor,
  count_if(k.scene_id IS NOT NULL) AS taken FROM passing p LEFT JOIN taken k ON p.tile_id = k.tile_id AND p.sensor = k.sensor AND p.scene_id = k.scene_id WHERE p.family IN {_FIXED} GROUP BY p.family""")))
def fixed_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with one fixed cloud cut, and the quality floor of the coarse ones: tests below, above, and taken."""
    tested = fleet_tests(spark, sf_dir)
    taken = sel.accepted_by_rules(tested, PATIENCE(F.col("n"))).select("tile_id", "sensor", "scene_id", F.lit(1).alias("is_taken"))
    rows = sel.cloud_ladder(tested, PATIENCE(F.col("n")), F.col("cloud_levels"), pct=F.when(F.col("reads_metadata"), F.col("cloud_pct")))
    rows = rows.where(F.col("family").isin("MODIS", "ASTER", "VIIRS")).join(taken, ["tile_id", "sensor", "scene_id"], "left")
    above = F.col("passes") & (F.round("score", 9) >= F.get("quality_levels", F.lit(0)))
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.count_if("passes").alias("below_cut"), F.count_if(above).alias("above_floor"), F.count("is_taken").alias("taken"))
