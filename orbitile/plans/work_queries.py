"""Queries over planning, joins, gap filling, reports, progress and text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitile.functions import geo, text
from orbitile.functions.scoring import tests_before_lowering
from orbitile.operators import gapfill, progress, report, tiling
from orbitile.operators import selection as sel

from orbitile.sources.storage import numbered, stored

from . import views
from .select_queries import PATIENCE, PHASE_SQL, RES_SQL, SCORED_SQL, TESTED_SQL, scored_scenes, tested_scenes, with_recursive

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- joins -----------------------------------------------------------------------------------

_PROB = "prob AS (SELECT event_id AS scene_id, (event_id * 17 % 100)::DOUBLE AS probability FROM events WHERE event_id % 4 <> 0)"


@query(views.with_views("v_scene", f", {_PROB} SELECT scene_id, sensor, probability FROM v_scene JOIN prob USING (scene_id) WHERE sensor = 'SENTINEL_2'"))
def cloud_probability_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with the probability layer of the same index."""
    e = views.read(spark, sf_dir, "events").where("event_id % 4 <> 0")
    layer = e.select(F.col("event_id").alias("scene_id"), (F.col("event_id") * 17 % 100).cast("double").alias("probability"))
    return views.scenes(spark, sf_dir).where("sensor = 'SENTINEL_2'").join(layer, "scene_id").select("scene_id", "sensor", "probability")


@query(views.with_views("v_scene", f", {_PROB} SELECT scene_id, sensor, probability FROM v_scene LEFT JOIN prob USING (scene_id) WHERE sensor = 'SENTINEL_2'"))
def cloud_probability_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events").where("event_id % 4 <> 0")
    layer = e.select(F.col("event_id").alias("scene_id"), (F.col("event_id") * 17 % 100).cast("double").alias("probability"))
    return views.scenes(spark, sf_dir).where("sensor = 'SENTINEL_2'").join(layer, "scene_id", "left").select("scene_id", "sensor", "probability")


@query(views.with_views("v_scene", """ SELECT sensor, tile_id, acquired::VARCHAR AS acquired, count(*) AS n FROM v_scene
  WHERE acquired >= DATE '2024-01-05' AND acquired < DATE '2024-01-20' AND sensor IN ('LANDSAT_8', 'LANDSAT_9') GROUP BY ALL"""))
def scenes_of_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open date range and sensor list, as the scans of the collections use them."""
    day = F.col("acquired")
    s = views.scenes(spark, sf_dir).where((day >= F.lit("2024-01-05").cast("date")) & (day < F.lit("2024-01-20").cast("date")) & F.col("sensor").isin("LANDSAT_8", "LANDSAT_9"))
    return s.groupBy("sensor", "tile_id", day.cast("string").alias("acquired")).agg(F.count("*").alias("n"))


@query(views.with_views("v_scene", """, a AS (SELECT * FROM v_scene WHERE sensor = 'MODIS_TERRA' AND days < 15 UNION ALL SELECT * FROM v_scene WHERE sensor = 'VIIRS' AND days >= 15
  UNION ALL SELECT * FROM v_scene WHERE sensor = 'SENTINEL_2' AND cloud_pct < 5) SELECT tile_id, sensor, count(*) AS n, min(scene_id) AS first_id FROM a GROUP BY ALL"""))
def merged_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.scenes(spark, sf_dir)
    parts = s.where("sensor = 'MODIS_TERRA' and days < 15").unionByName(s.where("sensor = 'VIIRS' and days >= 15")).unionByName(s.where("sensor = 'SENTINEL_2' and cloud_pct < 5"))
    return parts.groupBy("tile_id", "sensor").agg(F.count("*").alias("n"), F.min("scene_id").alias("first_id"))


@query(views.with_views("v_scene", """, v AS (SELECT tile_id, 1 AS version, scene_id FROM v_scene WHERE sensor = 'VIIRS' AND days < 2
  UNION ALL SELECT tile_id, 2, scene_id FROM v_scene WHERE sensor = 'VIIRS' AND days < 6 UNION ALL SELECT tile_id, 3, scene_id FROM v_scene WHERE sensor = 'VIIRS')
SELECT tile_id, version, count(*) AS n FROM v JOIN (SELECT tile_id, min(version) AS version FROM v GROUP BY tile_id) USING (tile_id, version) GROUP BY ALL"""))
def first_available_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several versions of a collection the first that has scenes of the tile."""
    s = views.scenes(spark, sf_dir).where("sensor = 'VIIRS'").select("tile_id", "scene_id", "days")
    v = s.where("days < 2").withColumn("version", F.lit(1)).unionByName(s.where("days < 6").withColumn("version", F.lit(2))).unionByName(s.withColumn("version", F.lit(3)))
    counted = v.groupBy("tile_id", "version").agg(F.count("*").alias("n"))
    return counted.groupBy("tile_id").agg(F.min(F.struct("version", "n")).alias("b")).select("tile_id", "b.version", "b.n")


@query(views.with_views("v_scene", """, days AS (SELECT DISTINCT tile_id, days FROM v_scene WHERE sensor = 'SENTINEL_2')
SELECT s.scene_id, min(abs(s.days - d.days))::INTEGER AS distance FROM v_scene s JOIN days d USING (tile_id) WHERE sensor <> 'SENTINEL_2' GROUP BY s.scene_id"""))
def nearest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to the nearest chosen date of the tile, by one small array a tile."""
    s = views.scenes(spark, sf_dir)
    dates = s.where("sensor = 'SENTINEL_2'").groupBy("tile_id").agg(F.collect_set("days").alias("d"))
    near = F.array_min(F.transform("d", lambda x: F.abs(x - F.col("days"))))
    return s.where("sensor <> 'SENTINEL_2'").join(dates, "tile_id").select("scene_id", near.alias("distance"))


@query(views.with_views("v_scene", f"{TESTED_SQL} SELECT s.scene_id FROM scored s WHERE NOT EXISTS (SELECT 1 FROM tested t WHERE t.scene_id = s.scene_id)"))
def untested_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_scenes(spark, sf_dir).join(tested_scenes(spark, sf_dir).select("scene_id"), "scene_id", "left_anti").select("scene_id")


_BOXES = ", b AS (SELECT area_id AS right_id, lon_min - 8 AS x0, lat_min - 8 AS y0, lon_max + 8 AS x1, lat_max + 8 AS y1 FROM v_area)"


@query(views.with_views("v_area", _BOXES + " SELECT area_id AS left_id, right_id FROM v_area JOIN b ON lon_min < x1 AND x0 < lon_max AND lat_min < y1 AND y0 < lat_max"))
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.areas(spark, sf_dir)
    wide = {n: F.col(n) + (8 if n.endswith("max") else -8) for n in ("lon_min", "lat_min", "lon_max", "lat_max")}
    return tiling.overlapping(a.withColumnRenamed("area_id", "left_id"), a.withColumnRenamed("area_id", "right_id").withColumns(wide))


# --- planning --------------------------------------------------------------------------------

_REQ = "r AS (SELECT s_suppkey AS id, DATE '1984-01-15' + (s_suppkey * 97 % 9000)::INTEGER AS s, s_suppkey * 53 % 800 AS d FROM supplier), q AS (SELECT id, s, (s + d::INTEGER)::DATE AS e FROM r)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    r = views.read(spark, sf_dir, "supplier").select(k.alias("id"), F.date_add(F.lit("1984-01-15").cast("date"), (k * 97 % 9000).cast("int")).alias("start"), (k * 53 % 800).cast("int").alias("d"))
    return r.select("id", "start", F.date_add("start", F.col("d")).alias("end"))


@query(f"""WITH {_REQ} SELECT id, m::VARCHAR AS month_start, last_day(m)::VARCHAR AS month_end, (m + INTERVAL 1 MONTH)::DATE::VARCHAR AS month_after FROM (
  SELECT id, unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH))::DATE AS m FROM q)""")
def month_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiling.month_units(_requests(spark, sf_dir))
    return out.select("id", *[F.col(c).cast("string").alias(c) for c in ("month_start", "month_end", "month_after")])


@query(f"""WITH {_REQ} SELECT id, CASE WHEN e > s THEN (e - s)::INTEGER ELSE 365 END AS span, CASE WHEN day(e) >= 15 THEN last_day(e) ELSE last_day((e - INTERVAL 1 MONTH)::DATE) END::VARCHAR AS suggested,
  floor((epoch_ms(e::TIMESTAMP) + (id * 7919 % 200000) * 1000 - epoch_ms(s::TIMESTAMP)) / 86400000.0)::INTEGER AS elapsed FROM q""")
def date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis(F.col("end").cast("timestamp")) + (F.col("id") * 7919 % 200000) * 1000
    return _requests(spark, sf_dir).select(
        "id", text.period_days(F.col("start"), F.col("end")).alias("span"), text.suggested_end(F.col("end")).cast("string").alias("suggested"), text.elapsed_days(millis, F.col("start")).alias("elapsed")
    )


_WH = "(lon_max - lon_min) * 111320.0::DOUBLE * cos(radians((lat_min + lat_max) / 2)) AS w, (lat_max - lat_min) * 111000.0::DOUBLE AS h"


@query(views.with_views("v_area", f""", m AS (SELECT *, (lon_min + lon_max) / 2 AS lon, (lat_min + lat_max) / 2 AS lat, {_WH} FROM v_area)
SELECT area_id, (floor((lon + 180) / 6) + 1)::INTEGER AS zone, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1)::INTEGER AS epsg, round(w, 3) AS width, round(h, 3) AS height,
  lon_min BETWEEN -180 AND 180 AND lon_max BETWEEN -180 AND 180 AND lat_min BETWEEN -90 AND 90 AND lat_max BETWEEN -90 AND 90 AND lon_min < lon_max AND lat_min < lat_max AS box_ok,
  CASE WHEN lon_max - lon_min > 10 THEN 4 WHEN lon_max - lon_min > 5 THEN 5 WHEN lon_max - lon_min > 2 THEN 6 WHEN lon_max - lon_min > 1 THEN 7 WHEN lon_max - lon_min > 0.5 THEN 8 ELSE 9 END AS zoom,
  round(10 / (111320 * cos(radians(lat))), 12) AS degrees_10m FROM m"""))
def area_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    box = [c(n) for n in ("lon_min", "lat_min", "lon_max", "lat_max")]
    lon, lat = (box[0] + box[2]) / 2.0, (box[1] + box[3]) / 2.0
    w, h = geo.box_metres(*box)
    return views.areas(spark, sf_dir).select(
        "area_id", geo.utm_zone(lon).alias("zone"), geo.utm_epsg(lon, lat).cast("int").alias("epsg"), F.round(w, 3).alias("width"), F.round(h, 3).alias("height"),
        geo.box_ok(*box).alias("box_ok"), geo.map_zoom(box[2] - box[0]).alias("zoom"), F.round(10.0 / (geo.METRES_LON * F.cos(F.radians(lat))), 12).alias("degrees_10m"),
    )


@query(views.with_views("v_area", f""", m AS (SELECT area_id, {_WH}, (lon_max - lon_min) * (lat_max - lat_min) * (1 + 31 / 365.0) AS var FROM v_area
), g AS (SELECT *, greatest(1, round_even(sqrt(40 * w / h), 0)) AS nx, greatest(1, round_even(sqrt(40 / (w / h)), 0)) AS ny, ceil(floor(w / 10) * floor(h / 10) / 65536.0) AS n FROM m
), s AS (SELECT *, greatest(w / nx, h / ny) AS side, greatest(1, ceil(sqrt(n * (w / h)))) AS per_row FROM g)
SELECT area_id, nx::BIGINT AS nx, ny::BIGINT AS ny, round(side / 10 * (side / 10) * 24 / 1048576, 6) AS megabytes, side / 10 * (side / 10) * 24 > 41943040 AS too_large,
  (per_row * ceil(n / per_row))::BIGINT AS automatic, floor(sqrt(side * 1000 / 24.0))::BIGINT AS max_pixels,
  round(nx * ny / least((area_id % 12 + 1), 8) * (4.0 + side / 10 * (side / 10) * 24 / 1048576 / 1.25 + 1.5), 4) AS job_seconds, round(var, 9) AS variance FROM s"""))
def tile_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    box = [c(n) for n in ("lon_min", "lat_min", "lon_max", "lat_max")]
    w, h = geo.box_metres(*box)
    a = views.areas(spark, sf_dir).withColumns({"w": w, "h": h})
    nx, ny = geo.grid_shape(c("w"), c("h"), F.lit(40))
    a = a.withColumns({"nx": nx, "ny": ny}).withColumn("side", F.greatest(c("w") / c("nx"), c("h") / c("ny")))
    mb = geo.tile_megabytes(c("side"), 10.0)
    return a.select(
        "area_id", c("nx").cast("long").alias("nx"), c("ny").cast("long").alias("ny"), F.round(mb, 6).alias("megabytes"), (mb * 1048576 > geo.SAFE_BYTES).alias("too_large"),
        geo.automatic_tiles(c("w"), c("h"), 10.0).cast("long").alias("automatic"), geo.max_tile_pixels(c("side") * 1000, 6, 4).cast("long").alias("max_pixels"),
        F.round(geo.job_seconds(c("nx") * c("ny"), mb, c("area_id") % 12 + 1), 4).alias("job_seconds"), F.round(geo.tile_variance(*box, F.lit(31.0)), 9).alias("variance"),
    )


def _series(terms: tuple, one: str, two: str, first: str, second: str) -> str:
    return " + ".join(f"{a!r} * {one}({2.0 * j} * {first}) * {two}({2.0 * j} * {second})" for j, a in enumerate(terms, 1))


_N = geo.FLATTENING / (2 - geo.FLATTENING)
_R = geo.SCALE * geo.AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * _N**0.5 / (1 + _N)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)


def to_utm_sql(rows: str) -> str:
    """Rows with lon, lat, zone and north, and with them x and y in metres."""
    return f"""SELECT * EXCLUDE (phi, lam, t, xi, eta), 500000.0 + {_R!r} * (eta + {_series(_ALPHA, "cos", "sinh", "xi", "eta")}) AS x,
  {_R!r} * (xi + {_series(_ALPHA, "sin", "cosh", "xi", "eta")}) + CASE WHEN north THEN 0.0 ELSE 10000000.0 END AS y
  FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1.0 + t * t)) AS eta FROM (SELECT *, sinh(atanh(sin(phi)) - {_E!r} * atanh({_E!r} * sin(phi))) AS t
  FROM (SELECT *, radians(lat) AS phi, radians(lon - (zone * 6.0 - 183.0)) AS lam FROM {rows})))"""


def to_lonlat_sql(rows: str) -> str:
    """Rows with x, y, zone and north, and with them lon and lat."""
    phi = "chi + " + " + ".join(f"{d!r} * sin({2.0 * j} * chi)" for j, d in enumerate(_DELTA, 1))
    return f"""SELECT * EXCLUDE (xi, eta, u, v, chi), zone * 6.0 - 183.0 + degrees(atan2(sinh(v), cos(u))) AS lon, degrees({phi}) AS lat FROM (SELECT *, asin(sin(u) / cosh(v)) AS chi
  FROM (SELECT *, xi - ({_series(_BETA, "sin", "cosh", "xi", "eta")}) AS u, eta - ({_series(_BETA, "cos", "sinh", "xi", "eta")}) AS v
  FROM (SELECT *, (y - CASE WHEN north THEN 0.0 ELSE 10000000.0 END) / {_R!r} AS xi, (x - 500000.0) / {_R!r} AS eta FROM {rows})))"""


_GROWN = "CASE WHEN {n} * {o} < 30 THEN greatest({n}, least(ceil(30 / {o}), floor(33.0 / {o}))) ELSE {n} END"


def grid_sql(shape: str) -> str:
    """The tiles of all areas: ``shape`` gives nx and ny from width and height."""
    return f""", z AS (SELECT *, floor(((lon_min + lon_max) / 2 + 180) / 6) + 1 AS zone, (lat_min + lat_max) / 2 >= 0 AS north FROM v_area
), corners AS (SELECT area_id, zone, north, unnest([lon_min, lon_min, lon_max, lon_max]) AS lon, unnest([lat_min, lat_max, lat_min, lat_max]) AS lat FROM z
), bounds AS (SELECT area_id, zone, north, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, max(x) - min(x) AS w, max(y) - min(y) AS h FROM ({to_utm_sql("corners")}) GROUP BY ALL
), {shape}, cells AS (SELECT *, unnest(range(0, ny::BIGINT)) AS j FROM (SELECT *, unnest(range(0, nx::BIGINT)) AS i FROM shaped)
), tiles AS (SELECT *, x_min + i * w / nx AS x0, x_min + (i + 1) * w / nx AS x1, y_min + j * h / ny AS y0, y_min + (j + 1) * h / ny AS y1 FROM cells
), tile_corners AS (SELECT area_id, zone, north, i, j, x0, x1, y0, y1, unnest([x0, x0, x1, x1]) AS x, unnest([y0, y1, y0, y1]) AS y FROM tiles)
SELECT area_id, (CASE WHEN north THEN 32600 ELSE 32700 END + zone)::INTEGER AS epsg, i::INTEGER AS i, j::INTEGER AS j, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1,
  round(min(lon), 7) AS lon_min, round(min(lat), 7) AS lat_min, round(max(lon), 7) AS lon_max, round(max(lat), 7) AS lat_max FROM ({to_lonlat_sql("tile_corners")}) GROUP BY area_id, zone, north, i, j, x0, x1, y0, y1"""


def _grid(tiles: DataFrame) -> DataFrame:
    metres = [F.round(n, 3).alias(n) for n in ("x0", "y0", "x1", "y1")]
    return tiles.select("area_id", F.col("epsg").cast("int").alias("epsg"), "i", "j", *metres, *[F.round(n, 7).alias(n) for n in ("lon_min", "lat_min", "lon_max", "lat_max")])


_BY_NUMBER = f"""first AS (SELECT *, greatest(1.0, round_even(sqrt(30 * (w / h)), 0)) AS a, greatest(1.0, round_even(sqrt(30 / (w / h)), 0)) AS b FROM bounds
), wide AS (SELECT *, {_GROWN.format(n="a", o="b")} AS nx FROM first), shaped AS (SELECT *, {_GROWN.format(n="b", o="nx")} AS ny FROM wide)"""


@query(views.with_views("v_area", grid_sql(_BY_NUMBER)))
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of about 30 tiles: bounds in UTM metres and boxes in degrees."""
    return _grid(tiling.grid_tiles(views.areas(spark, sf_dir), 30))


@query(views.with_views("v_area", grid_sql("shaped AS (SELECT *, greatest(1.0, ceil(w / 9000.0)) AS nx, greatest(1.0, ceil(h / 9000.0)) AS ny FROM bounds)")))
def grid_tiles_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of tiles of nine kilometres at most."""
    return _grid(tiling.grid_tiles(views.areas(spark, sf_dir), side_m=9000.0))


_SPLIT = 3


@query(views.with_views("v_area", f""", cells AS (SELECT area_id, lon_min, lat_min, lon_max - lon_min AS w, lat_max - lat_min AS h, i, j, i / {_SPLIT}.0 AS a, (i + 1) / {_SPLIT}.0 AS b, j / {_SPLIT}.0 AS c, (j + 1) / {_SPLIT}.0 AS d
  FROM v_area, (SELECT unnest(range(0, {_SPLIT})) AS i), (SELECT unnest(range(0, {_SPLIT})) AS j)
), parts AS (SELECT *, greatest(a, 1 - d) AS u, least(b, 1 - c) AS v FROM cells WHERE a + c < 1
) SELECT area_id * 100 + i * 10 + j AS tile_id, round(lon_min + a * w, 9)::DOUBLE AS lon_min, round(lat_min + c * h, 9)::DOUBLE AS lat_min, round(lon_min + v * w, 9)::DOUBLE AS lon_max, round(lat_min + least(d, 1 - a) * h, 9)::DOUBLE AS lat_max,
  round(w * h * ((least(b, u) - a) * (d - c) + CASE WHEN v > u THEN (v - u) * (1 - c) - (v * v - u * u) / 2 ELSE 0 END), 9)::DOUBLE AS area FROM parts
  WHERE (least(b, u) - a) * (d - c) + CASE WHEN v > u THEN (v - u) * (1 - c) - (v * v - u * u) / 2 ELSE 0 END > 1e-9"""))
def clipped_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three by three tiles of every area, cut to the triangle below its falling diagonal."""
    c = F.col
    a = views.areas(spark, sf_dir).withColumns({"w": c("lon_max") - c("lon_min"), "h": c("lat_max") - c("lat_min")})
    ring = F.array(F.array("lon_min", "lat_min"), F.array("lon_max", "lat_min"), F.array("lon_min", "lat_max"), F.array("lon_min", "lat_min"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(_SPLIT) for j in range(_SPLIT)])
    t = a.select("area_id", "lon_min", "lat_min", "w", "h", ring.alias("ring"), F.explode(cells).alias("k"))
    box = {"lon_min": c("lon_min") + c("k.i") * c("w") / _SPLIT, "lat_min": c("lat_min") + c("k.j") * c("h") / _SPLIT}
    t = t.select((c("area_id") * 100 + c("k.i") * 10 + c("k.j")).alias("tile_id"), "ring", "w", "h", *[v.alias(k) for k, v in box.items()])
    t = t.withColumns({"lon_max": c("lon_min") + c("w") / _SPLIT, "lat_max": c("lat_min") + c("h") / _SPLIT})
    out = tiling.clip_tiles(t).where("area > 1e-9")
    return out.select("tile_id", *[F.round(n, 9).alias(n) for n in ("lon_min", "lat_min", "lon_max", "lat_max", "area")])


def _cut_sql() -> str:
    """Tiles of about 25 a triangle, cut to it in metres: a half-plane for each side of a tile, from ring to ring."""
    parts = [
        "z AS (SELECT *, floor(((lon_min + lon_max) / 2 + 180) / 6) + 1 AS zone, (lat_min + lat_max) / 2 >= 0 AS north FROM (SELECT DISTINCT * FROM v_area))",
        "points AS (SELECT area_id, zone, north, p, [lon_min, lon_max, lon_min][p] AS lon, [lat_min, lat_min, lat_max][p] AS lat FROM z, (SELECT unnest([1, 2, 3]) AS p))",
        f"metres AS ({to_utm_sql('points')})",
        "rings AS (SELECT area_id, zone, north, list([x, y] ORDER BY p) AS ring, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, max(x) - min(x) AS w, max(y) - min(y) AS h FROM metres GROUP BY ALL)",
        "first AS (SELECT *, greatest(1.0, round_even(sqrt(25 * (w / h)), 0)) AS a, greatest(1.0, round_even(sqrt(25 / (w / h)), 0)) AS b FROM rings)",
        f"wide AS (SELECT *, {_GROWN.format(n='a', o='b').replace('30', '25').replace('33.0', '27.5')} AS nx FROM first), shaped AS (SELECT *, {_GROWN.format(n='b', o='nx').replace('30', '25').replace('33.0', '27.5')} AS ny FROM wide)",
        "cells AS (SELECT *, unnest(range(0, ny::BIGINT)) AS j FROM (SELECT *, unnest(range(0, nx::BIGINT)) AS i FROM shaped))",
        "c0 AS (SELECT area_id, zone, north, i, j, ring, x_min + i * w / nx AS x0, x_min + (i + 1) * w / nx AS x1, y_min + j * h / ny AS y0, y_min + (j + 1) * h / ny AS y1 FROM cells)",
    ]
    for k, (axis, limit, sign) in enumerate(((1, "x0", 1), (1, "x1", -1), (2, "y0", 1), (2, "y1", -1)), 1):
        da, db = (f"{sign} * (e.{v}[{axis}] - {limit})" for v in ("a", "b"))
        parts.append(
            f"e{k} AS (SELECT area_id, zone, north, i, j, x0, y0, x1, y1, n, CASE WHEN {da} >= 0 THEN [e.a] ELSE [] END || CASE WHEN {da} > 0 AND {db} < 0 OR {da} < 0 AND {db} > 0 THEN [[e.a[1] + {da} / ({da} - {db}) * (e.b[1] - e.a[1]), e.a[2] + {da} / ({da} - {db}) * (e.b[2] - e.a[2])]] ELSE [] END AS kept"
            f" FROM (SELECT *, unnest(list_transform(range(1, len(ring) + 1), lambda k: {{'a': ring[k], 'b': ring[k % len(ring) + 1]}})) AS e, unnest(range(1, len(ring) + 1)) AS n FROM c{k - 1})),"
            f" c{k} AS (SELECT area_id, zone, north, i, j, x0, y0, x1, y1, flatten(list(kept ORDER BY n)) AS ring FROM e{k} GROUP BY ALL HAVING len(flatten(list(kept))) > 0)"
        )
    parts.append("areas AS (SELECT area_id, zone, north, i, j, abs(list_sum(list_transform(range(1, len(ring) + 1), lambda k: ring[k][1] * ring[k % len(ring) + 1][2] - ring[k % len(ring) + 1][1] * ring[k][2]))) / 2 AS area, ring FROM c4 WHERE len(ring) >= 3)")
    parts.append("corners AS (SELECT area_id, zone, north, i, j, area, p[1] AS x, p[2] AS y FROM (SELECT *, unnest(ring) AS p FROM areas WHERE area > 1))")
    return ", " + ",\n".join(parts) + f""" SELECT area_id, (CASE WHEN north THEN 32600 ELSE 32700 END + zone)::INTEGER AS epsg, i::INTEGER AS i, j::INTEGER AS j, round(min(lon), 6) AS lon_min, round(min(lat), 6) AS lat_min, round(max(lon), 6) AS lon_max, round(max(lat), 6) AS lat_max,
  round(area / 10000, 1) AS hectares FROM ({to_lonlat_sql("corners")}) GROUP BY area_id, zone, north, i, j, area"""


@query(views.with_views("v_area", _cut_sql()))
def polygon_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 25 tiles of the triangle of every area, cut to it in UTM: boxes in degrees and hectares of what is inside."""
    ring = F.array(F.array("lon_min", "lat_min"), F.array("lon_max", "lat_min"), F.array("lon_min", "lat_max"), F.array("lon_min", "lat_min"))
    rings = views.areas(spark, sf_dir).select("area_id", ring.alias("ring")).distinct()
    tiles = tiling.polygon_tiles(rings, 25).where("area_m2 > 1")
    return tiles.select("area_id", F.col("epsg").cast("int").alias("epsg"), "i", "j", *[F.round(n, 6).alias(n) for n in ("lon_min", "lat_min", "lon_max", "lat_max")], F.round(F.col("area_m2") / 10000, 1).alias("hectares"))


@query(views.with_views("v_area", " SELECT area_id, row_number() OVER (ORDER BY round((lon_max - lon_min) * (lat_max - lat_min) * (1 + 30 / 365.0), 12) DESC, area_id) AS place FROM v_area"))
def tile_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tiling.with_priority(views.areas(spark, sf_dir), 30)
    return numbered(a, F.round("priority", 12).desc(), F.col("area_id")).select("area_id", "place")


# --- gap filling -----------------------------------------------------------------------------


def _gap_inputs(spark: SparkSession, sf_dir: str, *, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    tested = stored(tested_scenes(spark, sf_dir), "tested")
    patience = PATIENCE(F.col("n"))
    accepted = sel.quality_ladder(sel.cloud_ladder(tested, patience), patience)
    chosen = stored(sel.phase_one(sel.with_fallback(sel.stop_after_excellent(accepted))), "chosen")
    return chosen, gapfill.gap_candidates(tested if digits is None else tested.withColumn("score", F.round("score", digits)), chosen)


_CAND_SQL = PHASE_SQL + f""", cand AS (SELECT x.*, coalesce((SELECT min(abs(x.days - p.days)) FROM phase p WHERE p.tile_id = x.tile_id), 999) AS dist, ({RES_SQL}) AS res
  FROM tested x WHERE NOT EXISTS (SELECT 1 FROM phase p WHERE p.scene_id = x.scene_id))"""


@query(with_recursive(views.with_views("v_scene", _CAND_SQL + """ SELECT tile_id, scene_id, dist::INTEGER AS day_distance,
  round(0.7 / (1 + res / 30.0) + CASE WHEN dist <= 10 THEN 0.15 * (1 - dist / 10.0) WHEN dist <= 30 THEN 0.05 * (1 - (dist - 10) / 20.0) ELSE 0 END + 0.15 * score, 9)::DOUBLE AS gap_score FROM cand""")))
def gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap_inputs(spark, sf_dir)[1].select("tile_id", "scene_id", "day_distance", F.round("gap_score", 9).alias("gap_score"))


_BETTER = """CASE WHEN b.r - c.r > 50 THEN c.s >= 0.90 * b.s WHEN b.r - c.r > 20 THEN c.s >= 0.95 * b.s
  WHEN b.r - c.r < -50 THEN c.s > 1.15 * b.s WHEN b.r - c.r < -20 THEN c.s > 1.10 * b.s ELSE c.s > b.s END"""


def sequence_sql() -> str:
    """Additions to every tile from ``cand`` (with dist, res and score), iteration by iteration over lists of what is left."""

    def pick(floor: str) -> str:
        fit = f"list_filter(rows, lambda x: x.s >= {floor})"
        return f"CASE WHEN len({fit}) > 0 THEN list_reduce({fit}, lambda b, c: CASE WHEN {_BETTER} THEN c ELSE b END) END"

    gap = "0.7 / (1 + res / 30.0) + CASE WHEN dist <= 10 THEN 0.15 * (1 - dist / 10.0) WHEN dist <= 30 THEN 0.05 * (1 - (dist - 10) / 20.0) ELSE 0 END + 0.15 * round(score, 9)"
    return f""", lists AS (SELECT tile_id, list({{'id': scene_id, 's': round(score, 9)::DOUBLE, 'r': res::DOUBLE}} ORDER BY ({gap})::DOUBLE DESC, scene_id) AS rows FROM cand GROUP BY tile_id
), grown AS (
  SELECT tile_id, 0 AS k, 0 AS step, rows, NULL::BIGINT AS scene_id, false AS low FROM lists
  UNION ALL
  SELECT tile_id, k + 1, step + (p IS NOT NULL)::INT, CASE WHEN p IS NULL THEN rows ELSE list_filter(rows, lambda x: x.id <> p.id) END, p.id, low
  FROM (SELECT *, coalesce(a, b) AS p, a IS NULL AS low FROM (
    SELECT *, {pick("greatest(0.2, 0.5 - 0.05 * k)")} AS a, CASE WHEN k < {gapfill.MAX_ITERATIONS - 5} THEN {pick(str(gapfill.LOW_QUALITY))} END AS b FROM (SELECT tile_id, k, step, rows FROM grown WHERE k < {gapfill.MAX_ITERATIONS})))
), seq AS (SELECT tile_id, step::INTEGER AS step, scene_id, low AS low_quality FROM grown WHERE k > 0 AND scene_id IS NOT NULL)"""


@query(with_recursive(views.with_views("v_scene", _CAND_SQL + sequence_sql() + " SELECT * FROM seq")))
def gap_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered fold over candidates; their scores are rounded, so that equal ones tie."""
    return gapfill.add_sequence(_gap_inputs(spark, sf_dir, digits=9)[1])


_COVER_SQL = """WITH v AS (SELECT tile_id, step, least(1.0, 0.4 + (tile_id * 37 % 50) / 100.0 + CASE WHEN tile_id % 3 = 0 THEN 0 ELSE step * (tile_id % 7) / 40.0 END)::DOUBLE AS coverage
  FROM (SELECT DISTINCT user_id AS tile_id FROM events), (SELECT unnest(range(0, 12)) AS step)
), d AS (SELECT *, (coverage - lag(coverage) OVER w < 0.001)::INT AS flat FROM v WINDOW w AS (PARTITION BY tile_id ORDER BY step)
), s AS (SELECT *, coverage >= 0.999 OR coalesce(flat, 0) + coalesce(lag(flat, 1) OVER w, 0) + coalesce(lag(flat, 2) OVER w, 0) = 3 AS stop FROM d WINDOW w AS (PARTITION BY tile_id ORDER BY step)
), l AS (SELECT tile_id, coalesce(min(step) FILTER (WHERE stop), max(step)) AS last_step FROM s GROUP BY tile_id)"""


def _coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.read(spark, sf_dir, "events").select(F.col("user_id").alias("tile_id")).distinct()
    t = t.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(11))))
    grows = F.when(F.col("tile_id") % 3 == 0, 0.0).otherwise(F.col("step") * (F.col("tile_id") % 7) / 40.0)
    return t.withColumn("coverage", F.least(F.lit(1.0), 0.4 + (F.col("tile_id") * 37 % 50) / 100.0 + grows))


@query(_COVER_SQL + " SELECT tile_id, last_step::INTEGER AS last_step FROM l")
def gap_stop_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gapfill.stop_step(_coverages(spark, sf_dir)).select("tile_id", "last_step")


@query(_COVER_SQL + """ SELECT tile_id, round(arg_min(coverage, step), 6) AS initial_coverage, round(arg_max(coverage, step), 6) AS final_coverage, max(step)::INTEGER AS images_added,
  round(arg_max(coverage, step) - arg_min(coverage, step), 6) AS coverage_improvement FROM v JOIN l USING (tile_id) WHERE step <= last_step GROUP BY tile_id""")
def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coverages(spark, sf_dir)
    out = gapfill.gap_statistics(c, gapfill.stop_step(c))
    return out.select("tile_id", "images_added", *[F.round(n, 6).alias(n) for n in ("initial_coverage", "final_coverage", "coverage_improvement")])


_PIX_SQL = """, px AS (SELECT tile_id, pixel_id AS scene_id, (pixel_id % 7)::INTEGER AS row, (pixel_id // 7 % 7)::INTEGER AS col, B4, CASE WHEN pixel_id % 5 <> 0 THEN B3 END AS B3, CASE WHEN pixel_id % 3 <> 0 THEN B2 END AS B2, (pixel_id * 13 % 6)::INTEGER AS step FROM v_acq
), cells AS (SELECT tile_id, row, col, min(step) FILTER (WHERE B4 IS NOT NULL) AS a, min(step) FILTER (WHERE B3 IS NOT NULL) AS b, min(step) FILTER (WHERE B2 IS NOT NULL) AS c FROM px GROUP BY ALL
), steps AS (SELECT DISTINCT tile_id, s.step FROM px, (SELECT unnest(range(0, 6))::INTEGER AS step) s WHERE s.step = 0 OR EXISTS (SELECT 1 FROM px q WHERE q.tile_id = px.tile_id AND q.step = s.step))"""


@query(views.with_views("v_acq", _PIX_SQL + " SELECT s.tile_id, s.step, round(avg(coalesce((a <= s.step)::INT, 0) + coalesce((b <= s.step)::INT, 0) + coalesce((c <= s.step)::INT, 0)) / 3, 6) AS coverage FROM steps s JOIN cells USING (tile_id) GROUP BY ALL"))
def coverage_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pixel_id")
    px = views.acquisitions(spark, sf_dir).select(
        "tile_id", k.alias("scene_id"), (k % 7).cast("int").alias("row"), F.floor(k / 7 % 7).cast("int").alias("col"), "B4", F.when(k % 5 != 0, F.col("B3")).alias("B3"), F.when(k % 3 != 0, F.col("B2")).alias("B2")
    )
    seq = px.select("tile_id", "scene_id", (F.col("scene_id") * 13 % 6).cast("int").alias("step")).where("step > 0")
    out = gapfill.coverage_by_step(px, seq).withColumn("coverage", F.round("coverage", 6))
    return out


# --- reports ---------------------------------------------------------------------------------

_TILES = """WITH tiles AS (SELECT o_orderkey AS tile_id, CASE o_orderkey % 7 WHEN 0 THEN 'no_imagery' WHEN 1 THEN 'missing_bands' WHEN 2 THEN 'validation_failed' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 7 <> 0 THEN round((o_orderkey * 31 % 401) / 400.0, 4)::DOUBLE END AS coverage,
  CASE WHEN o_orderkey % 7 <> 0 THEN ['SENTINEL_2', 'LANDSAT_8', 'LANDSAT_5', 'MODIS_TERRA'][o_custkey % 4 + 1] END AS dominant,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 9 END AS images_added, o_custkey % 4 AS gaps_identified, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 4 END AS gaps_filled FROM orders)"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(k % 7 == 0, "no_imagery").when(k % 7 == 1, "missing_bands").when(k % 7 == 2, "validation_failed").otherwise("ok")
    names = F.array(*[F.lit(s) for s in ("SENTINEL_2", "LANDSAT_8", "LANDSAT_5", "MODIS_TERRA")])
    return views.read(spark, sf_dir, "orders").select(
        k.alias("tile_id"), status.alias("status"), F.when(k % 7 != 0, F.round((k * 31 % 401) / 400.0, 4)).alias("coverage"), F.when(k % 7 != 0, F.get(names, (c % 4).cast("int"))).alias("dominant"),
        F.when(k % 5 != 0, c % 9).alias("images_added"), (c % 4).alias("gaps_identified"), F.when(c % 3 == 0, 0).otherwise(c % 4).alias("gaps_filled"),
    )


@query(_TILES + """ SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS processed, count(*) FILTER (WHERE status = 'ok' AND coverage < 0.95) AS partial, count(*) FILTER (WHERE status <> 'ok') AS failed,
  round(avg(coverage), 6) AS mean_coverage, sum(gaps_identified)::BIGINT AS gaps_identified, sum(gaps_filled)::BIGINT AS gaps_filled, round(100.0 * count(*) FILTER (WHERE status = 'ok') / count(*), 6) AS success_rate,
  round(100.0 * sum(gaps_filled) / sum(gaps_identified), 6) AS fill_rate FROM tiles""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.summary(_tiles(spark, sf_dir))
    return out.withColumns({n: F.round(n, 6) for n in ("mean_coverage", "success_rate", "fill_rate")})


@query(_TILES + " SELECT dominant, count(*) AS tiles, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM tiles WHERE dominant IS NOT NULL GROUP BY dominant")
def report_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.dominance(_tiles(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(_TILES + " SELECT count(*) FILTER (WHERE coverage >= 0.99) AS excellent, count(*) FILTER (WHERE coverage >= 0.95 AND coverage < 0.99) AS good, count(*) FILTER (WHERE coverage >= 0.8 AND coverage < 0.95) AS fair, count(*) FILTER (WHERE coverage < 0.8) AS poor, round(avg(coverage), 6) AS mean, min(coverage) AS low, max(coverage) AS high FROM tiles")
def report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage_buckets(_tiles(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(_TILES + " SELECT status, count(*) AS n FROM tiles WHERE status <> 'ok' GROUP BY status")
def report_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.failures(_tiles(spark, sf_dir))


@query(_TILES + " SELECT tile_id, status, CASE WHEN coalesce(coverage, 0) > 0 THEN printf('%.1f%%', floor(coverage * 1000 + 0.5) / 10) ELSE 'N/A' END AS coverage, coalesce(dominant, 'N/A') AS dominant, coalesce(images_added, 0) + 1 AS images_used FROM tiles")
def report_status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.status_table(_tiles(spark, sf_dir))


@query(_TILES + " SELECT tile_id, 'Tile ' || tile_id || ': ' || status AS message FROM tiles WHERE status <> 'ok' ORDER BY tile_id LIMIT 20")
def report_first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_messages(_tiles(spark, sf_dir))


@query(views.with_views("v_scene", f"{SCORED_SQL} SELECT round(avg(score), 6) AS mean, round(min(score), 6) AS low, round(max(score), 6) AS high, count(score) AS n FROM scored"))
def report_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.quality_statistics(scored_scenes(spark, sf_dir))
    return out.withColumns({n: F.round(n, 6) for n in ("mean", "low", "high")})


@query(views.with_views("v_scene", f"{SCORED_SQL} SELECT sensor, n, scene_id, round(score, 6) AS score, round(cloud, 6)::DOUBLE AS cloud FROM (SELECT *, count(*) OVER (PARTITION BY sensor) AS n, row_number() OVER (PARTITION BY sensor ORDER BY score DESC, scene_id) AS r FROM scored) WHERE r = 1"))
def report_best_per_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.best_per_sensor(scored_scenes(spark, sf_dir)).withColumns({n: F.round(n, 6) for n in ("score", "cloud")})


@query(views.with_views("v_scene", f"{SCORED_SQL}, b AS (SELECT tile_id, arg_max(sensor, round(score * 1000000000)::HUGEINT * 1000000000000 - scene_id) AS dominant FROM scored GROUP BY tile_id) SELECT dominant, count(*) AS tiles, count(DISTINCT tile_id) AS distinct_tiles FROM b GROUP BY dominant"))
def dominant_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by the sensor of their best scene."""
    order = F.struct(F.round(F.col("score") * 1e9).alias("s"), -F.col("scene_id"))
    best = scored_scenes(spark, sf_dir).groupBy("tile_id").agg(F.max_by("sensor", order).alias("dominant"))
    return best.groupBy("dominant").agg(F.count("*").alias("tiles"), F.countDistinct("tile_id").alias("distinct_tiles"))


@query("SELECT sensor, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'SENTINEL_2' WHEN 'click' THEN 'LANDSAT_8' WHEN 'purchase' THEN 'LANDSAT_9' WHEN 'signup' THEN 'MODIS_TERRA' ELSE 'VIIRS' END AS sensor FROM events) GROUP BY sensor ORDER BY n DESC, sensor LIMIT 10")
def top_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scenes(spark, sf_dir).groupBy("sensor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sensor").limit(10)


@query(views.with_views("v_scene", " SELECT tile_id, count(*) AS candidates, CASE WHEN count(*) <= 3 THEN 1 WHEN count(*) <= 10 THEN 2 ELSE 3 END AS patience, count(DISTINCT sensor) AS sensors FROM v_scene GROUP BY tile_id"))
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.scenes(spark, sf_dir).groupBy("tile_id").agg(F.count("*").alias("candidates"), F.countDistinct("sensor").alias("sensors"))
    return out.withColumn("patience", tests_before_lowering(F.col("candidates")))


# --- progress --------------------------------------------------------------------------------

_EV = "ev AS (SELECT event_id, user_id % 10 AS grp, floor(epoch(ts))::DOUBLE AS completed_at, value AS seconds FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 10).alias("grp"), F.col("ts").cast("timestamp").cast("long").cast("double").alias("completed_at"), F.col("value").alias("seconds"))


@query(f"WITH {_EV} SELECT event_id, round(avg(seconds) OVER (PARTITION BY grp ORDER BY completed_at, event_id ROWS 19 PRECEDING), 6) AS rolling, count(*) OVER (PARTITION BY grp ORDER BY completed_at, event_id ROWS 99 PRECEDING) AS kept FROM ev")
def rolling_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.rolling_mean(_events(spark, sf_dir)).select("event_id", F.round("rolling", 6).alias("rolling"), "kept")


@query(f"""WITH {_EV}, w AS (SELECT *, row_number() OVER o AS done, first_value(completed_at) OVER r AS f, count(*) OVER r AS n, min(completed_at) OVER o AS s FROM ev
  WINDOW o AS (PARTITION BY grp ORDER BY completed_at, event_id ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY grp ORDER BY completed_at, event_id ROWS 29 PRECEDING))
SELECT event_id, done, round(greatest(0, 2000 - done) * CASE WHEN n > 1 AND completed_at > f THEN (completed_at - f) / (n - 1) ELSE (completed_at - s) / done END, 3) AS remaining FROM w""")
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.remaining_seconds(_events(spark, sf_dir), 2000).select("event_id", F.col("done").cast("long").alias("done"), F.round("remaining", 3).alias("remaining"))


@query(f"WITH {_EV} SELECT grp, round(avg(seconds), 6) AS mean, min(seconds) AS low, max(seconds) AS high, count(*) AS n, round(3600.0 * count(*) / (max(completed_at) - min(completed_at)), 6) AS per_hour FROM ev GROUP BY grp")
def time_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.time_statistics(_events(spark, sf_dir)).withColumns({n: F.round(n, 6) for n in ("mean", "per_hour")})


@query(f"""WITH {_EV}, z AS (SELECT grp, completed_at AS a, completed_at + (event_id % 7) * 900.0 AS b FROM ev WHERE event_id % 5 = 0 AND event_id % 7 > 0
), s AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY grp ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM z
), m AS (SELECT grp, min(a) AS a, max(b) AS b FROM (SELECT *, sum(begins) OVER (PARTITION BY grp ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM s) GROUP BY grp, i
), p AS (SELECT ev.*, coalesce((SELECT sum(least(m.b, ev.completed_at) - m.a) FROM m WHERE m.grp = ev.grp AND m.a < ev.completed_at), 0) AS paused FROM ev
), w AS (SELECT *, row_number() OVER o AS done, first_value(completed_at - paused) OVER r AS f, count(*) OVER r AS n, min(completed_at - paused) OVER o AS s FROM p
  WINDOW o AS (PARTITION BY grp ORDER BY completed_at - paused, event_id ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY grp ORDER BY completed_at - paused, event_id ROWS 29 PRECEDING))
SELECT event_id, round(paused, 3)::DOUBLE AS paused, round(greatest(0, 2000 - done) * CASE WHEN n > 1 AND completed_at - paused > f THEN (completed_at - paused - f) / (n - 1) ELSE (completed_at - paused - s) / done END, 3)::DOUBLE AS remaining FROM w""")
def remaining_without_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time left by rates that leave out the pauses, which may overlap."""
    e = _events(spark, sf_dir)
    pauses = e.where((F.col("event_id") % 5 == 0) & (F.col("event_id") % 7 > 0)).select("grp", F.col("completed_at").alias("paused_at"), (F.col("completed_at") + F.col("event_id") % 7 * 900.0).alias("resumed_at"))
    active = progress.without_pauses(e, pauses)
    return progress.remaining_seconds(active, 2000).select("event_id", F.round("paused", 3).alias("paused"), F.round("remaining", 3).alias("remaining"))


@query(f"""WITH {_EV}, f AS (SELECT *, coalesce(abs(seconds - lag(seconds) OVER (PARTITION BY grp ORDER BY completed_at, event_id)) < 60, false) AS flat FROM ev
), i AS (SELECT *, sum((NOT flat)::INT) OVER (PARTITION BY grp ORDER BY completed_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT event_id, sum(flat::INT) OVER (PARTITION BY grp, island ORDER BY completed_at, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS stalled FROM i""")
def stalled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.stalled_runs(_events(spark, sf_dir), threshold=60.0).select("event_id", "stalled")


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE floor(value * 37) - 100 END AS x FROM events), p AS (SELECT *, floor(x)::BIGINT AS v FROM s)
SELECT event_id, CASE WHEN x IS NULL OR x < 0 THEN '--:--:--' WHEN v >= 3600 THEN printf('%02d:%02d:%02d', v // 3600, v % 3600 // 60, v % 60) ELSE printf('%02d:%02d', v // 60, v % 60) END AS clock,
  CASE WHEN x IS NULL OR x < 0 THEN '--:--:--' ELSE printf('%02d:%02d:%02d', v // 3600, v % 3600 // 60, v % 60) END AS long_clock, CASE WHEN x >= 0 AND x < 60 THEN printf('%.0f seconds', x) END AS short,
  CASE WHEN event_id % 103 > 97 OR event_id % 101 > 95 THEN -1 WHEN event_id % 103 < 90 AND event_id % 101 < 95 AND event_id % 2 > 0 THEN 1 ELSE 0 END AS workers,
  round(((event_id % 50) * 100.0 / 50 + (event_id % 12) * 100.0 / 12) / 2, 6)::DOUBLE AS share FROM p""".replace("> 97", "> 95"))
def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    x = F.when(k % 17 != 0, F.floor(F.col("value") * 37) - 100).cast("double")
    return views.read(spark, sf_dir, "events").select(
        "event_id", progress.clock(x).alias("clock"), progress.clock(x, hours=True).alias("long_clock"), F.when((x >= 0) & (x < 60), progress.duration_text(x)).alias("short"),
        progress.worker_change(k % 103, k % 101, k % 2).alias("workers"), F.round(progress.progress_share(k % 50, F.lit(50), k % 12, F.lit(12)), 6).alias("share"),
    )


# --- text and JSON ---------------------------------------------------------------------------


@query(r"""SELECT page_id, regexp_replace(lower(url), '[ /]', '_', 'g') AS file_name,
  CASE WHEN length(substr(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), 1, 10)) = 0 THEN 'field' WHEN regexp_matches(substr(url, 1, 1), '[0-9]') THEN substr('_' || substr(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), 1, 10), 1, 10)
       ELSE substr(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), 1, 10) END AS field_name,
  'tile_20240115_t' || lpad((page_id % 10000)::VARCHAR, 4, '0') AS prefix, repeat('*', (page_id % 5)::INT) AS stars, substr(url, 1, 60) AS short_url,
  CASE WHEN contains(lower(url), 'quota') THEN 'quota' WHEN contains(lower(url), 'not found') THEN 'not_found' WHEN contains(lower(url), 'too large') OR contains(lower(url), 'limit') THEN 'too_large' ELSE 'other' END AS error_class,
  CASE WHEN page_id % 4 = 0 THEN '????' ELSE lpad((page_id % 10000)::VARCHAR, 4, '0') END AS padded FROM pages""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, k = F.col("url"), F.col("page_id")
    return views.read(spark, sf_dir, "pages").select(
        "page_id", text.file_name(url).alias("file_name"), text.field_name(url).alias("field_name"), text.tile_prefix(F.lit("2024-01-15").cast("date"), k % 10000).alias("prefix"),
        text.stars((k % 5).cast("int")).alias("stars"), F.substring(url, 1, 60).alias("short_url"), text.error_class(url).alias("error_class"), text.padded(F.when(k % 4 != 0, k % 10000)).alias("padded"),
    )


@query(views.with_views("v_scene", " SELECT DISTINCT sensor, CASE sensor WHEN 'SENTINEL_2' THEN 'Sentinel-2' WHEN 'LANDSAT_8' THEN 'Landsat-8' WHEN 'LANDSAT_9' THEN 'Landsat-9' WHEN 'MODIS_TERRA' THEN 'Modis-Terra' ELSE 'Viirs' END AS name FROM v_scene"))
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scenes(spark, sf_dir).select("sensor").distinct().withColumn("name", text.display_name(F.col("sensor")))


@query(views.with_views("v_area", """ SELECT area_id, CASE WHEN area_id % 4 <> 3 THEN round(lon_min, 6) END AS lon_min, CASE WHEN area_id % 4 <> 3 THEN round(lat_min, 6) END AS lat_min,
  CASE WHEN area_id % 4 <> 3 THEN round(lon_max, 6) END AS lon_max, CASE WHEN area_id % 4 <> 3 THEN round(lat_max, 6) END AS lat_max FROM v_area"""))
def imported_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written in three formats and one broken one, and read back."""
    a = views.areas(spark, sf_dir)
    box = F.struct("lon_min", "lat_min", "lon_max", "lat_max")
    numbers = F.concat_ws(",", *[F.col(n).cast("string") for n in ("lon_min", "lat_min", "lon_max", "lat_max")])
    k = F.col("area_id")
    written = F.when(k % 4 == 0, numbers).when(k % 4 == 1, F.concat(F.lit("BBOX: "), F.replace(numbers, F.lit(","), F.lit("  "))))
    written = written.when(k % 4 == 2, text.feature_json(box, name=k.cast("string"))).otherwise(F.concat(numbers, F.lit(",oops")))
    read = text.geometry_box(written)
    return a.select("area_id", *[F.round(read[n], 6).alias(n) for n in ("lon_min", "lat_min", "lon_max", "lat_max")])


@query(views.with_views("v_area", """ SELECT area_id, round(lon_max - lon_min, 6) AS width, round(lat_max - lat_min, 6) AS height, 5 AS points, true AS closed FROM v_area"""))
def box_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of written features: closed, of five points, with the box they came from."""
    a = views.areas(spark, sf_dir)
    feature = F.from_json(text.feature_json(F.struct("lon_min", "lat_min", "lon_max", "lat_max"), name=F.lit("a")), text.FEATURE)
    ring = F.get(feature["geometry"]["coordinates"], F.lit(0))
    box = text.ring_box(ring)
    return a.select(
        "area_id", F.round(box["lon_max"] - box["lon_min"], 6).alias("width"), F.round(box["lat_max"] - box["lat_min"], 6).alias("height"), F.size(ring).alias("points"),
        (F.get(ring, F.lit(0)) == F.get(ring, F.lit(4))).alias("closed"),
    )
