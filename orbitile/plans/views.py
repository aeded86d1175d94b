"""Scenes, pixels and chips bound to the test tables.

The test tables hold no imagery; these views give their rows the shape of scene metadata
(events), long-range acquisitions with band values (lineitem), and 8 x 8 chips (embeddings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitile.sources.sensors import SENSORS

PERIOD_START, PERIOD_DAYS = "2024-01-01", 30
SENSOR_OF_EVENT = {"view": "SENTINEL_2", "click": "LANDSAT_8", "purchase": "LANDSAT_9", "signup": "MODIS_TERRA"}
SENSORS_OF_SUPPLIER = ["LANDSAT_5", "LANDSAT_7", "SPOT_3", "SPOT_4", "MODIS_TERRA", "ASTER"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene metadata; one in a few dozen values of each kind is null."""
    e = read(spark, sf_dir, "events")
    sensor = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in SENSOR_OF_EVENT.items()], F.lit("VIIRS"))
    number = F.col("event_id")
    return e.select(
        number.alias("scene_id"),
        F.col("user_id").alias("tile_id"),
        sensor.alias("sensor"),
        F.when(number % 37 != 0, F.get_json_object("props", "$.k").cast("double")).alias("cloud_pct"),
        F.when(number % 41 != 0, F.col("value") % 90.0).alias("sun_zenith"),
        F.when(number % 43 != 0, (number % 300) / 10.0).alias("view_zenith"),
        F.when(number % 11 != 0, (number % 97 + 3) / 100.0).alias("mask_mean"),
        F.to_date("ts").alias("acquired"),
        F.datediff(F.to_date("ts"), F.lit(PERIOD_START).cast("date")).alias("days"),
    )


# Tiles ask for one of these months; the sensors that fly then take turns, and in the first months one scene in ten is of any sensor.
MONTHS = [
    ("1976-06-01", ["LANDSAT_1_MSS", "LANDSAT_2_MSS"]),
    ("1983-02-01", ["LANDSAT_4", "LANDSAT_3_MSS", "NOAA_AVHRR"]),
    ("1990-06-01", ["LANDSAT_4", "LANDSAT_5", "SPOT_1", "SPOT_2", "NOAA_AVHRR"]),
    ("2002-08-01", ["LANDSAT_5", "LANDSAT_7", "SPOT_4", "MODIS_TERRA", "MODIS_AQUA", "ASTER", "NOAA_AVHRR"]),
    ("2024-01-01", ["SENTINEL_2", "LANDSAT_7", "LANDSAT_8", "LANDSAT_9", "MODIS_TERRA", "VIIRS", "NOAA_AVHRR"]),
    ("2006-05-01", ["MODIS_TERRA", "NOAA_AVHRR"]),
    ("1980-04-01", ["NOAA_AVHRR"]),
]
ANY_SENSOR_MONTHS = 5


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene metadata of all sensors over fifty years, with the month that each tile asks for."""
    any_sensor = F.array(*[F.lit(s[0]) for s in SENSORS])
    month = F.col("tile_id") % len(MONTHS)
    starts = F.get(F.array(*[F.lit(m) for m, _ in MONTHS]), month.cast("int")).cast("date")
    turns = F.get(F.array(*[F.array(*[F.lit(s) for s in names]) for _, names in MONTHS]), month.cast("int"))
    number = F.col("scene_id")
    turn = F.get(turns, (number % F.size(turns)).cast("int"))
    sensor = F.when((number % 10 == 3) & (month < ANY_SENSOR_MONTHS), F.get(any_sensor, F.floor(number / 10 % len(SENSORS)).cast("int"))).otherwise(turn)
    out = scenes(spark, sf_dir).withColumns({"sensor": sensor, "period_start": starts})
    return out.withColumns({"period_end": F.last_day("period_start"), "acquired": F.date_add("period_start", F.col("days"))})


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of scenes from 1995 on: bands, quality flags, sensor and place."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"], "left")
    names = F.array(*[F.lit(s) for s in SENSORS_OF_SUPPLIER])
    return rows.select(
        # unique in the test tables, whose orders repeat line numbers
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 64 + F.col("l_quantity").cast("long")).alias("pixel_id"),
        (F.col("l_orderkey") % 64).alias("tile_id"),
        F.get(names, (F.col("l_suppkey") % 6).cast("int")).alias("sensor"),
        F.to_date("l_shipdate").alias("acquired"),
        (F.col("l_quantity") / 50.0).alias("B4"),
        (F.col("l_discount") * 4.0).alias("B3"),
        (F.col("l_tax") * 4.0).alias("B2"),
        (F.col("l_extendedprice") / 105000.0).alias("B8"),
        F.when(F.col("l_partkey") % 9 != 0, F.col("p_size") / 50.0).alias("B11"),
        F.when(F.col("l_partkey") % 7 != 0, (51 - F.col("p_size")) / 60.0).alias("B12"),
        (F.col("l_partkey") % 512).cast("int").alias("qa"),
        (F.col("l_suppkey") % 12).cast("int").alias("scl"),
    )


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (chip, grp, row, col, value) of 8 x 8 chips."""
    e = read(spark, sf_dir, "embeddings")
    pixels = e.select(F.col("vec_id").alias("chip"), F.col("label").alias("grp"), F.posexplode("embedding").alias("p", "v"))
    return pixels.select(
        "chip", "grp", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).cast("int").alias("col"), (F.col("v").cast("double") + 0.5).alias("value")
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes of varied place and size, two of them on the date line."""
    c = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    lon = F.when(k % 50 == 0, 179.5).otherwise((k * 37 % 3590) / 10.0 - 180.0)
    lat = (k * 53 % 1200) / 10.0 - 60.0
    return c.select(
        k.alias("area_id"), lon.alias("lon_min"), lat.alias("lat_min"), (lon + 0.05 + (k % 7) / 10.0).alias("lon_max"), (lat + 0.05 + (k % 5) / 10.0).alias("lat_max")
    )


# The same views for the oracle.
SQL = {
    "v_scene": """
v_scene AS (
  SELECT event_id AS scene_id, user_id AS tile_id,
         CASE event_type WHEN 'view' THEN 'SENTINEL_2' WHEN 'click' THEN 'LANDSAT_8' WHEN 'purchase' THEN 'LANDSAT_9'
                         WHEN 'signup' THEN 'MODIS_TERRA' ELSE 'VIIRS' END AS sensor,
         CASE WHEN event_id % 37 <> 0 THEN json_extract_string(props, '$.k')::DOUBLE END AS cloud_pct,
         CASE WHEN event_id % 41 <> 0 THEN value % 90.0 END AS sun_zenith,
         CASE WHEN event_id % 43 <> 0 THEN (event_id % 300) / 10.0::DOUBLE END AS view_zenith,
         CASE WHEN event_id % 11 <> 0 THEN (event_id % 97 + 3) / 100.0::DOUBLE END AS mask_mean,
         ts::DATE AS acquired, (ts::DATE - DATE '2024-01-01')::INTEGER AS days
  FROM events)""",
    "v_fleet": f"""
v_fleet AS (
  SELECT * REPLACE (CASE WHEN scene_id % 10 = 3 AND tile_id % {len(MONTHS)} < {ANY_SENSOR_MONTHS} THEN {[s[0] for s in SENSORS]}[scene_id // 10 % {len(SENSORS)} + 1] ELSE turns[scene_id % len(turns) + 1] END AS sensor, period_start + days AS acquired),
         last_day(period_start) AS period_end
  FROM (SELECT *, {[m for m, _ in MONTHS]}[tile_id % {len(MONTHS)} + 1]::DATE AS period_start, {[names for _, names in MONTHS]}[tile_id % {len(MONTHS)} + 1] AS turns FROM v_scene))""",
    "v_acq": """
v_acq AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 64 + l_quantity::BIGINT AS pixel_id, l_orderkey % 64 AS tile_id,
         ['LANDSAT_5', 'LANDSAT_7', 'SPOT_3', 'SPOT_4', 'MODIS_TERRA', 'ASTER'][l_suppkey % 6 + 1] AS sensor,
         l_shipdate::DATE AS acquired, l_quantity / 50.0::DOUBLE AS B4, l_discount * 4.0::DOUBLE AS B3, l_tax * 4.0::DOUBLE AS B2,
         l_extendedprice / 105000.0::DOUBLE AS B8,
         CASE WHEN l_partkey % 9 <> 0 THEN p_size / 50.0::DOUBLE END AS B11,
         CASE WHEN l_partkey % 7 <> 0 THEN (51 - p_size) / 60.0::DOUBLE END AS B12,
         (l_partkey % 512)::INTEGER AS qa, (l_suppkey % 12)::INTEGER AS scl
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)""",
    "v_chip": """
v_chip AS (
  SELECT chip, grp, (p // 8)::INTEGER AS row, (p % 8)::INTEGER AS col, e[p + 1]::DOUBLE + 0.5 AS value
  FROM (SELECT vec_id AS chip, label AS grp, embedding AS e, unnest(range(0, 64)) AS p FROM embeddings))""",
    "v_area": """
v_area AS (
  SELECT s_suppkey AS area_id, lon AS lon_min, lat AS lat_min,
         lon + 0.05::DOUBLE + (s_suppkey % 7) / 10.0::DOUBLE AS lon_max, lat + 0.05::DOUBLE + (s_suppkey % 5) / 10.0::DOUBLE AS lat_max
  FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 50 = 0 THEN 179.5::DOUBLE ELSE (s_suppkey * 37 % 3590) / 10.0::DOUBLE - 180.0::DOUBLE END AS lon,
               (s_suppkey * 53 % 1200) / 10.0::DOUBLE - 60.0::DOUBLE AS lat FROM supplier))""",
}


def with_views(names: str, body: str) -> str:
    """An oracle query over the named views; ``body`` may go on with more of them."""
    return "WITH " + ",".join(SQL[n] for n in names.split()) + body
