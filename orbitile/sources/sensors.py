"""The sensor catalog: operational lifetimes, native resolution and family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# First and last operational day, native resolution in metres, family.
SENSORS = [
    ("LANDSAT_4", "1982-07-16", "1993-12-14", 30.0, "LANDSAT"),
    ("LANDSAT_5", "1984-03-01", "2013-05-30", 30.0, "LANDSAT"),
    ("LANDSAT_7", "1999-04-15", None, 30.0, "LANDSAT"),
    ("LANDSAT_7_SLC_FAILURE", "2003-05-31", None, 30.0, "EVENT"),
    ("LANDSAT_8", "2013-02-11", None, 30.0, "LANDSAT"),
    ("LANDSAT_9", "2021-09-27", None, 30.0, "LANDSAT"),
    ("SENTINEL_2", "2015-06-23", None, 10.0, "SENTINEL"),
    ("MODIS_TERRA", "2000-02-24", None, 250.0, "MODIS"),
    ("MODIS_AQUA", "2002-07-04", None, 250.0, "MODIS"),
    ("ASTER", "2000-03-01", "2008-04-01", 15.0, "ASTER"),
    ("VIIRS", "2011-10-28", None, 375.0, "VIIRS"),
    ("SPOT_1", "1986-02-22", "2003-05-31", 20.0, "SPOT"),
    ("SPOT_2", "1990-01-22", "2009-07-31", 20.0, "SPOT"),
    ("SPOT_3", "1993-09-26", "1997-11-14", 20.0, "SPOT"),
    ("SPOT_4", "1998-03-24", "2013-07-31", 20.0, "SPOT"),
    ("LANDSAT_1_MSS", "1972-07-23", "1978-01-06", 60.0, "MSS"),
    ("LANDSAT_2_MSS", "1975-01-22", "1982-02-25", 60.0, "MSS"),
    ("LANDSAT_3_MSS", "1978-03-05", "1983-03-31", 60.0, "MSS"),
    ("NOAA_AVHRR", "1978-06-01", None, 1000.0, "AVHRR"),
]
OPEN_END = "9999-12-31"


def sensor_catalog(spark: SparkSession) -> DataFrame:
    """name, start, end (null: still flying), native_res, family; 19 rows."""
    rows = spark.createDataFrame(SENSORS, "name string, start string, end string, native_res double, family string")
    return rows.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})


def operational(requests: DataFrame, sensors: DataFrame, *, start: str = "req_start", end: str = "req_end", sensor: str = "sensor") -> DataFrame:
    """Add ``operational``: whether the request's days meet the sensor's lifetime.

    An open-ended lifetime has no last day; a name that the catalog lacks counts as
    operational.  The catalog is a constant of 19 rows and is broadcast.
    """
    life = F.broadcast(sensors.select(F.col("name").alias("__name"), F.col("start").alias("__s"), F.coalesce("end", F.lit(OPEN_END).cast("date")).alias("__e")))
    joined = requests.join(life, requests[sensor] == life["__name"], "left")
    overlaps = (F.col(start) <= F.col("__e")) & (F.col(end) >= F.col("__s"))
    return joined.withColumn("operational", F.coalesce(overlaps, F.lit(True))).drop("__name", "__s", "__e")


def families_available(requests: DataFrame, sensors: DataFrame) -> DataFrame:
    """For each request (req_id, req_start, req_end) and family: is any of its sensors operational?"""
    lives = F.broadcast(sensors.where("family <> 'EVENT'"))
    alive = (F.col("req_start") <= F.coalesce("end", F.lit(OPEN_END).cast("date"))) & (F.col("req_end") >= F.col("start"))
    return requests.join(lives).groupBy("req_id", "family").agg(F.max(alive).alias("available"))
