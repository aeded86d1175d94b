"""Readers and writers: GeoJSON, project catalog, manifest, provenance, snapshots, pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitile.functions import text
from orbitile.sources.storage import numbered

MANIFEST = "year int, month int, mosaic string, pyramid string, tiles string, provenance string, timestamp string"
PROJECTS = (
    "projects array<struct<name: string, category: string, description: string, bbox: array<double>, dates: string, key_metrics: array<string>>>"
)


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, box) of imported files: four numbers, or a GeoJSON feature, collection or polygon.

    A file that is not UTF-8 is read as Latin-1.
    """
    files = spark.read.format("binaryFile").load(path)
    content = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.select("path", F.col("modificationTime").alias("modified"), text.geometry_box(content).alias("box"))


def newest(files: DataFrame) -> DataFrame:
    """The file changed last; of equal times the last path."""
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(1)


def read_projects(spark: SparkSession, path: str, *, one_per_file: bool = True) -> DataFrame:
    """Projects of catalog files, one row each, with their box as columns; a file is one JSON object, or has one a line."""
    rows = spark.read.schema(PROJECTS).json(path, multiLine=one_per_file).select(F.explode("projects").alias("p")).select("p.*")
    sides = {n: F.get("bbox", F.lit(k)) for k, n in enumerate(("lon_min", "lat_min", "lon_max", "lat_max"))}
    return rows.withColumns(sides)


def project_features(projects: DataFrame) -> DataFrame:
    """(file_name, feature) of each project: GeoJSON text under a safe name."""
    box = F.struct("lon_min", "lat_min", "lon_max", "lat_max")
    feature = text.feature_json(
        box, name=F.col("name"), category=F.col("category"), description=F.col("description"), dates=F.col("dates"), bbox=F.array_join(F.col("bbox").cast("array<string>"), ",")
    )
    return projects.select(F.concat(text.file_name(F.col("name")), F.lit(".geojson")).alias("file_name"), feature.alias("feature"))


def append_manifest(rows: DataFrame, path: str) -> None:
    """Append to the manifest, a folder of CSV parts with headers; it need not exist."""
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    rows.select(*names).write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).option("escape", '"').csv(path)


def missing_months(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    """Requested (year, month) that the manifest lacks: what a rerun has to do."""
    return requested.join(manifest.select("year", "month"), ["year", "month"], "left_anti")


def provenance(tiles: DataFrame, results: DataFrame) -> DataFrame:
    """(tile_id, provenance): a tile and its test results, best first, as one JSON text.

    The results of a tile are a bounded few dozen.
    """
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("key"), "scene_id", "sensor", F.round("score", 6).alias("score"))))
    kept = F.transform(listed, lambda r: F.struct(r["scene_id"].alias("scene_id"), r["sensor"].alias("sensor"), r["score"].alias("score")))
    tests = results.groupBy("tile_id").agg(kept.alias("tests"))
    joined = tiles.join(tests, "tile_id", "left")
    return joined.select("tile_id", F.to_json(F.struct(*[c for c in tiles.columns], "tests")).alias("provenance"))


def usage_snapshot(results: DataFrame) -> DataFrame:
    """One row: counts by sensor, distinct tiles and the latest best scenes, as JSON."""
    by = results.groupBy("sensor").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    entries = F.sort_array(F.collect_list(F.struct("sensor", "n", F.round("best", 6).alias("best"))))
    tiles = results.agg(F.lit(1).alias("one"), F.countDistinct("tile_id").alias("tiles"))
    sensors = by.agg(F.lit(1).alias("one"), entries.alias("sensors"))
    return sensors.join(tiles, "one").select(F.to_json(F.struct("tiles", "sensors")).alias("snapshot"))


def dashboard_lines(results: DataFrame) -> DataFrame:
    """Comma-separated lines of the results table: tile ascending (none first), score descending."""
    order = (F.coalesce("tile_id", F.lit(-1)), F.coalesce("score", F.lit(0.0)).desc(), F.col("scene_id"))
    line = F.concat_ws(",", F.col("tile_id").cast("string"), F.col("sensor"), F.format_string("%.4f", "score"))
    return numbered(results, *order).select("place", line.alias("line"))


def write_pixels(pixels: DataFrame, path: str, *, block: int = 512) -> None:
    """Pixels as Parquet by year and month, each file clustered by blocks of the grid."""
    out = pixels.withColumns({"block_row": F.floor(F.col("row") / block), "block_col": F.floor(F.col("col") / block)})
    out = out.repartition("year", "month", "block_row", "block_col").sortWithinPartitions("block_row", "block_col", "row", "col")
    out.write.mode("overwrite").partitionBy("year", "month").parquet(path)
