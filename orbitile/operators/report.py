"""Report aggregates over tile results: status, coverage, dominance, quality, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPLETE = "ok"
PARTIAL_BELOW = 0.95


def tile_outcomes(tiles: DataFrame) -> DataFrame:
    """complete, partial (complete with little coverage) or failed, by status and coverage."""
    ok = F.col("status") == COMPLETE
    outcome = F.when(ok & (F.col("coverage") < PARTIAL_BELOW), "partial").when(ok, "complete").otherwise("failed")
    return tiles.withColumn("outcome", outcome)


def summary(tiles: DataFrame) -> DataFrame:
    """One row: counts, success rate, mean coverage and fill rate, all 0 for no tiles."""
    t = tile_outcomes(tiles)
    out = t.agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") != "failed").alias("processed"), F.count_if(F.col("outcome") == "partial").alias("partial"),
        F.count_if(F.col("outcome") == "failed").alias("failed"), F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("mean_coverage"),
        F.coalesce(F.sum("gaps_identified"), F.lit(0)).alias("gaps_identified"), F.coalesce(F.sum("gaps_filled"), F.lit(0)).alias("gaps_filled"),
    )
    return out.withColumns(
        {
            "success_rate": F.coalesce(F.try_divide(F.col("processed") * 100.0, F.col("total")), F.lit(0.0)),
            "fill_rate": F.coalesce(F.try_divide(F.col("gaps_filled") * 100.0, F.col("gaps_identified")), F.lit(0.0)),
        }
    )


def dominance(tiles: DataFrame) -> DataFrame:
    """Tiles and percent of all by dominant sensor."""
    counted = tiles.where(F.col("dominant").isNotNull()).groupBy("dominant").agg(F.count("*").alias("tiles"))
    return counted.withColumn("percent", F.col("tiles") * 100.0 / F.sum("tiles").over(Window.partitionBy()))


def best_per_sensor(results: DataFrame) -> DataFrame:
    """Count and best scene of each sensor; of equal scores the first scene."""
    best = F.max_by(F.struct("scene_id", "score", "cloud"), F.struct("score", -F.col("scene_id")))
    return results.groupBy("sensor").agg(F.count("*").alias("n"), best.alias("b")).select("sensor", "n", "b.*")


def quality_statistics(results: DataFrame) -> DataFrame:
    return results.agg(F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("score").alias("n"))


def coverage_buckets(tiles: DataFrame) -> DataFrame:
    c = F.col("coverage")
    return tiles.agg(
        F.count_if(c >= 0.99).alias("excellent"), F.count_if((c >= 0.95) & (c < 0.99)).alias("good"), F.count_if((c >= 0.8) & (c < 0.95)).alias("fair"), F.count_if(c < 0.8).alias("poor"),
        F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"),
    )


def failures(tiles: DataFrame) -> DataFrame:
    """Failed tiles by status."""
    return tiles.where(F.col("status") != COMPLETE).groupBy("status").agg(F.count("*").alias("n"))


def status_table(tiles: DataFrame) -> DataFrame:
    """One line a tile: status, coverage in percent or N/A, dominant sensor or N/A, images used."""
    percent = F.when(F.coalesce("coverage", F.lit(0.0)) > 0, F.format_string("%.1f%%", F.floor(F.col("coverage") * 1000 + 0.5) / 10.0)).otherwise("N/A")
    return tiles.select(
        "tile_id", "status", percent.alias("coverage"), F.coalesce("dominant", F.lit("N/A")).alias("dominant"), (F.coalesce("images_added", F.lit(0)) + 1).cast("long").alias("images_used")
    )


def first_messages(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first n failed tiles, as messages."""
    return rows.where(F.col("status") != COMPLETE).orderBy("tile_id").limit(n).select("tile_id", F.format_string("Tile %d: %s", "tile_id", "status").alias("message"))
