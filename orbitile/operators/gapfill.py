"""Gap filling as set operations: choose the scenes to add, then stop by coverage in one pass over pixels."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitile.functions.scoring import gap_fill_score

TARGET, STALL, STALLS = 0.999, 0.001, 3
MAX_ITERATIONS, LOW_QUALITY = 20, 0.1


def better(candidate: dict, best: dict) -> bool:
    """Whether a candidate replaces the best so far: finer resolution excuses a somewhat lower score."""
    gain = best["resolution"] - candidate["resolution"]
    s, t = candidate["score"], best["score"]
    # fixed values: score factors by resolution gain in metres
    if gain > 50:
        return s >= 0.90 * t
    if gain > 20:
        return s >= 0.95 * t
    if gain < -50:
        return s > 1.15 * t
    if gain < -20:
        return s > 1.10 * t
    return s > t


def pick(rows: list[dict], floor: float) -> dict | None:
    """Best candidate at or over a quality floor, in order of falling gap score."""
    best = None
    for r in rows:
        if r["score"] >= floor and (best is None or better(r, best)):
            best = r
    return best


def add_sequence(candidates: DataFrame, *, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """Order in which scenes are added to each tile: (tile_id, step, scene_id, low_quality).

    ``candidates`` has tile_id, scene_id, score, resolution and gap_score, a few dozen rows a
    tile.  In each iteration the floor falls from 0.5 by 0.05 to 0.2; without a candidate over
    it, one of at least 0.1 may do, except in the last five iterations.  The choice never
    depends on pixels, so it is one grouped fold.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["gap_score", "scene_id"], ascending=[False, True]).to_dict("records")
        out = []
        for k in range(max_iterations):
            found, low = pick(rows, max(0.2, 0.5 - 0.05 * k)), False
            if found is None and k < max_iterations - 5:
                found, low = pick(rows, LOW_QUALITY), True
            if found is not None:
                rows = [r for r in rows if r["scene_id"] != found["scene_id"]]
                out.append((found["tile_id"], len(out) + 1, found["scene_id"], low))
        return pd.DataFrame(out, columns=["tile_id", "step", "scene_id", "low_quality"])

    narrow = candidates.select("tile_id", "scene_id", "score", "resolution", "gap_score")
    return narrow.groupBy("tile_id").applyInPandas(run, "tile_id long, step int, scene_id long, low_quality boolean")


def gap_candidates(scenes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Scenes not chosen yet, with their gap score by the nearest chosen date of the tile.

    The dates of a tile's few chosen scenes travel as one small array.
    """
    dates = chosen.groupBy("tile_id").agg(F.collect_set("days").alias("__dates"))
    left = scenes.join(chosen.select("tile_id", "scene_id"), ["tile_id", "scene_id"], "left_anti").join(dates, "tile_id", "left")
    nearest = F.array_min(F.transform("__dates", lambda d: F.abs(d - F.col("days"))))
    left = left.withColumn("day_distance", F.coalesce(nearest, F.lit(999)))
    return left.withColumn("gap_score", gap_fill_score(F.col("resolution"), F.col("day_distance"), F.col("score"))).drop("__dates")


def coverage_by_step(pixels: DataFrame, sequence: DataFrame) -> DataFrame:
    """(tile_id, step, coverage) from one pass: each cell's first step with a value, then running counts.

    ``pixels`` (tile_id, scene_id, row, col, B4, B3, B2) of chosen scenes count as step 0 where
    the sequence lacks their scene.  Coverage is the mean over the three bands.
    """
    step = F.coalesce("step", F.lit(0))
    seen = pixels.join(sequence.select("tile_id", "scene_id", "step"), ["tile_id", "scene_id"], "left").withColumn("step", step)
    firsts = [F.min(F.when(F.col(b).isNotNull(), F.col("step"))).alias(b) for b in ("B4", "B3", "B2")]
    return coverage_from_cells(seen.groupBy("tile_id", "row", "col").agg(*firsts), sequence)


def coverage_from_cells(cells: DataFrame, sequence: DataFrame) -> DataFrame:
    """(tile_id, step, coverage) from the step with which each cell's visible bands have a value (null: never)."""
    counted = cells.select("tile_id", F.explode(F.array("B4", "B3", "B2")).alias("step")).groupBy("tile_id", "step").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("tile_id").agg(F.sum("n").alias("total"))
    steps = sequence.select("tile_id", "step").distinct().unionByName(sizes.select("tile_id", F.lit(0).alias("step")))
    joined = steps.join(counted, ["tile_id", "step"], "left").join(sizes, "tile_id")
    upto = Window.partitionBy("tile_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("tile_id", "step", (F.sum(F.coalesce("n", F.lit(0))).over(upto) / F.col("total")).alias("coverage"))


def stop_step(coverages: DataFrame) -> DataFrame:
    """(tile_id, last_step): the first step that reaches the target, or the third in a row that adds almost nothing, or the last."""
    order = Window.partitionBy("tile_id").orderBy("step")
    out = coverages.withColumn("__stalled", (F.col("coverage") - F.lag("coverage").over(order) < STALL).cast("int"))
    recent = [F.coalesce(F.lag("__stalled", k).over(order), F.lit(0)) for k in range(STALLS)]
    run = recent[0]
    for r in recent[1:]:
        run = run + r
    out = out.withColumn("__stop", (F.col("coverage") >= TARGET) | (run == STALLS))
    last = F.coalesce(F.min(F.when(F.col("__stop"), F.col("step"))), F.max("step"))
    return out.groupBy("tile_id").agg(last.cast("int").alias("last_step"), F.coalesce(F.max("__stop"), F.lit(False)).alias("stopped"))


def gap_counts(sequence: DataFrame, stops: DataFrame, *, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """(tile_id, gaps_identified, gaps_filled): scenes of good quality that were added, and one more where candidates ran out before the target."""
    added = sequence.join(stops, "tile_id").where((F.col("step") <= F.col("last_step")) & ~F.col("low_quality"))
    filled = added.groupBy("tile_id").agg(F.count("*").alias("gaps_filled"))
    out = stops.join(filled, "tile_id", "left").withColumn("gaps_filled", F.coalesce("gaps_filled", F.lit(0)))
    ran_out = ~F.col("stopped") & (F.col("last_step") < max_iterations)
    return out.select("tile_id", (F.col("gaps_filled") + ran_out.cast("int")).alias("gaps_identified"), "gaps_filled")


def gap_statistics(coverages: DataFrame, stops: DataFrame) -> DataFrame:
    """Coverage before and after, and the number of scenes added, by tile."""
    kept = coverages.join(stops, "tile_id").where(F.col("step") <= F.col("last_step"))
    out = kept.groupBy("tile_id").agg(
        F.min_by("coverage", "step").alias("initial_coverage"), F.max_by("coverage", "step").alias("final_coverage"), F.max("step").cast("int").alias("images_added")
    )
    return out.withColumn("coverage_improvement", F.col("final_coverage") - F.col("initial_coverage"))
