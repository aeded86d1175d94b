"""The month pipeline: test and select scenes by the rules of their sensors, fill gaps, compose, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitile.functions.indices import mosaic_indices
from orbitile.functions.scoring import tests_before_lowering
from orbitile.operators import gapfill, mosaic, status
from orbitile.operators import selection as sel
from orbitile.sources.storage import small_side, stored


def select_for_month(tested: DataFrame) -> dict[str, DataFrame]:
    """First set and gap-fill sequence of every tile from scored tests with their rules and the count ``n``.

    The three small tables that later steps use several times are stored.
    """
    tested = stored(tested, "tested")
    selected = sel.accepted_by_rules(tested, tests_before_lowering(F.col("n")))
    chosen = stored(sel.phase_one(selected), "chosen")
    sequence = stored(gapfill.add_sequence(gapfill.gap_candidates(tested, chosen)), "sequence")
    return {"tested": tested, "chosen": chosen, "sequence": sequence}


def compose_month(tiles: DataFrame, pixels: DataFrame, chosen: DataFrame, sequence: DataFrame) -> dict[str, DataFrame]:
    """Mosaic with indices and results of the requested tiles, from pixels (tile_id, scene_id, row, col, bands).

    Pixels are cut to the chosen and added scenes, read once and shuffled once: added scenes rank
    behind the chosen ones in the order of their steps, so the best value of a cell's band and the
    step from which the cell has one come from the same aggregation.  Where filling stops follows
    from those steps, and then takes later values away again.  ``tiles`` may have megabytes and error.
    """
    steps = chosen.select("tile_id", "scene_id", F.lit(0).alias("step"), F.col("score").alias("quality"))
    added = sequence.select("tile_id", "scene_id", "step", (-F.col("step")).cast("double").alias("quality"))
    used = pixels.join(small_side(stored(steps.unionByName(added), "steps")), ["tile_id", "scene_id"])
    cells = stored(mosaic.best_with_step(used), "cells")
    covered = stored(gapfill.coverage_from_cells(mosaic.steps_of(cells), sequence), "coverage")
    stops = stored(gapfill.stop_step(covered), "stops")
    image = mosaic_indices(mosaic.until_step(cells.join(small_side(stops), "tile_id")))
    stats = gapfill.gap_statistics(covered, stops).join(gapfill.gap_counts(sequence, stops), "tile_id")
    best = chosen.groupBy("tile_id").agg(F.count("*").alias("scenes"), F.min_by("sensor", "phase_rank").alias("dominant"))
    out = tiles.join(best, "tile_id", "left").join(stats, "tile_id", "left")
    given = [F.col(c) if c in tiles.columns else F.lit(None).cast(t) for c, t in (("megabytes", "double"), ("error", "string"))]
    reason = status.tile_status(F.col("scenes"), F.lit("B4,B3,B2"), F.coalesce(given[0], F.lit(0.0)), F.col("final_coverage"), given[1])
    names = ("images_added", "gaps_identified", "gaps_filled")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names]
    tiles = out.select("tile_id", reason.alias("status"), F.coalesce("final_coverage", F.lit(0.0)).alias("coverage"), "dominant", *counts)
    return {"mosaic": image, "coverage": covered, "tiles": tiles}
