"""Scene selection: candidates, adaptive thresholds in closed form, fallbacks, ranking.

All operators window over one partitioning, (tile, sensor) or tile, so a chain of them costs
one shuffle for each of the two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitile.functions.scoring import EXCELLENT

# Threshold ladders, in percent of cloud and in quality.
CLOUD_LEVELS = [20, 30, 40, 50, 60, 80]
CLOUD_LEVELS_L4 = [25, 40, 50, 60, 80]
CLOUD_LEVELS_STEPS = [20, 30, 40, 50, 60, 70, 80]
QUALITY_LEVELS = [0.9, 0.7, 0.5, 0.3, 0.1, 0.0]
QUALITY_LEVELS_STEPS = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]
MAX_SCENES = 5
ENOUGH = 3

# Fixed values, by family: cloud ladder; whether the percentage of the metadata is tested beside the estimated fraction;
# quality ladder, of which a single level is a floor; scenes tested, also in server mode; accepted scenes that end the
# tests, and whether only excellent ones count; whether a rejected scene may stand in; whether clouds order the tests.
RULES = [
    ("SENTINEL", CLOUD_LEVELS, True, QUALITY_LEVELS, 5, 10, 3, True, True, True),
    ("LANDSAT", CLOUD_LEVELS, True, QUALITY_LEVELS, 5, 10, 3, True, True, True),
    ("SPOT", CLOUD_LEVELS_STEPS, False, QUALITY_LEVELS_STEPS, 5, 10, 3, False, True, False),
    ("MSS", CLOUD_LEVELS_STEPS, False, QUALITY_LEVELS_STEPS, 5, 10, 3, False, True, True),
    ("MODIS", [20], False, [0.2], 5, 10, 3, True, False, False),
    ("ASTER", [20], False, [0.0], 5, 5, 3, True, False, False),
    ("VIIRS", [20], False, [0.0], 5, 5, 3, True, False, False),
    ("AVHRR", [80], False, [0.0], 5, 5, 1, False, False, False),
]
RULE_COLUMNS = "family string, cloud_levels array<double>, reads_metadata boolean, quality_levels array<double>, tests int, server_tests int, enough int, excellent_only boolean, stands_in boolean, by_cloud boolean"
LAST_RESORT = "AVHRR"
L4_ALONE_BEFORE = "1984-03-01"

GROUP = ("tile_id", "sensor")


def sensor_rules(sensors: DataFrame) -> DataFrame:
    """The rules of every sensor of the catalog, by its family; a constant of a few rows."""
    rows = [(f, [float(x) for x in clouds], meta, [float(x) for x in quality], *rest) for f, clouds, meta, quality, *rest in RULES]
    rules = sensors.sparkSession.createDataFrame(rows, RULE_COLUMNS)
    return sensors.select(F.col("name").alias("sensor"), "family", "native_res").join(F.broadcast(rules), "family")


def with_rules(scenes: DataFrame, rules: DataFrame, *, server: bool = False) -> DataFrame:
    """Scenes (with ``period_start``) and the rules of their sensors; those of other sensors have no rules and are left out.

    The oldest mapper alone, before its successor flew, starts at its own cloud levels.
    """
    out = scenes.join(F.broadcast(rules), "sensor")
    alone = (F.col("sensor") == "LANDSAT_4") & (F.col("period_start") < F.lit(L4_ALONE_BEFORE).cast("date"))
    levels = F.when(alone, F.array(*[F.lit(float(x)) for x in CLOUD_LEVELS_L4])).otherwise(F.col("cloud_levels"))
    return out.withColumns({"cloud_levels": levels, "tests": F.col("server_tests") if server else F.col("tests")}).drop("server_tests")


def group_counts(scenes: DataFrame) -> DataFrame:
    """(tile, sensor, n), and for each tile whether the two neighbours of the sensor adjustments are present."""
    counts = scenes.groupBy(*GROUP).agg(F.count("*").alias("n"))
    tile = Window.partitionBy("tile_id")  # over the counted rows: a tile has a few sensors
    return counts.withColumns({"with_l4": F.max(F.col("sensor") == "LANDSAT_4").over(tile), "with_l5": F.max(F.col("sensor") == "LANDSAT_5").over(tile)})


def tests_by_rules(scenes: DataFrame, rules: DataFrame, *, server: bool = False) -> DataFrame:
    """The scenes that each sensor's rule tests, in order ``t``, with the counts of their groups.

    Rules, order and number of tests need metadata alone: scenes are cut to the tested ones before the
    shuffle, and scores are due for those only.
    """
    ruled = with_rules(scenes, rules, server=server)
    most = max(r[5 if server else 4] for r in RULES)
    order = [F.when(F.col("by_cloud"), F.col("cloud_pct")).asc_nulls_last(), F.when(~F.col("by_cloud"), F.col("acquired")), F.col("scene_id")]
    tested = ruled.withColumn("t", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order))).where((F.col("t") <= most) & (F.col("t") <= F.col("tests")))
    return tested.join(group_counts(scenes), list(GROUP))


def accepted_by_rules(tested: DataFrame, patience: Column) -> DataFrame:
    """Selected rows of scored tests: each family by its ladders, its stop and its fallback, and the coarsest only where a tile has nothing else."""
    pct = F.when(F.col("reads_metadata"), F.col("cloud_pct"))
    judged = quality_ladder(cloud_ladder(tested, patience, F.col("cloud_levels"), pct=pct), patience, F.col("quality_levels"))
    stopped = stop_after_excellent(judged, F.col("enough"), excellent=~F.col("excellent_only") | (F.col("score") >= EXCELLENT))
    cloudiness = F.coalesce(pct, F.col("cloud") * 100)
    selected = with_fallback(stopped, cloudiness=cloudiness, allowed=F.col("stands_in"))
    # a window over the few rows of a tile tells whether a better sensor has any
    others = F.max(F.col("family") != LAST_RESORT).over(Window.partitionBy("tile_id"))
    return selected.withColumn("__o", others).where((F.col("family") != LAST_RESORT) | ~F.col("__o")).drop("__o")


def top_candidates(scenes: DataFrame, n: int = MAX_SCENES, *, keys: Sequence[str] = GROUP) -> DataFrame:
    """The n least cloudy scenes of each group, with their test number ``t``.

    Unknown cloud comes last, equal ones in order of scene_id.  The row number filter lets
    Spark cut each partition to n rows a group before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("cloud_pct").asc_nulls_last(), "scene_id")
    return scenes.withColumn("t", F.row_number().over(order)).where(F.col("t") <= n)


def _levels(levels: Sequence[float] | Column) -> Column:
    return levels if isinstance(levels, Column) else F.array(*[F.lit(float(x)) for x in levels])


def _level(levels: Column, index: Column) -> Column:
    return F.get(levels, F.least(index, F.size(levels) - 1))


def cloud_ladder(
    candidates: DataFrame, patience: Column, levels: Sequence[float] | Column = CLOUD_LEVELS, *, keys: Sequence[str] = GROUP, pct: Column | None = None
) -> DataFrame:
    """Add ``arrives`` and ``passes`` for the adaptive cloud threshold.

    Candidates are tested in order of t.  While none has passed, the threshold on the known
    percentage rises a level with each test from number ``patience`` on, and the threshold on
    the estimated fraction (``cloud``) with each one that gets that far; afterwards both stay.
    In closed form the first level follows from t, the second from a running count, and the
    levels of the first pass hold for all later rows.  An unknown percentage always arrives.
    The levels may be a column, one array for all rows of a group; a single level is a fixed cut.
    """
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    levels = _levels(levels)
    last = F.size(levels) - 1
    pct = F.col("cloud_pct") if pct is None else pct
    out = candidates.withColumn("__m", patience)
    out = out.withColumn("__l", F.least(F.greatest(F.lit(0), F.col("t") - F.col("__m") + 1), last))
    out = out.withColumn("__a", pct.isNull() | (pct <= _level(levels, F.col("__l"))))
    counted = F.sum(F.when(F.col("__a") & (F.col("t") >= F.col("__m")), 1).otherwise(0)).over(so_far)
    out = out.withColumn("__f", F.least(counted, last).cast("int"))
    fits = F.col("__a") & (F.round(F.col("cloud") * 100, 9) <= _level(levels, F.col("__f")))
    out = out.withColumn("__first", F.min(F.when(fits, F.struct("t", "__l", "__f"))).over(group))
    arrives = pct.isNull() | (pct <= _level(levels, F.col("__first.__l")))
    later = F.col("t") > F.col("__first.t")
    out = out.withColumn("arrives", F.when(later, arrives).otherwise(F.col("__a")))
    passes = (F.col("t") >= F.col("__first.t")) & F.col("arrives") & (F.round(F.col("cloud") * 100, 9) <= _level(levels, F.col("__first.__f")))
    return out.withColumn("passes", F.coalesce(passes, F.lit(False))).drop("__m", "__l", "__a", "__f", "__first")


def quality_ladder(scored: DataFrame, patience: Column, levels: Sequence[float] | Column = QUALITY_LEVELS, *, keys: Sequence[str] = GROUP) -> DataFrame:
    """Add ``accepted`` for the adaptive quality threshold over the rows that ``passes`` holds for.

    The threshold falls a level with each scored row from test ``patience`` on while none is
    accepted, then stays; at the lowest level every score will do.
    """
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    levels = _levels(levels)
    out = scored.withColumn("__m", patience)
    counted = F.sum(F.when(F.col("passes") & (F.col("t") >= F.col("__m")), 1).otherwise(0)).over(so_far)
    out = out.withColumn("__q", F.least(counted, F.size(levels) - 1).cast("int"))
    fits = F.col("passes") & (F.round("score", 9) >= _level(levels, F.col("__q")))
    out = out.withColumn("__first", F.min(F.when(fits, F.struct("t", "__q"))).over(group))
    accepted = F.col("passes") & (F.col("t") >= F.col("__first.t")) & (F.round("score", 9) >= _level(levels, F.col("__first.__q")))
    return out.withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("__m", "__q", "__first")


def stop_after_excellent(rows: DataFrame, n: int | Column = ENOUGH, *, keys: Sequence[str] = GROUP, excellent: Column | None = None) -> DataFrame:
    """Keep accepted rows until n excellent ones (or others that ``excellent`` names) have been seen, the n-th included."""
    before = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    excellent = F.col("score") >= EXCELLENT if excellent is None else excellent
    seen = F.coalesce(F.sum(F.when(F.col("accepted") & excellent, 1).otherwise(0)).over(before), F.lit(0))
    return rows.withColumn("accepted", F.col("accepted") & (seen < n))


def with_fallback(rows: DataFrame, *, keys: Sequence[str] = GROUP, cloudiness: Column | None = None, allowed: Column | None = None) -> DataFrame:
    """Accepted rows, or for a group without any, where ``allowed``, its best scored, else its least cloudy row; ``fallback`` marks those."""
    group = Window.partitionBy(*keys)
    cloudiness = F.col("cloud_pct") if cloudiness is None else cloudiness
    order = group.orderBy(
        F.col("accepted").desc(), F.col("passes").desc(), F.when(F.col("passes"), F.col("score")).desc_nulls_last(), cloudiness.asc_nulls_last(), "scene_id"
    )
    allowed = F.lit(True) if allowed is None else allowed
    out = rows.withColumns({"__any": F.max("accepted").over(group), "__r": F.row_number().over(order)})
    out = out.where(F.col("accepted") | (~F.col("__any") & (F.col("__r") == 1) & allowed))
    return out.withColumn("fallback", ~F.col("accepted")).drop("__any", "__r")


def phase_one(selected: DataFrame, *, per_sensor: int = 3, overall: int = 5) -> DataFrame:
    """First set of each tile: its best ``overall`` among the best ``per_sensor`` excellent rows of each sensor.

    A tile without excellent rows takes its best from all its rows.
    """
    by_score = [F.col("score").desc(), F.col("scene_id")]
    out = selected.withColumn("__e", F.col("score") >= EXCELLENT)
    out = out.withColumn("__s", F.row_number().over(Window.partitionBy("tile_id", "sensor", "__e").orderBy(*by_score)))
    out = out.withColumn("__any", F.max("__e").over(Window.partitionBy("tile_id")))
    out = out.where(~F.col("__any") | (F.col("__e") & (F.col("__s") <= per_sensor)))
    out = out.withColumn("phase_rank", F.row_number().over(Window.partitionBy("tile_id").orderBy(*by_score)))
    return out.where(F.col("phase_rank") <= overall).drop("__e", "__s", "__any")


def rank_results(rows: DataFrame) -> DataFrame:
    """Add ``score_rank`` within the tile, is_selected (rank 1) and fallback_rank (the others)."""
    order = Window.partitionBy("tile_id").orderBy(F.col("score").desc(), "scene_id")
    out = rows.withColumn("score_rank", F.row_number().over(order))
    return out.withColumns({"is_selected": F.col("score_rank") == 1, "fallback_rank": F.when(F.col("score_rank") > 1, F.col("score_rank"))})


def match_selected(results: DataFrame, selected: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """For each selected (tile, sensor, score) the first test result of that sensor with nearly that score."""
    right = selected.select("tile_id", "sensor", F.col("score").alias("__score"))
    near = results.join(right, ["tile_id", "sensor"]).where(F.abs(F.col("score") - F.col("__score")) < tolerance)
    return near.groupBy("tile_id", "sensor").agg(F.min_by(F.struct("t", "scene_id", "score"), "t").alias("m")).select("tile_id", "sensor", "m.*")
