"""Progress over completion events (group, completed_at in seconds, tile seconds), in ranges of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.operators.ordered import RANGE, carried, placed, rolling


def _placed(events: DataFrame, key: str, rows_per_range: int, *, once: bool = True) -> DataFrame:
    return placed(events, key, "completed_at", "event_id", rows_per_range=rows_per_range, once=once)


def rolling_mean(events: DataFrame, n: int = 20, *, kept: int = 100, key: str = "grp", rows_per_range: int = RANGE) -> DataFrame:
    """Mean time of the last n tiles at each completion, the number of the last ``kept`` there are, and of all done."""
    rows = _placed(events, key, rows_per_range)
    out = rolling(rows, key, n, {"rolling": lambda w: F.avg("seconds").over(w)}, rows_per_range=rows_per_range)
    return out.withColumns({"done": F.col("place") + 1, "kept": F.least(F.col("place") + 1, F.lit(kept))}).select(*events.columns, "rolling", "kept", "done")


def remaining_seconds(events: DataFrame, total: int, *, key: str = "grp", last: int = 30, rows_per_range: int = RANGE) -> DataFrame:
    """Estimated time left from the throughput of the last completions, or the overall mean where that is undefined."""
    rows = _placed(events, key, rows_per_range)
    out = rolling(rows, key, last, {"__first": lambda w: F.first("completed_at").over(w), "__n": lambda w: F.count("*").over(w)}, rows_per_range=rows_per_range)
    starts = events.groupBy(F.col(key).alias("__key")).agg(F.min("completed_at").alias("__start"))
    out = out.join(starts, F.col(key).eqNullSafe(F.col("__key"))).withColumn("done", F.col("place") + 1)
    per_recent = F.try_divide(F.col("completed_at") - F.col("__first"), F.col("__n") - 1)
    overall = (F.col("completed_at") - F.col("__start")) / F.col("done")
    per_tile = F.when(per_recent > 0, per_recent).otherwise(overall)
    left = F.greatest(F.lit(0), F.lit(total) - F.col("done"))
    return out.withColumn("remaining", left * per_tile).select(*events.columns, "done", "remaining")


def time_statistics(events: DataFrame, *, key: str = "grp") -> DataFrame:
    """Mean, least and greatest tile time, and tiles an hour."""
    span = F.max("completed_at") - F.min("completed_at")
    return events.groupBy(key).agg(
        F.avg("seconds").alias("mean"), F.min("seconds").alias("low"), F.max("seconds").alias("high"), F.count("*").alias("n"), (3600.0 * F.count("*") / F.when(span > 0, span)).alias("per_hour")
    )


def stalled_runs(values: DataFrame, *, key: str = "grp", threshold: float, rows_per_range: int = RANGE) -> DataFrame:
    """Length of the current run of steps that change by less than the threshold: the places since the last larger step."""
    rows = _placed(values, key, rows_per_range)
    rows = rolling(rows, key, 2, {"__before": lambda w: F.first("seconds").over(w)}, rows_per_range=rows_per_range)
    flat = (F.col("place") > 0) & F.coalesce(F.abs(F.col("seconds") - F.col("__before")) < threshold, F.lit(False))
    out = carried(rows.withColumn("__flat", flat), key, {"__step": (F.when(~F.col("__flat"), F.col("place")), "max")})
    return out.withColumn("stalled", F.col("place") - F.col("__step")).select(*values.columns, "stalled")


def merged_pauses(pauses: DataFrame, *, key: str = "grp", rows_per_range: int = RANGE) -> DataFrame:
    """Pauses (key, paused_at, resumed_at) that overlap or touch, as one each; those that never end before they begin are dropped."""
    rows = pauses.where("resumed_at > paused_at").select(key, "paused_at", "resumed_at")
    rows = placed(rows, key, "paused_at", "resumed_at", rows_per_range=rows_per_range)
    rows = carried(rows, key, {"__until": (F.col("resumed_at"), "max")}, before=True)
    begins = F.coalesce(F.col("paused_at") > F.col("__until"), F.lit(True))
    rows = carried(rows, key, {"__begun": (F.when(begins, F.col("place")), "max")})
    return rows.groupBy(key, "__begun").agg(F.min("paused_at").alias("paused_at"), F.max("resumed_at").alias("resumed_at")).drop("__begun")


def without_pauses(events: DataFrame, pauses: DataFrame, *, key: str = "grp", rows_per_range: int = RANGE) -> DataFrame:
    """Add ``paused``, the seconds of pauses before each completion, and set ``completed_at`` back by them.

    What is measured on the result (rates, time left) is free of pauses.  A completion in a pause counts its
    part so far.  Pauses and completions are put in one order and summed in ranges.
    """
    whole = merged_pauses(pauses, key=key, rows_per_range=rows_per_range)
    names = [c for c in events.columns if c != key]
    row = F.struct(*[F.col(c) for c in names])
    union = events.select(key, F.col("completed_at").alias("__when"), F.lit(1).alias("__kind"), row.alias("__row"), F.lit(None).cast("double").alias("__len"), F.lit(None).cast("double").alias("__to"))
    of_pause = (F.col("resumed_at") - F.col("paused_at")).cast("double"), F.col("resumed_at").cast("double")
    union = union.unionByName(whole.select(key, F.col("paused_at").alias("__when"), F.lit(0).alias("__kind"), F.lit(None).cast(events.select(row.alias("r")).schema["r"].dataType).alias("__row"), of_pause[0].alias("__len"), of_pause[1].alias("__to")))
    ordered = placed(union, key, "__when", "__kind", rows_per_range=rows_per_range)
    out = carried(ordered, key, {"__sum": (F.col("__len"), "sum"), "__until": (F.col("__to"), "max")}).where("__kind = 1")
    rest = F.greatest(F.lit(0.0), F.coalesce(F.col("__until") - F.col("__when"), F.lit(0.0)))
    out = out.select(key, "__row.*", (F.coalesce("__sum", F.lit(0.0)) - rest).alias("paused"))
    return out.withColumn("completed_at", F.col("completed_at") - F.col("paused")).select(*events.columns, "paused")


def clock(seconds: Column, *, hours: bool = False) -> Column:
    """HH:MM:SS from an hour on (or always), else MM:SS; --:--:-- for unknown or negative."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    long = F.format_string("%02d:%02d:%02d", h, m, r)
    known = long if hours else F.when(s >= 3600, long).otherwise(F.format_string("%02d:%02d", m, r))
    return F.when(seconds.isNull() | (seconds < 0), "--:--:--").otherwise(known)


def duration_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%.0f seconds", seconds))
        .when(seconds < 3600, F.format_string("%.1f minutes", seconds / 60.0))
        .otherwise(F.format_string("%.1f hours", seconds / 3600.0))
    )


def progress_share(done: Column, total: Column, month: Column, months: Column) -> Column:
    """Mean of the shares of tiles and of months, in percent."""
    return (F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0)) + F.coalesce(F.try_divide(month * 100.0, months), F.lit(0.0))) / 2.0


def worker_change(cpu: Column, memory: Column, queued: Column, *, server: bool = False) -> Column:
    """One worker more while there is room and work, one less under pressure."""
    # fixed values: percent limits
    up_cpu, up_mem, down_cpu, down_mem = (98, 95, 98, 97) if server else (90, 95, 95, 95)
    return F.when((cpu > down_cpu) | (memory > down_mem), -1).when((cpu < up_cpu) & (memory < up_mem) & (queued > 0), 1).otherwise(0)
