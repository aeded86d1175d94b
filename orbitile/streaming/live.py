"""Streaming forms: watched folders, running counts, throughput state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from orbitile.functions import text

#: How long the name of a file that was taken is remembered.
KEPT_NAMES = "7 days"


def watch_boxes(spark: SparkSession, folder: str, pattern: str = "{geometry_*,bbox_*}") -> DataFrame:
    """Boxes of the files that appear in a folder; each name once, for as long as the watermark on its time of change keeps it."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    named = files.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified"), text.geometry_box(F.col("value")).alias("box"))
    return named.withWatermark("modified", KEPT_NAMES).dropDuplicatesWithinWatermark(["file_name"])


def scene_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).parquet(folder)


def running_usage(scenes: DataFrame) -> DataFrame:
    """Count and best score of each sensor so far, for update or complete mode."""
    return scenes.groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


def monthly_usage(scenes: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Scenes a sensor and fixed window of 30 days of event time; rows later than the watermark are dropped."""
    return scenes.withWatermark("ts", late).groupBy(F.window("ts", "30 days"), "sensor").agg(F.count("*").alias("n"))


STATE = "done long, recent array<double>"
OUTPUT = "grp long, done long, remaining double, span double"


def throughput(events: DataFrame, total: int, last: int = 30) -> DataFrame:
    """Time left of each group after every batch, from the last completions kept in its state.

    The state holds the ``last`` latest times, in whatever order batches bring them; ``span`` is the time between
    the first and the last of them (null without any).  Completions without a time count as done.  No time is
    left once ``total`` is reached.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, recent = state.get if state.exists else (0, [])
        for f in frames:
            done, recent = done + len(f), sorted([*recent, *f["completed_at"].dropna()])[-last:]
        state.update((done, recent))
        span = recent[-1] - recent[0] if recent else None
        per_tile = span / (len(recent) - 1) if span else 0.0
        yield pd.DataFrame({"grp": [key[0]], "done": [done], "remaining": [max(0, total - done) * per_tile], "span": [span]})

    return events.groupBy("grp").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, folder: str, *, keys: list[str] | None = None) -> DataFrame:
    """The final table of a stream that runs until its source is used up, written batch by batch below ``folder``.

    A batch that runs again replaces its own part.  In complete mode the last part is the table; in update
    mode each key's row of the last part that has it; in append mode all parts.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    running = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)  # the source had nothing, so there was no batch
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        return out.where(F.col("batch") == F.lit(last)).drop("batch")
    if mode == "update":
        rest = F.struct(*[c for c in stream.columns if c not in keys])
        return out.groupBy(*keys).agg(F.max_by(rest, "batch").alias("r")).select(*keys, "r.*")
    return out.drop("batch")
