"""Folders for intermediate tables and streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a stored table that may be broadcast.
BROADCAST_ROWS = 50_000


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orbitile-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a work folder and read back: computed once, kept when executors are lost."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(table: DataFrame) -> DataFrame:
    """A stored table as the small side of a join: broadcast if its counted rows are few, else left to a shuffled join."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows, stored, with their number from 1 in an order over all of them.

    Ranges of the order are numbered each for itself, and the counts of the ranges before are added:
    no task sees more than its range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranged").withColumns({"__part": F.shiftrightunsigned("__at", 33), "__in": F.col("__at").bitwiseAND((1 << 33) - 1)})
    # one row for each partition, so that this window is as short as the list of tasks
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = ranged.join(F.broadcast(sizes), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__in") + 1).drop("__at", "__part", "__in", "__before")
