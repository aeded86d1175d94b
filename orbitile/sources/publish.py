"""Outputs that readers see whole or not at all: staged, checked, and published by one marker."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MARKER = "CURRENT.json"


def _path(spark: SparkSession, path: str):
    """A path and the file system it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def sums(table: DataFrame) -> list:
    """Number of rows, and a checksum of them that no order changes."""
    total = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in table.columns]).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit(0)).cast("string").alias("checksum")]


def stage(spark: SparkSession, outputs: dict[str, DataFrame], root: str) -> tuple[str, dict]:
    """Write the outputs to a version that no reader sees yet; returns its name and what was counted while writing."""
    version, counted = f"v-{uuid.uuid4().hex}", {}
    for name, df in outputs.items():
        seen = Observation(f"{version}-{name}")
        df.observe(seen, *sums(df)).write.parquet(f"{root}/{version}/{name}")
        counted[name] = dict(seen.get)
    return version, counted


def validate(spark: SparkSession, root: str, version: str, counted: dict) -> None:
    """Read a staged version back; if rows or checksums differ it is removed and an error says what."""
    for name, want in counted.items():
        table = spark.read.parquet(f"{root}/{version}/{name}")
        found = table.agg(*sums(table)).first().asDict()
        if found != want:
            remove(spark, f"{root}/{version}")
            raise ValueError(f"{name} was not written whole: {found} instead of {want}")


def switch(spark: SparkSession, root: str, version: str, counted: dict) -> None:
    """Point readers to a version, in one step."""
    text = json.dumps({"version": version, "outputs": [{"name": n, **c} for n, c in sorted(counted.items())]})
    new, fs = _path(spark, f"{root}/.{version}.json")
    out = fs.create(new, True)
    out.writeBytes(text)
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(new, _path(spark, f"{root}/{MARKER}")[0], over)


def publish(spark: SparkSession, outputs: dict[str, DataFrame], root: str, *, intermediates: tuple[str, ...] = ()) -> str:
    """Stage, validate and switch; only then the folders of intermediates go, and the versions before.

    A run that stops between the steps leaves what readers saw before, and its intermediates; the next one
    starts over and clears what is left.
    """
    version, counted = stage(spark, outputs, root)
    validate(spark, root, version, counted)
    switch(spark, root, version, counted)
    for path in intermediates:
        remove(spark, path)
    clear(spark, root)
    return version


def clear(spark: SparkSession, root: str) -> None:
    """Remove all versions but the published one."""
    here, fs = _path(spark, root)
    current = current_version(spark, root)
    for status in fs.listStatus(here) if fs.exists(here) else []:
        name = status.getPath().getName()
        if name.startswith(("v-", ".v-")) and name != current:
            fs.delete(status.getPath(), True)


def current_version(spark: SparkSession, root: str) -> str | None:
    marker, fs = _path(spark, f"{root}/{MARKER}")
    return spark.read.json(f"{root}/{MARKER}").first()["version"] if fs.exists(marker) else None


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A published output, as the marker has it now."""
    version = current_version(spark, root)
    if version is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{version}/{name}")
