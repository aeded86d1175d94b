"""Helpers shared by the corpus operators: reading, shared storage, size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word for the counting operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Per-key tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Rows of a hash bucket, which one task ranks.
ROWS_PER_BUCKET = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may run without that setting; it then gets a temporary folder, removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orbitile-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/orbitile-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None, *, by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder (or a path in it) and read it back.

    Rows of each value of ``by``, if given, are kept apart, so that readers of one don't meet the others.
    The result survives lost executors and is not computed twice.  Shuffle files of the
    write are dropped at once where this Spark version can do so.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/t"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that nothing reads any more: what came of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/orbitile-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows, stored, with ``__place``: their number from 0 in an order over all of them.

    Ranges of the order are numbered each for itself, from the counts of the ranges before: no
    task sees more than its range, and the driver gets nothing.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialise(ranged)
    part, inside = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    # one row for each partition, so that this window is as short as the list of tasks
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = ranged.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return numbered.withColumn("__place", F.col("__before") + inside).drop("__at", "__part", "__before")


def seeded_hash(seed: int, *cols: Column | str) -> Column:
    """32 hex digits that depend on the seed and the columns (null reads as empty)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def tie_of(rows: DataFrame) -> Column:
    """A hash of the whole row, to order rows with equal keys.

    Rows that still tie are alike, so a task that runs again after a lost executor gives the
    same rows in any order of them.  Maps can't be hashed and count as JSON.
    """

    def hashable(field) -> Column:
        col = F.col(f"`{field.name}`")
        return F.to_json(F.struct(col)) if "map<" in field.dataType.simpleString() else col

    return F.xxhash64(*[hashable(f) for f in rows.schema.fields])


def order_key(rows: DataFrame, seed: int) -> Column:
    """A text to sort by: 32 digits that follow from the seed and doc_id, then 16 from the whole row."""
    return F.concat(seeded_hash(seed, "doc_id"), F.lpad(F.lower(F.hex(tie_of(rows))), 16, "0"))


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (-1)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % folds, F.lit(-1)).cast("int")


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, n_keys: int) -> DataFrame:
    """Left join a table of one row per key to ``rows``, null keys included.

    Broadcast only while the counted number of keys is small; beyond that a shuffled
    join, where adaptive execution splits a hot key.
    """
    right = per_key.withColumnRenamed(key, "__key")
    right = F.broadcast(right) if n_keys <= BROADCAST_ROWS else right
    return rows.join(right, rows[key].eqNullSafe(right["__key"]), "left").drop("__key")


def labels_of(labels: DataFrame, column: str, fold: Column | None = None) -> DataFrame:
    """All labelled ids (doc_id, label), each once.

    Rows with a null id or label are left out; of contradicting labels the larger one holds.
    """
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (F.lit(True) if fold is None else fold))
    return kept.groupBy("doc_id").agg(F.max(column).alias("label"))


def label_sample(labels: DataFrame, column: str, fold: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids (doc_id, label), chosen by a seeded hash of the id.

    The bound makes the result safe to broadcast.
    """
    return labels_of(labels, column, fold).orderBy(seeded_hash(17, "doc_id"), "doc_id").limit(bound)


def packed(docs: DataFrame, *needed: str | Column) -> DataFrame:
    """The rows as one column ``__doc`` beside what an operator reads of them.

    What the operator adds then clashes with no column of the rows; ``unpacked`` gives them back.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), *needed)


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("__doc.*")


def beside(docs: DataFrame, rows: DataFrame, *added: str) -> DataFrame:
    """The columns of ``docs`` out of packed ``rows``, whatever their names, then the added ones, which replace any of their name."""
    own = [F.col("__doc").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return rows.select(*own, *added)
