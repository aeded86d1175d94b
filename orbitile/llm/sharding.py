"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ROWS_PER_BUCKET, beside, materialise, order_key, packed

#: Digits of the part of an order key that stands for doc_id, and of the row's own that split the bucket of a frequent id.
ID_DIGITS, ROW_DIGITS = 32, 3
#: Slices whose numbers one array holds, and whose starts one task adds up.
SLICES_PER_RUN = 65_536


def utf8_size(text: Column | str) -> Column:
    """Bytes of the text plus 16 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def ranked(rows: DataFrame, largest: int) -> DataFrame:
    """Add ``__r``, from 1 in the order of ``__key`` within each ``__s``, and ``__n``, the rows of ``__s``.

    Row numbers within buckets, which are ranges of the key of about ROWS_PER_BUCKET rows, plus counted offsets.  A
    bucket that one doc_id (or none) fills is split by the digits that the rest of the row gives.
    """
    digits = 1
    while largest > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    rows = rows.withColumn("__b", F.substring("__key", 1, digits))
    counts = materialise(rows.groupBy("__s", "__b").agg(F.count("*").alias("__c")))
    hot = counts.where(F.col("__c") > 4 * ROWS_PER_BUCKET).select("__s", "__b", F.lit(True).alias("__hot"))
    n_hot = hot.count()
    if n_hot:
        split = F.substring("__key", 1, ID_DIGITS + ROW_DIGITS)
        rows = rows.join(_small(hot, n_hot), ["__s", "__b"], "left")
        rows = rows.withColumn("__b", F.when(F.col("__hot"), split).otherwise(F.col("__b"))).drop("__hot")
        counts = materialise(rows.groupBy("__s", "__b").agg(F.count("*").alias("__c")))
    before = _before(Window.partitionBy("__s").orderBy("__b"))
    sums = {"__offset": F.coalesce(F.sum("__c").over(before), F.lit(0)), "__n": F.sum("__c").over(Window.partitionBy("__s"))}
    offsets = counts.withColumns(sums).drop("__c")
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__key")))
    rows = rows.join(_small(offsets, counts.count()), ["__s", "__b"])
    return rows.withColumn("__r", F.col("__r") + F.col("__offset")).drop("__b", "__offset", "__key")


def _div(a: str, b: str, by: str) -> str:
    """SQL for the whole part of ``a * b / by``, whose product may need more than 64 bits."""
    return f"(CAST({a} AS DECIMAL(19, 0)) * CAST({b} AS DECIMAL(19, 0)) div CAST({by} AS DECIMAL(19, 0)))"


def slice_starts(sources: DataFrame, slices: int) -> DataFrame:
    """(__slice, __start): rows before each slice that has any, from the counts ``n`` of the sources alone.

    A source gives one row for each slice that it has rows in, so the table never has more rows than were
    counted, and arrays and sums stay within runs of SLICES_PER_RUN slices.
    """
    places = F.least(F.col("n"), F.lit(slices))
    runs = sources.where("n > 0").select("n", places.alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), places - 1, F.lit(SLICES_PER_RUN).cast("long"))).alias("k"))
    each = F.explode(F.sequence("k", F.least(F.col("k") + SLICES_PER_RUN, F.col("m")) - 1))
    spots = runs.repartition(F.col("n"), F.col("k")).select("n", each.alias("k"))
    # a source of fewer rows than slices has at most one in each; of others, ranks r with (2r - 1) * slices < 2nj lie below slice j
    below, up_to = (f"((CAST(2 * n AS DECIMAL(19, 0)) * CAST({j} AS DECIMAL(19, 0)) + {slices - 1}) div {slices}) div 2" for j in ("k", "k + 1"))
    few = F.col("n") < slices
    at = F.when(few, F.expr(_div("2 * k + 1", str(slices), "2 * n"))).otherwise(F.col("k"))
    spots = spots.select(at.alias("__slice"), F.when(few, F.lit(1)).otherwise(F.expr(f"{up_to} - {below}")).cast("long").alias("c"))
    counts = materialise(spots.groupBy("__slice").agg(F.sum("c").alias("c")).withColumn("run", F.expr(f"__slice div {SLICES_PER_RUN}")))
    # one row for each run of slices, so that this window is short
    of_runs = counts.groupBy("run").agg(F.sum("c").alias("c")).select("run", F.coalesce(F.sum("c").over(_before(Window.orderBy("run"))), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("c").over(_before(Window.partitionBy("run").orderBy("__slice"))), F.lit(0))
    return counts.withColumn("inside", inside).join(F.broadcast(of_runs), "run").select("__slice", (F.col("first") + F.col("inside")).alias("__start"))


def _before(order: Window) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, -1)


def interleave(docs: DataFrame, n_shards: int = 40, *, seed: int = 7) -> DataFrame:
    """Add shard and slot so that every shard matches the mixture of sources.

    Rows are ranked within their source in the order of a seeded hash of doc_id, then of a hash of the
    whole row; row r of n stands at (r - 1/2) / n of the whole, and the order by that fraction is cut
    into ``n_shards`` runs whose row counts differ by one at most.

    No step sorts a source or the table in one task: ranks come from row numbers within hash
    buckets plus counted offsets, and the global order from row numbers within slices of the
    fraction, whose offsets follow from the source counts alone.  Buckets and slices grow in number
    with the rows and not in length.  Only rows that are equal in every column cannot be told apart and
    meet in one task.

    Null sources form a source of their own, ordered last.  Repeated rows take neighbouring
    ranks.  With fewer rows than shards some shards stay empty; an empty table gives none.
    Columns of ``docs`` named shard and slot are replaced, all others stay as they are.
    """
    # null sources sort behind all others
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    rows = packed(docs, source.alias("__s"), order_key(docs, seed).alias("__key"))
    sources = materialise(rows.groupBy("__s").agg(F.count("*").alias("n")))
    total, largest = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    slices = max(1, -(-total // ROWS_PER_BUCKET))
    starts = slice_starts(sources, slices)

    rows = ranked(rows, largest)
    rows = rows.withColumns({"__slice": F.expr(_div("2 * __r - 1", str(slices), "2 * __n")), "__at": F.expr("(2 * __r - 1) / (2 * __n)")})
    in_slice = Window.partitionBy("__slice").orderBy("__at", "__s", "__r")
    rows = rows.withColumn("__p", F.row_number().over(in_slice) - 1)
    rows = rows.join(_small(starts, slices), "__slice")
    rows = rows.withColumn("__p", F.col("__p") + F.col("__start"))
    rows = rows.withColumn("shard", F.expr(f"__p * {n_shards} div {total or 1}").cast("int"))
    first = F.expr(f"(CAST(shard AS LONG) * {total} + {n_shards - 1}) div {n_shards}")
    return beside(docs, rows.withColumn("slot", (F.col("__p") - first).cast("long")), "shard", "slot")
