"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Only DataFrame functions.  The row-level work is scans, plus a window over the rows of one
hash bucket per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS_PER_BUCKET, WORD, beside, join_per_key, materialise, order_key, packed, placed, unpacked

#: Digits of the order key, and digits that each histogram adds while it narrows down the edge of a fractional epoch.
KEY_DIGITS, DIGITS = 48, 3


def word_count(text: Column | str) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Add ``target`` to a table (source, source_size, weight).

    The targets share the total size by weight.  No target passes ``max_epochs`` times its source;
    the excess is shared again by weight among the sources that are not clamped, until the level
    clamps no more: each round is one aggregation over the sources, and clamps one source or more.
    An empty source has target 0.
    """
    rows = sources.withColumn("__cap", (F.col("source_size") * max_epochs).cast("double"))
    weights, clamped = F.sum("weight"), 0
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    free_weight, capped = rows.agg(weights).first()[0] or 0, 0.0
    while True:
        level = (total - capped) / free_weight if free_weight else 0.0
        is_over = F.col("weight") * F.lit(level) >= F.col("__cap")
        n, over, free = rows.agg(F.count_if(is_over), F.sum(F.when(is_over, F.col("__cap"))), F.sum(F.when(~is_over, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, capped, free_weight = n, over or 0.0, free
    target = F.when(is_over, F.col("__cap")).otherwise(F.col("weight") * F.lit(level))
    return rows.withColumn("target", target).drop("__cap")


def _cuts(keyed: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """(source, cut, missing): the bucket of keys in which a source's rest ends, and what of the rest lies inside.

    A histogram over the next digits of the key finds the bucket; while one holds more than
    ROWS_PER_BUCKET rows, a histogram of its rows goes on with more digits.  Without a row a
    source takes its rest whole.
    """
    cuts, digits = plan.select("source", F.lit("").alias("cut"), F.col("rest").alias("missing")), 0
    while True:
        digits += DIGITS
        inside = join_per_key(keyed, cuts, "source", n_sources).where(F.col("key").startswith(F.col("cut")))
        counts = inside.groupBy("source", "missing", F.substring("key", 1, digits).alias("cut")).agg(F.sum("size").alias("sum"), F.count("*").alias("rows"))
        upto = F.sum("sum").over(Window.partitionBy("source").orderBy("cut"))
        counts = counts.withColumn("before", upto - F.col("sum"))
        found = counts.where((F.col("before") <= F.col("missing")) & (F.col("before") + F.col("sum") > F.col("missing")))
        cuts = materialise(found.select("source", "cut", (F.col("missing") - F.col("before")).alias("missing"), "rows"))
        most = cuts.agg(F.max("rows")).first()[0] or 0
        cuts = cuts.drop("rows")
        if most <= ROWS_PER_BUCKET or digits >= KEY_DIGITS:
            return cuts


def mix(docs: DataFrame, size: Column, *, max_epochs: int = 3, seed: int = 9, split_last: bool = True) -> DataFrame:
    """Add size, source_size, target, taken and copies to every row of ``docs``.

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on; ``water_fill``
    sets their targets.  A source is taken whole as often as its target holds it; the rest of
    the target is taken once more from its rows in the order of a seeded hash of doc_id, then of
    a hash of the row.
    The row on the edge gives just the words still missing (``split_last``), or else is taken
    whole if that comes nearer.  ``copies`` counts whole takes only; ``taken`` counts words.

    Only the rows of the bucket that holds the edge, a few thousand a source, are ranked; rows
    that are equal in every column cannot be told apart and are ranked in one task if the edge is
    among them.  A row without text has size 0 and is repeated like its source.  Repeated rows tie:
    the same number of them is taken in every run.  An empty table gives an empty one.
    Columns of ``docs`` with the names added here are replaced, all others stay as they are.
    """
    key = order_key(docs, seed)
    keyed = materialise(docs.select(F.col("source").cast("string").alias("source"), key.alias("key"), size.alias("size")))
    sources = placed(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    sources = materialise(sources.select("source", "source_size", (F.col("__place") % 3 + 1).alias("weight")))
    n_sources = sources.count()
    size_of = F.col("source_size")
    plan = (
        water_fill(sources, max_epochs)
        .withColumn("whole", F.when(size_of > 0, F.floor(F.col("target") / size_of)).otherwise(0).cast("int"))
        .withColumn("rest", F.round(F.col("target") - F.col("whole") * size_of).cast("long"))
    )
    plan = materialise(plan.drop("weight"))
    cuts = _cuts(keyed, plan, n_sources)
    # a source without a cut takes every row once more: "g" lies behind all digits
    plan = join_per_key(plan, cuts, "source", n_sources).withColumns({"cut": F.coalesce("cut", F.lit("g")), "missing": F.coalesce("missing", F.lit(0))})
    plan = materialise(plan)

    rows = packed(docs, F.col("source").cast("string").alias("source"), key.alias("key"), size.alias("size"))
    planned = join_per_key(rows, plan, "source", n_sources)
    off_cut = planned.where(~F.col("key").startswith(F.col("cut")))
    off_cut = off_cut.withColumn("extra", F.when(F.col("key") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    on_cut = planned.where(F.col("key").startswith(F.col("cut")))
    in_order = Window.partitionBy("source").orderBy("key")
    on_cut = on_cut.withColumn("start", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    room = F.col("missing") - F.col("start")
    if split_last:
        extra = F.greatest(F.lit(0), F.least(F.col("size"), room))
    else:
        extra = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    on_cut = on_cut.withColumn("extra", extra).drop("start")
    on_edge = F.col("key").startswith(F.col("cut"))
    takes_more = F.when(on_edge, (F.col("extra") >= F.col("size")) & (F.col("extra") > 0)).otherwise(F.col("key") < F.col("cut"))
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    both = off_cut.unionByName(on_cut).withColumns({"taken": taken, "copies": F.col("whole") + F.when(takes_more, 1).otherwise(0)})
    return beside(docs, both, "size", "source_size", "target", "taken", "copies")


def mixed_corpus(docs: DataFrame, *, max_epochs: int = 3, seed: int = 9) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken whole, with its columns as they were."""
    rows = mix(packed(docs, "doc_id", "source"), word_count(F.col("__doc.text")), max_epochs=max_epochs, seed=seed, split_last=False)
    rows = rows.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpacked(rows)
