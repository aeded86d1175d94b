"""Windows over long groups, in ranges: no task sees more of a group than a range and what reaches into it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitile.sources.storage import numbered, stored

#: Rows of a range.
RANGE = 10_000


def placed(rows: DataFrame, key: str, *order: str, rows_per_range: int = RANGE, once: bool = False) -> DataFrame:
    """The rows with their ``place`` in their group from 0, the group's ``first_place`` over all, and their ``range``.

    They are stored, unless they are read ``once``.
    """
    out = numbered(rows, F.col(key), *[F.col(c) for c in order], name="place")
    starts = out.groupBy(F.col(key).alias("__key")).agg(F.min("place").alias("first_place"))
    out = out.join(starts, F.col(key).eqNullSafe(F.col("__key"))).drop("__key").withColumn("place", F.col("place") - F.col("first_place"))
    out = out.withColumn("range", F.floor(F.col("place") / rows_per_range))
    return out if once else stored(out, "placed")


def rolling(rows: DataFrame, key: str, n: int, columns: dict[str, Callable[[Window], Column]], *, rows_per_range: int = RANGE) -> DataFrame:
    """Columns over each row and the n - 1 before it: the last rows of a range stand in the next one too.

    ``rows`` are placed; n is at most the length of a range.
    """
    if n > rows_per_range:
        raise ValueError("a window reaches into the range before only")
    inside = F.col("place") % rows_per_range
    again = F.when(inside >= rows_per_range - n + 1, F.col("range") + 1)
    both = rows.withColumn("__in", F.explode(F.array_compact(F.array(F.col("range"), again))))
    window = Window.partitionBy(key, "__in").orderBy("place").rowsBetween(1 - n, 0)
    return both.withColumns({name: make(window) for name, make in columns.items()}).where(F.col("__in") == F.col("range")).drop("__in")


def carried(rows: DataFrame, key: str, columns: dict[str, tuple[Column, str]], *, before: bool = False) -> DataFrame:
    """Running sums and maxima over all rows of a group up to each, or only those before it.

    Ranges are summed each for itself and get what the ranges before come to; ``rows`` are placed.
    """
    kinds = {"sum": F.sum, "max": F.max}
    named = rows.withColumns({f"__{name}": column for name, (column, _) in columns.items()})
    whole = named.groupBy(F.col(key).alias("__key"), F.col("range").alias("__range")).agg(*[kinds[kind](f"__{name}").alias(f"__of_{name}") for name, (_, kind) in columns.items()])
    earlier = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    whole = whole.select("__key", "__range", *[kinds[kind](f"__of_{name}").over(earlier).alias(f"__of_{name}") for name, (_, kind) in columns.items()])
    here = Window.partitionBy(key, "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = named.withColumns({f"__{name}": kinds[kind](f"__{name}").over(here) for name, (_, kind) in columns.items()})
    out = out.join(whole, F.col(key).eqNullSafe(F.col("__key")) & (F.col("range") == F.col("__range")))

    def both(name: str, kind: str) -> Column:
        a, b = F.col(f"__{name}"), F.col(f"__of_{name}")
        return F.greatest(a, b) if kind == "max" else F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

    return out.select(*rows.columns, *[both(name, kind).alias(name) for name, (_, kind) in columns.items()])
