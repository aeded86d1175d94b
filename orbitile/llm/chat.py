"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are rendered.

A log often holds a conversation again after every turn.  Rolling hashes of the turns so far
find every conversation that begins a longer one; anti-joins on the hashes keep the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Sums of 40-bit hashes stay exact for conversations of up to eight million turns.
HASH_SPAN = 1 << 40
#: Rendered around a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
UNKNOWN = "unknown"


def _role():
    return F.coalesce("role", F.lit(UNKNOWN))


def _text():
    return F.coalesce("text", F.lit(""))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, a, b, last): two running hashes of the first k turns, and whether k is all of them.

    Each turn's hash is mixed with its place, so that a running sum depends on the order.
    Only hashes are shuffled.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.xxhash64(_role(), _text()).alias("h"), F.xxhash64(F.lit(4), _text(), _role()).alias("g"))
    rows = rows.distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "h", "g")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("k", F.row_number().over(order))
    a, b = (F.sum(F.pmod(F.xxhash64(F.col("k"), F.col(c)), F.lit(HASH_SPAN))).over(so_far) for c in ("h", "g"))
    rows = rows.select("conv_id", "k", a.alias("a"), b.alias("b"), (F.lead("k").over(order).isNull()).alias("last"))
    return rows


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that begin no longer one.

    Equal conversations count as copies of the one with the smallest id.  They are grouped,
    and prefixes made distinct, before the anti-join: so however many conversations share
    their first turns, each side has one row a hash.
    """
    p = materialise(prefixes(turns))
    key = ["k", "a", "b"]
    whole = p.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = p.where("not last").select(*key).distinct()
    kept = whole.join(begun, key, "left_anti")
    return kept.select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations with ``rendered``: their turns in order, in chat markup.

    A conversation is one record, so its turns meet in one row; nothing larger does.
    """
    rows = turns.select("conv_id", F.struct("turn", _role().alias("role"), _text().alias("text")).alias("t")).join(kept.select("conv_id"), "conv_id", "left_semi")
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list("t"))).alias("turns"))
    one = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE)))
    return kept.join(listed.select("conv_id", F.array_join(one, "").alias("rendered")), "conv_id")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered of every maximal conversation.

    Turns are ordered by ``turn`` (null first), then content; a turn logged again with the
    same number and content counts once.  A null role reads ``unknown``, a null text is empty,
    and rows without conv_id belong to no conversation.  Other columns are ignored.  An empty
    table gives an empty one.
    """
    kept = materialise(maximal(turns))
    return render(turns, kept)
