"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers.

Only DataFrame and SQL functions.  Positions come from the text between the matches, which
``split`` returns: a match starts after all gaps and matches before it.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, packed, seeded_hash

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_MIN, MARKOV = 12, 3

#: Tokens that the Markov models judge, and the mean log-likelihood ratio (nats a character) that marks a secret.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
THRESHOLD = 0.6
#: The models' alphabet; any other character counts as one more letter.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: Labelled samples: this many seeded random strings of each kind, and identifiers from at most this many documents.
RANDOM_STRINGS, IDENTIFIER_ROWS = 2_000, 2_000
#: Ordinary identifiers are shorter than any token that is judged, so that secrets don't train their own excuse.
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_]{3,14}(?![A-Za-z0-9+/_=-])"
SMOOTHING = 0.5
#: Matches of a text whose places are added up in one piece.
BLOCK = 512
SPAN = "array<struct<start: int, kind: int, end: int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, both: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """Each integer of an array that is not empty combined with all before it.

    ``both(element, earlier)`` gets null for ``earlier`` where there is none.  An array that grows by one
    element a step is copied each time, so it is grown in blocks of fixed size, and then the totals of
    the blocks: in effect linear in the array.
    """

    def grown(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda done, v: F.concat(done, F.array(both(v, F.get(done, F.size(done) - 1)))))

    def joined(blocks: Column) -> Column:
        totals = running(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)), both, levels - 1)
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda v: both(v, F.get(t, i - 1))))))

    def blocked(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x), F.lit(BLOCK))
        return let(F.transform(starts, lambda start: grown(F.slice(x, start, F.lit(BLOCK)))), joined)

    return let(values, blocked) if levels > 1 else grown(values)


def spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans (start, kind, end) of the matches of a pattern, in code points, end exclusive.

    ``keep``, if given, says for each match whether it counts.  The pattern runs over the text a fixed
    number of times: nothing inside a lambda reads the text, so the time follows its length.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.split(text, pattern, -1), found, lambda gap, match: F.length(gap) + F.length(match))
    ends = running(sizes, lambda v, earlier: v + F.coalesce(earlier, F.lit(0)))
    keep = F.transform(found, lambda _: F.lit(True)) if keep is None else keep
    # the gap after the last match has no match beside it, and so no flag either
    zipped = F.filter(F.arrays_zip(found.alias("match"), ends.alias("end"), keep.alias("keep")), lambda m: m["keep"])
    spans_of = F.transform(zipped, lambda m: F.struct((m["end"] - F.length(m["match"])).alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    return F.when(text.rlike(pattern), spans_of.cast(SPAN)).otherwise(F.array().cast(SPAN))


def clear_of(base: Column, found: Column, kind: int) -> Column:
    """All spans of ``base``, and those of ``found`` (of the given kind, which sorts last) that overlap none of them; in order."""

    def judged(merged: Column) -> Column:
        is_base = lambda s: s["kind"] != kind
        ends = running(F.transform(merged, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(running(F.transform(F.reverse(merged), lambda s: F.when(is_base(s), s["start"])), F.least))
        zipped = F.arrays_zip(merged.alias("s"), ends.alias("reached"), starts.alias("next"))
        clear = lambda z: (z["reached"] <= z["s"]["start"]) & (F.coalesce(z["next"], z["s"]["end"]) >= z["s"]["end"])
        return F.transform(F.filter(zipped, lambda z: is_base(z["s"]) | clear(z)), lambda z: z["s"])

    return F.when(F.size(found) == 0, base).otherwise(let(F.array_sort(F.concat(base, found)), judged))


def codes(token: Column) -> Column:
    """Numbers of a token's characters in the alphabet, 1 on; 0 for any other."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.position(c, F.lit(ALPHABET)))


def train(docs: DataFrame, *, rows: int = IDENTIFIER_ROWS, seed: int = 8) -> list[float]:
    """Log ratios of the transition probabilities, random over ordinary, as a flat table.

    Random strings are seeded digests in hexadecimal, base 64 and capital letters with digits;
    ordinary identifiers come from the ids with the smallest seeded hashes, one row of each.
    What reaches the driver is bounded by the square of the alphabet.
    """
    n = len(ALPHABET) + 1
    spark = docs.sparkSession
    ids = spark.range(RANDOM_STRINGS).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"))
    code = F.regexp_replace(F.base64(F.unhex("h")), "=+$", "")
    capital = F.concat(F.lit("AKIA"), F.upper(F.regexp_replace(F.base64(F.unhex(F.reverse("h"))), "[^A-Za-z0-9]", "")))
    random = ids.select(F.explode(F.array(F.col("h"), code, F.substring(capital, 1, 20), code)).alias("token"), F.lit(1).alias("random"))
    kept = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    kept = kept.orderBy(seeded_hash(seed, "doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("token"), F.lit(0).alias("random"))
    pairs = random.unionByName(words).withColumn("c", codes(F.col("token")))
    pairs = pairs.select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c")).alias("b"))).alias("p"))
    counted = pairs.groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).count().collect()
    table = {(r["random"], r["a"], r["b"]): r["count"] for r in counted}
    total = {(k, a): sum(table.get((k, a, b), 0) for b in range(n)) for k in (0, 1) for a in range(n)}

    def log_p(k: int, a: int, b: int) -> float:
        return math.log((table.get((k, a, b), 0) + SMOOTHING) / (total[k, a] + SMOOTHING * n))

    return [round(log_p(1, a, b) - log_p(0, a, b), 6) for a in range(n) for b in range(n)]


def scan(docs: DataFrame, ratios: list[float], *, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (start, kind number, end) to every row of ``docs``.

    Base spans are those of the fixed patterns; ``spans`` also has the tokens whose mean log
    ratio reaches the threshold and that overlap no base span.  Both are in order of start,
    then kind.  A null or empty text has none.  Columns of these names are replaced; rows,
    repeated ones included, stay as they are.
    """
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to a constant
    text = F.coalesce(F.col("text"), F.lit(""))
    long_values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_MIN)
    base = F.array_sort(F.concat(spans(text, ASSIGN, 0, long_values), spans(text, ACCESS, 1), spans(text, HEX, 2)))

    def mean(token: Column) -> Column:
        walked = F.aggregate(
            codes(token),
            F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda s, c: F.struct(
                c.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.get(table, s["last"] * n + c))).alias("sum")
            ),
        )
        return walked["sum"] / (F.length(token) - 1)

    secret = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: mean(t) >= threshold)
    rows = packed(docs, "text").select("__doc", base.alias("base_spans"), spans(text, TOKEN, MARKOV, secret).alias("found"))
    return beside(docs, rows.withColumn("spans", clear_of(F.col("base_spans"), F.col("found"), MARKOV)), "base_spans", "spans")


def joined(column: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(column, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", one)
