"""Spelling variants of a corpus: words one edit apart, grouped under the word they vary.

One insertion, deletion or replacement leaves one half of the shorter word intact, so two such words
share their first half or their last half.  A forward dictionary (words in order) and a reversed one
(mirrored words in order) are range-partitioned and sorted; words with a common half are one run of rows
in one of them, and a scan verifies the pairs of a run.  Runs that are too long are first subdivided by
the halves of what the words do not share yet, again and again; every pair belongs to exactly one run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialise

#: A run of letters; of these only A-Z are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Words as the dictionary takes them: code points and occurrences at least.
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs this many times as often as its variant, at least.
RATIO = 5
#: Words of a run from which it is subdivided; rows of a tile of pairs; rows of the dictionaries that one task scans.
RUN_ROWS, TILE, ROWS_PER_TASK = 512, 256, 100_000
#: Of the runs of letters, every such one (by its hash) loses a code point, so that a clean corpus has variants.
DAMAGE = 199


def runs(text: Column) -> Column:
    """The runs of letters of a text, A-Z lower-cased; none for a null text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))


def damaged(run: Column, doc_id: Column, every: int = DAMAGE) -> Column:
    """The run, without one code point where ``every`` divides the hash of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def count_words(docs: DataFrame, *, damage: int | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all whole texts (doc_id, text) that are long and frequent enough.

    Counts combine before the shuffle.  Null texts and an empty table have no words; a null id reads as empty.
    """
    each = docs.select(F.col("doc_id"), F.explode(runs(F.col("text"))).alias("run"))
    word = F.col("run") if damage is None else damaged(F.col("run"), F.col("doc_id"), damage)
    long_enough = each.select(word.alias("word")).where(F.char_length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


#: A run of the dictionaries: length of its shorter words, code points they share at the front and at the back,
#: the common prefix from which a pair belongs to another run, and what they share.
RUN = ["length", "front", "back", "below", "shared"]


def _run(word: Column, length: Column, front: Column, back: Column, below: Column) -> list[Column]:
    """The run of a word; what is shared at the back is mirrored, so that both dictionaries sort by their words."""
    shared = F.concat(F.substring(word, F.lit(1), front), F.lit("|"), F.reverse(F.substring(word, F.char_length(word) - back + 1, back)))
    return [c.alias(name) for c, name in zip((length, front, back, below, shared), RUN, strict=True)]


def dictionaries(words: DataFrame) -> DataFrame:
    """Every word in the runs of its halves, as the longer and as the shorter of a pair: four rows a word."""
    m = F.char_length("word")
    sized = words.select("word", "n", F.explode(F.array(m, m - 1)).alias("length"))
    half = F.floor(F.col("length") / 2).cast("int")
    none, never = F.lit(0), F.lit(1 << 30)
    forward = sized.select("word", "n", *_run(F.col("word"), F.col("length"), half, none, never))
    mirrored = sized.select("word", "n", *_run(F.col("word"), F.col("length"), none, F.col("length") - half, half))
    return forward.unionByName(mirrored)


def subdivided(members: DataFrame) -> DataFrame:
    """The rows of long runs, each in the two runs of the halves of what is not shared yet."""
    c = F.col
    rest = c("length") - c("front") - c("back")
    half = F.floor(rest / 2).cast("int")
    forward = members.select("word", "n", *_run(c("word"), c("length"), c("front") + half, c("back"), c("below")))
    mirrored = members.select("word", "n", *_run(c("word"), c("length"), c("front"), c("back") + rest - half, c("front") + half))
    return forward.unionByName(mirrored)


def split_long_runs(members: DataFrame, run_rows: int = RUN_ROWS) -> tuple[DataFrame, int]:
    """Rows, and their number, of runs with two words at least, and with at most ``run_rows`` where more than one code point is not shared.

    Each round halves what is not shared, so there are at most as many as the logarithm of the longest word;
    a run that differs in one code point only has a word for each letter of the alphabet, or each two.
    """
    done, total = [], 0
    while True:
        sizes = members.groupBy(*RUN).agg(F.count("*").alias("rows")).where("rows > 1")
        sizes = materialise(sizes)
        can = F.col("length") - F.col("front") - F.col("back") > 1
        is_long = (F.col("rows") > run_rows) & can
        n_long, n, rows = sizes.agg(F.count_if(is_long), F.count("*"), F.coalesce(F.sum(F.when(~is_long, F.col("rows"))), F.lit(0))).first()
        total += rows

        def of(some: DataFrame, count: int, members: DataFrame = members) -> DataFrame:
            right = some.select(*RUN)
            return members.join(F.broadcast(right) if count <= BROADCAST_ROWS else right, RUN, "left_semi")

        if not n_long:
            done.append(of(sizes, n))
            break
        done.append(of(sizes.where(~is_long), n))
        members = materialise(subdivided(of(sizes.where(is_long), n_long)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, total


def _matrix(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    return out


def near_in_run(words: list[str], length: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of the words of a run that are one edit apart and share a prefix shorter than ``below``.

    Pairs are two words of the run's length, or one of them and a longer one.
    """
    sizes = np.array([len(w) for w in words])
    ahead, back = _matrix(words, length + 1), _matrix([w[::-1] for w in words], length + 1)
    left, right = [], []
    for start in range(0, len(words), TILE):
        i, j = np.meshgrid(np.arange(start, min(start + TILE, len(words))), np.arange(start, len(words)), indexing="ij")
        pairs = (i < j) & ((sizes[i] == length) | (sizes[j] == length))
        i, j = i[pairs], j[pairs]
        prefix = np.logical_and.accumulate(ahead[i] == ahead[j], axis=1).sum(1)
        suffix = np.logical_and.accumulate(back[i] == back[j], axis=1).sum(1)
        near = (prefix + suffix >= length - (sizes[i] == sizes[j])) & (prefix < below)
        left.append(i[near])
        right.append(j[near])
    return np.concatenate(left), np.concatenate(right)


NEAR = "word string, near string, near_n long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs, in both directions, of the runs of a sorted range of a dictionary."""
    held_of, words, counts = None, [], []
    out: tuple[list, list, list] = ([], [], [])

    def verify() -> None:
        if len(words) > 1:
            for i, j in zip(*(a.tolist() for a in near_in_run(words, held_of[0], held_of[3])), strict=True):
                for a, b in ((i, j), (j, i)):
                    out[0].append(words[a])
                    out[1].append(words[b])
                    out[2].append(counts[b])

    for batch in batches:
        columns = [batch[c].to_pylist() for c in (*RUN, "word", "n")]
        for *of, word, n in zip(*columns, strict=True):
            if of != held_of:
                verify()
                held_of, words, counts = of, [], []
            words.append(word)
            counts.append(n)
        if len(out[0]) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
            out = ([], [], [])
    verify()
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])


def near_words(words: DataFrame, *, run_rows: int = RUN_ROWS) -> DataFrame:
    """(word, near, near_n): every two words (word, n) that differ by exactly one edit, in both directions, once."""
    members, rows = split_long_runs(dictionaries(words), run_rows)
    # equal runs go to one range, in which they are one run of rows; ranges are as many as the rows ask for
    dealt = members.repartitionByRange(max(1, -(-rows // ROWS_PER_TASK)), *RUN).sortWithinPartitions(*RUN, "word")
    return dealt.mapInArrow(_scan, NEAR)


def group_variants(words: DataFrame, *, ratio: int = RATIO, run_rows: int = RUN_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a dictionary (word, n), whose words are distinct.

    The form is the near word that occurs most (ties: the first in code-point order) if it occurs ``ratio``
    times as often at least, else null.  Forms grow by that factor, so a chain of them has at most the
    logarithm of the largest count; it is followed by pointer doubling.  Words of fewer than two code points
    have no half and no near words.  An empty dictionary gives no rows.
    """
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words.where(F.char_length("word") >= 2), run_rows=run_rows)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    has = -F.col("best.rank") >= ratio * F.col("n")
    found = materialise(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.rank")).alias("form_n"))
    )
    largest = found.agg(F.max("form_n")).first()[0] or 0
    chain = int(math.log(largest, ratio)) + 1 if largest else 0
    to = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(chain)) if chain > 1 else 0):
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        doubled = materialise(to.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        if k:
            discard(to)
        to = doubled
    out = found.join(to, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
