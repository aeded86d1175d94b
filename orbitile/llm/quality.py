"""Quality rules: counted rules, and a hashed n-gram log-likelihood ratio.

The ratio compares a multinomial over hashed byte n-grams of trusted rows with one of the
raw corpus.  Raw counts cover every document, trusted counts and the cut every labelled one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, discard, labels_of, materialise, packed
from .text import WordHasher, chunks, mix64, texts_of

#: Bytes in an n-gram, and bits of its hash.
GRAM, HASH_BITS = 4, 16
#: Added to every bucket's count, and steps of a unit of the log-likelihood ratio.
SMOOTHING, UNITS = 1.0, 1 << 20
#: Balanced accuracy that the cut gives up to spare good rows.
SLACK = 0.005
CHUNK = 1_000_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
BASE = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint>"


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in a row, one for each byte of a text, and where each text's grams end.

    The last grams of a text go on into line ends after it, never into the next text.
    """
    data = [t.encode("utf-8", "replace") for t in texts]
    b = np.frombuffer((b"\n" * GRAM).join(data) + b"\n" * GRAM, dtype=np.uint8).astype(np.uint32)
    code = np.zeros(len(b) - GRAM, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | b[k : len(b) - GRAM + k]
    sizes = np.array([len(d) for d in data])
    own = np.ones(len(code), bool)
    gaps = np.cumsum(sizes + GRAM)[:-1]  # where the line ends after a text stop
    for k in range(1, GRAM + 1):
        own[gaps - k] = False
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS))[own], np.cumsum(sizes)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, trusted = np.zeros(1 << HASH_BITS, np.int64), np.zeros(1 << HASH_BITS, np.int64)
    for b in batches:
        texts, label = texts_of(b["text"]), b["label"].to_pylist()
        for start, end in chunks(texts, CHUNK):
            buckets, ends = gram_buckets(texts[start:end])
            raw += np.bincount(buckets, minlength=len(raw))
            of_target = np.repeat(np.array([(x or 0) > 0 for x in label[start:end]]), np.diff(ends, prepend=0))
            trusted += np.bincount(buckets[of_target], minlength=len(raw))
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(trusted[used])], ["bucket", "raw", "trusted"])


@dataclass(frozen=True)
class Ratio:
    """Log-likelihood ratio of every bucket in units of 1 / UNITS, and the mean from which a text is kept.

    Whole numbers add up to the same sum in any order, so a mean depends on its text alone.
    """

    table: np.ndarray
    cut: float

    def means(self, texts: list[str]) -> np.ndarray:
        """Mean ratio over the n-grams of each text; 0 for an empty one."""
        out = np.zeros(len(texts))
        for start, end in chunks(texts, CHUNK):
            buckets, ends = gram_buckets(texts[start:end])
            total = np.concatenate([[0], np.cumsum(self.table[buckets])])
            first = np.concatenate([[0], ends[:-1]])
            out[start:end] = (total[ends] - total[first]) / (np.maximum(1, ends - first) * UNITS)
        return out


def cut_of(rows: DataFrame, share: float = 0.5, slack: float = 0.0) -> float:
    """``text.best_cut`` over all rows (value, positive), in any number.

    Values are counted, put in order in ranges and summed range by range: no task sees more than a
    range, and the driver gets a few numbers.
    """
    counted = rows.groupBy("value").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    ranged = materialise(counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    # one row for each range, so that this window is as short as the list of tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sizes = sizes.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("pos", "neg")])
    n_pos, n_neg, last = ranged.agg(F.sum("pos"), F.sum("neg"), F.max("value")).first()
    if last is None:
        discard(ranged)
        return 0.0
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    pos, neg = (F.col(f"{c}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("pos", "neg"))
    gains = materialise(ranged.join(F.broadcast(sizes), "part").select("value", (neg / max(1, n_neg) - pos / max(1, n_pos)).alias("gain")))
    best = max(gains.agg(F.max("gain")).first()[0], n_neg / max(1, n_neg) - n_pos / max(1, n_pos))
    high = gains.where(F.col("gain") >= best - slack).agg(F.min("value")).first()[0]
    low = last if high is None else gains.where(F.col("value") < high).agg(F.max("value")).first()[0]
    discard(ranged, gains)
    low, high = (high if low is None else low), (last if high is None else high)
    return low + share * (high - low)


def learn(docs: DataFrame, labels: DataFrame) -> Ratio:
    """Count both multinomials and set the cut by balanced accuracy, over all labelled rows.

    Texts are shuffled once, to meet their labels; beside their means, only ids are later.  The
    driver gets one row per bucket.  Without labelled rows the ratio is 0 and everything is kept.
    """
    docs, marked = docs.select("doc_id", "text"), labels_of(labels, "quality")
    # a table of labels by id in each task, so that no text is sorted
    rows = docs.join(marked.hint("shuffle_hash"), "doc_id", "left").select("text", "label")
    counted = rows.mapInArrow(_count, "bucket long, raw long, trusted long").groupBy("bucket")
    found = counted.agg(F.sum("raw"), F.sum("trusted")).collect()
    raw, trusted = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    for bucket, r, t in found:
        raw[bucket], trusted[bucket] = r, t
    if not trusted.any():
        return Ratio(np.zeros(len(raw), np.int64), 0.0)

    def logs(n: np.ndarray) -> np.ndarray:
        return np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * len(n)))

    ratio = Ratio(np.rint((logs(trusted) - logs(raw)) * UNITS).astype(np.int64), 0.0)

    @F.arrow_udf("double")
    def mean(texts: pa.Array) -> pa.Array:
        return pa.array(ratio.means(texts_of(texts)))

    means = docs.select("doc_id", mean("text").alias("mean")).join(marked, "doc_id")
    pairs = means.groupBy("doc_id").agg(F.min("mean").alias("value"), (F.max("label") > 0).alias("positive"))  # one an id, however often it occurs
    return Ratio(ratio.table, cut_of(pairs, slack=SLACK))


def base_counts(texts: list[str], hasher: WordHasher) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = [t.encode("utf-8", "replace").split() for t in texts]
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    h = mix64(hasher([w for ws in words for w in ws]))
    n_windows = max(0, len(h) - WINDOW + 1)
    window = np.zeros(n_windows, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n_windows]
    doc = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(doc[:n_windows] == doc[WINDOW - 1 : WINDOW - 1 + n_windows]) if n_windows else np.zeros(0, np.int64)
    key = mix64(window[inside] + mix64(doc[inside].astype(np.uint64) + np.uint64(1)))
    _, of, n = np.unique(key, return_inverse=True, return_counts=True)
    again = inside[n[of] > 1]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    repeat = covered[ends] - covered[firsts]
    out = []
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        chars = len(t) - sum(map(t.count, BLANKS))
        out.append((int(sizes[i]), chars, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), int(repeat[i])))
    return out


def judge(docs: DataFrame, ratio: Ratio, *, min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """Add the counts, base_failed, ratio_mean and kept to every row of ``docs``.

    A null or empty text has no words and fails the base rules.  kept is false for rows that
    fail them, else whether the mean log-likelihood ratio per n-gram reaches the cut.  Equal
    texts get equal verdicts.  Columns of these names are replaced; rows stay as they are.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @F.arrow_udf(BASE.replace(">", ", ratio_mean: double>"))
    def counted(column: pa.Array) -> pa.Array:
        texts, hasher, rows = texts_of(column), WordHasher(), []
        for start, end in chunks(texts, CHUNK):
            rows += base_counts(texts[start:end], hasher)
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        return pa.StructArray.from_arrays([*columns, pa.array(ratio.means(texts))], [*names, "ratio_mean"])

    out = packed(docs, "text").withColumn("__q", counted(F.col("text"))).select("__doc", "__q.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio_mean") >= ratio.cut))
    return beside(docs, out, *names, "ratio_mean", "base_failed", "kept")
