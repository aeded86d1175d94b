"""Every labelled row counts, and sets the cut, however many there are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitile.llm import quality
from orbitile.llm.text import best_cut


def test_all_labelled_rows_are_learned_from(spark):
    n = 24_000
    words = F.concat_ws(" ", F.sha2(F.col("doc_id").cast("string"), 256), F.when(F.col("doc_id") % 5 < 3, "of the").otherwise("!!"))
    docs = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("text", words)
    labels = docs.where("doc_id % 11 <> 0").select("doc_id", ((F.col("doc_id") % 5 < 3) == (F.col("doc_id") % 7 > 0)).cast("int").alias("quality"))
    twice = labels.where("doc_id % 100 = 1")  # a label that occurs twice counts once
    ratio = quality.learn(docs, labels.union(twice))
    texts, truth = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality > 0 for r in labels.collect()}

    def logs(chosen):
        buckets, _ = quality.gram_buckets(chosen)
        found = np.bincount(buckets, minlength=1 << quality.HASH_BITS) + quality.SMOOTHING
        return np.log(found / found.sum())

    table = np.rint((logs([texts[i] for i in truth if truth[i]]) - logs(list(texts.values()))) * quality.UNITS).astype(np.int64)
    assert np.array_equal(ratio.table, table)
    ids = sorted(truth)
    means = quality.Ratio(table, 0.0).means([texts[i] for i in ids])
    assert ratio.cut == best_cut(means, np.array([truth[i] for i in ids]), slack=quality.SLACK)


@pytest.mark.parametrize("kind", ["mixed", "few values", "good", "bad", "inverse", "one"])
def test_cut_over_a_table(spark, kind):
    rng = random.Random(kind)
    rows = [(round(rng.gauss(k % 2, 1), 1 if kind == "few values" else 9), k % 2 == 1) for k in range(300)]
    rows = {"good": [(v, True) for v, _ in rows], "bad": [(v, False) for v, _ in rows], "inverse": [(-v, p) for v, p in rows], "one": rows[:1]}.get(kind, rows)
    table = spark.createDataFrame(rows, "value double, positive boolean").repartition(3)
    for slack in (0.0, 0.005, 0.1):
        assert quality.cut_of(table, slack=slack) == best_cut(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), slack=slack)


def test_cut_without_rows(spark):
    assert quality.cut_of(spark.createDataFrame([], "value double, positive boolean")) == 0.0
