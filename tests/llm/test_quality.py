import collections
import random
import re

import pytest

from orbitile.llm import quality
from orbitile.llm.text import WordHasher

from . import cases

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = W.findall(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit, seen, dup = set(), set(), 0
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts():
    rng = random.Random(8)
    texts = [r[1] or "" for r in cases.rows()]
    for _ in range(60):
        lines = [" ".join(rng.choice("ab#c|") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))) for _ in range(6)]
        texts.append("\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))))
    assert quality.base_counts(texts, WordHasher()) == [brute(t) for t in texts]


def corpus():
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = cases.prose(rng, rng.randint(25, 90))
        docs.append((i, text if good else text.upper().replace(" ", "!! "), *cases.rows()[0][2:]))
        labels.append((i, int(good)))
    return docs, labels


def test_verdicts(spark):
    docs, labels = corpus()
    table = cases.table(spark, [*docs, *cases.rows()])
    ratio = quality.learn(table, spark.createDataFrame([(i, q) for i, q in labels if i % 2], "doc_id long, quality int"))
    ratio_all = quality.learn(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert ratio.table.shape == ratio_all.table.shape
    out = quality.judge(cases.table(spark, docs), ratio_all).collect()
    truth = dict(labels)
    assert sum(r.kept == bool(truth[r.doc_id]) or r.base_failed for r in out) / len(out) > 0.97
    assert all(not r.kept for r in out if r.base_failed)


def test_awkward_rows(spark):
    docs, labels = corpus()
    table = cases.table(spark)
    ratio = quality.learn(table, spark.createDataFrame([], "doc_id long, quality int"))
    out = quality.judge(table, ratio)
    assert out.count() == table.count()
    empty = out.where("text is null or text = ''").collect()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in empty)
    assert out.where("not base_failed and not kept").count() == 0
    assert quality.judge(table.limit(0), ratio).count() == 0


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_same_in_any_order_and_batch(spark, batch):
    """What is learned and every verdict depend on the texts alone, not on the rows beside them."""
    docs, labels = corpus()
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for size, data in ((10_000, docs), (batch, docs), (batch, docs[::-1])):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            table = cases.table(spark, data)
            ratio = quality.learn(table, labelled)
            rows = quality.judge(table, ratio).select("doc_id", "ratio_mean", "kept").collect()
            found.append((ratio.cut, ratio.table.tobytes(), sorted(map(tuple, rows))))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] == found[2]
