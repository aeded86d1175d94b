import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitile.llm import langid
from orbitile.llm.common import fold_of

from . import cases

SYLLABLES = {"aa": ["la", "mi", "ro", "té"], "bb": ["sch", "ung", "ei", "ö"], "cc": ["tion", "ous", "th", "e"]}


def corpus(n=300):
    rng = random.Random(10)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 60)))
        out.append((i, text, lang, *cases.rows()[0][3:]))
    return out


def brute_bits(train: list[str], text: str) -> float:
    """Code length by the definition: dictionaries of counts, one byte at a time."""
    counts = {}
    for t in train:
        data = langid.PAD + t.lower().encode()
        for p in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER + 1):
                node = counts.setdefault(data[p - k : p], {})
                node[data[p]] = node.get(data[p], 0) + 1
    data, bits = langid.PAD + text.lower().encode(), 0.0
    for p in range(langid.ORDER, len(data)):
        for k in range(langid.ORDER, -1, -1):
            node = counts.get(data[p - k : p])
            if node:
                total, kinds = sum(node.values()), len(node)
                if data[p] in node:
                    bits += np.log2((total + kinds) / node[data[p]])
                    break
                bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8.0
    return bits


def test_exact_code_lengths():
    train = [r[1] for r in corpus(20)]
    codes = langid.grams(b"".join(langid.PAD + langid.as_bytes(t) for t in train[:1]))
    keys, n = np.unique(codes, return_counts=True)
    tree = langid.ContextTree(keys, n.astype(float))
    texts = [train[1], "", "zz \x00 é", train[0]]
    got = langid.code_lengths(texts, [tree])[:, 0]
    assert got == pytest.approx([brute_bits(train[:1], t) for t in texts])


def test_held_out_accuracy(spark):
    table = cases.table(spark, corpus())
    held = fold_of("doc_id", 4) == 2
    trees = langid.learn(table, ~held)
    assert set(trees) == set(SYLLABLES)
    out = langid.predict(table, trees).where(held).collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_awkward_rows(spark):
    trees = langid.learn(cases.table(spark, corpus(60)), F.lit(True))
    table = cases.table(spark)
    out = langid.predict(table, trees)
    assert out.count() == table.count()
    for r in out.collect():
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r["text"] or "")))
    assert langid.predict(table.limit(0), trees).count() == 0
    none = langid.learn(table.where("lang is null"), F.lit(True))
    assert none == {} and {r.lang_pred for r in langid.predict(table, none).collect()} == {"und"}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_is_learned(spark):
    rows = [(k, f"text of {k}", f"l{k:03}") for k in range(230)] + [(500 + k, "more", "l000") for k in range(30)]
    assert set(langid.learn(labelled(spark, rows), F.lit(True))) == {f"l{k:03}" for k in range(230)}


@pytest.mark.parametrize("ids", [[3], [4, 5], [None]])
def test_a_language_of_few_ids_and_many_rows_is_learned(spark, ids):
    rows = labelled(spark, [(i, f"only {i}", "few") for i in ids] + [(7, "other", "one")])
    rows = rows.crossJoin(spark.range(20_000).select()).unionByName(labelled(spark, [(k, "many", "many") for k in range(300)]))
    assert set(langid.learn(rows, F.lit(True), rows_per_language=1)) == {"few", "many", "one"}


def test_sampled_ids_by_shuffle(spark, monkeypatch):
    rows = labelled(spark, [(k % 150, f"text {k}", "ab"[k % 2]) for k in range(600)])
    want = langid.learn(rows, F.lit(True), rows_per_language=20)
    monkeypatch.setattr(langid, "BROADCAST_IDS", 0)
    have = langid.learn(rows, F.lit(True), rows_per_language=20)
    assert all(np.array_equal(x, y) for k in want for a, b in zip(want[k].levels, have[k].levels, strict=True) for x, y in zip(a, b, strict=True))
