import random

from orbitile.llm import toxicity
from orbitile.llm.common import fold_of

from . import cases


def corpus():
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(900):
        text, toxic = cases.prose(rng, rng.randint(8, 120)), i % 6 == 0
        words = text.split()
        if toxic:
            for _ in range(1 + len(words) // 15):
                words.insert(rng.randint(0, len(words)), rng.choice(["blockhead", "blockheaded", "nitwit", "NitWit!", "n1twit", "nіtwіt"]))
        elif i % 10 == 1:
            words[1:1] = ["chocolate", "nitwit"]
        docs.append((i, " ".join(words), *cases.rows()[0][2:]))
        labels.append((i, int(toxic)))
    return docs, labels


def test_folding():
    assert toxicity.fold("N1twіt,  nítw­it @lph@bet $$$ ｉｄ") == " nitwit nitwit lphabet id "
    assert toxicity.fold("") == "  "


def test_held_out_accuracy_and_exceptions(spark):
    docs, labels = corpus()
    table, marks = cases.table(spark, docs), spark.createDataFrame([*labels, (None, 1), (5, None), (0, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(table, marks)
    assert any("chocolate nitwit" in e for e in lexicon.exceptions)
    out = toxicity.score(table, lexicon).withColumn("held", fold_of("doc_id", 5) == 0).where("held").collect()
    truth = dict(labels)
    right = sum(r.predicted == truth[r.doc_id] for r in out)
    assert right / len(out) > 0.97
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in out)


def test_awkward_rows(spark):
    docs, labels = corpus()
    lexicon = toxicity.learn(cases.table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    table = cases.table(spark)
    out = toxicity.score(table, lexicon)
    assert out.count() == table.count() and set(table.columns) <= set(out.columns)
    assert {r.score for r in out.where("text is null or text = ''").collect()} == {0.0}
    assert toxicity.score(table.limit(0), lexicon).count() == 0


def test_no_labels(spark):
    lexicon = toxicity.learn(cases.table(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert lexicon.weights == {} and lexicon.score("anything") == 0.0
