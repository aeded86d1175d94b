"""Columns of the user's own, whatever their names, pass every operator as they are."""

import pytest
from pyspark.sql import functions as F

from orbitile.llm import chat, decontaminate, langid, lm, mixing, neardup, quality, secrets, sharding, toxicity

from . import cases

#: Names that operators use inside, and one with a dot.
OWN = "whole rest cut key extra copy m found rid nid __rid __d __doc __mine __key __s __r __n __p __q __m0 __h __place a.b".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r[0], r[1], r[2], r[3], *[f"{name}-{k}" for name in OWN]) for k, r in enumerate(cases.rows(40)) if len(r[1] or "") < 5_000]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *[f"`{n}` string" for n in OWN]])).cache()


def labels(docs):
    number = F.crc32(F.col("doc_id").cast("string"))
    return docs.where("doc_id is not null").select("doc_id", (number % 2).cast("int").alias("toxic"), (number % 3 > 0).cast("int").alias("quality"))


def bench(docs):
    return docs.sparkSession.createDataFrame([(1, "alpha beta gamma delta"), (2, None)], "item_id long, text string")


WAYS = {
    "op2_match": lambda d: decontaminate.match(d, bench(d)),
    "op2_match_in_blocks": lambda d: decontaminate.match(d, bench(d), block_chars=10),
    "op2_remove": lambda d: decontaminate.remove(d, bench(d)),
    "op3_score": lambda d: toxicity.score(d, toxicity.learn(d, labels(d))),
    "op3_remove": lambda d: toxicity.remove(d, toxicity.learn(d, labels(d))),
    "op5_judge": lambda d: quality.judge(d, quality.learn(d, labels(d))),
    "op6_predict": lambda d: langid.predict(d, langid.learn(d, F.lit(True))),
    "op7_interleave": lambda d: sharding.interleave(d, 7),
    "op8_scan": lambda d: secrets.scan(d, secrets.train(d)),
    "op9_mix": lambda d: mixing.mix(d, mixing.word_count("text")),
    "op9_mixed_corpus": mixing.mixed_corpus,
    "op10_deduplicate": neardup.deduplicate,
}
ALL_ROWS = {"op2_match", "op2_match_in_blocks", "op3_score", "op5_judge", "op6_predict", "op7_interleave", "op8_scan", "op9_mix"}


@pytest.mark.parametrize("way", WAYS)
def test_own_columns_stay(docs, way):
    out = WAYS[way](docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    wanted = {tuple(r) for r in docs.collect()}
    got = [tuple(r)[: len(docs.columns)] for r in out.collect()]
    assert set(got) <= wanted and got
    if way in ALL_ROWS:
        assert set(got) == wanted and len(got) == docs.count()


def test_operators_with_columns_of_their_own(docs):
    assert lm.score(docs, F.lit(True)).count() == docs.count()
    assert neardup.near_duplicates(docs).count() == docs.count()
    turns = docs.select("*", F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"))
    assert chat.format_chats(turns).count() > 10


@pytest.mark.parametrize("way", [w for w in WAYS if not w.startswith("op9_mixed")])
def test_empty_table(docs, way):
    """Learning from an empty table, and applying to one."""
    none = docs.limit(0)
    assert WAYS[way](none).collect() == []


def test_learning_from_nothing(docs):
    """Without rows to learn from, nothing is toxic or cut for its ratio, no language is known, and secrets are random strings alone."""
    none = docs.limit(0)
    few = docs.limit(20)
    assert {r.predicted for r in toxicity.score(few, toxicity.learn(none, labels(none))).collect()} == {0}
    assert all(r.kept != r.base_failed for r in quality.judge(few, quality.learn(none, labels(none))).collect())
    assert {(r.lang_pred, r.score) for r in langid.predict(few, langid.learn(none, F.lit(True))).collect()} == {("und", 0.0)}
    assert secrets.scan(few, secrets.train(none)).count() == few.count()


def test_ids_of_text(docs):
    """A doc_id that is no number is as good."""
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    for way in ("op2_match", "op3_score", "op5_judge", "op6_predict", "op7_interleave", "op8_scan", "op9_mix", "op10_deduplicate"):
        assert WAYS[way](named).count() > 0
    assert decontaminate.longest_matches(named, bench(docs)).count() >= 0
