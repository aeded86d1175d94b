"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Every stage takes all rows its predecessor kept, and each but the last returns the columns
of ``documents``.  Null texts count as empty throughout: they are clean, unlike any other
row, and get their place in the mixture and in a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitile.llm import decontaminate, mixing, neardup, sharding, toxicity
from orbitile.llm.common import discard, materialise, table

N_SHARDS = 40
#: Texts with this share of their five-word shingles in common are near duplicates; op10's contract has 85 for its query.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the learned lexicon does not call toxic."""
    return toxicity.remove(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id."""
    return neardup.deduplicate(docs, NEAR_PERCENT)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no benchmark window occurs in."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: rows repeated up to three times, or left out of a last partial epoch."""
    return mixing.mixed_corpus(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it."""
    return sharding.interleave(docs, N_SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: SQL can express neither the learned lexicon nor the signature join; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    The table of a stage is dropped when that of the next is whole.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        made = materialise(stage(spark, docs, sf_dir))
        if k:
            discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
