import random

import pytest
from pyspark.sql import functions as F

from orbitile.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string"


def brute_targets(sizes: dict, max_epochs: int = 3) -> dict:
    """Clamp and share again until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    clamped = {}
    while True:
        left, free = sum(sizes.values()) - sum(clamped.values()), [s for s in order if s not in clamped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= max_epochs * sizes[s]]
        if not over:
            return clamped | {s: level * weight[s] for s in free}
        clamped |= {s: float(max_epochs * sizes[s]) for s in over}


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "B", "é", "tiny", None]) if i else "empty"
        if source == "tiny" and rng.random() < 0.8:
            source = "a"
        rows.append((i, source, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 3, 40]) if i else 0)) or None, "clash"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("split_last", [True, False])
def test_targets_are_met(spark, seed, split_last):
    docs = spark.createDataFrame(corpus(400, seed), SCHEMA)
    out = mixing.mix(docs, mixing.word_count("text"), split_last=split_last).collect()
    assert len(out) == 400
    sizes, taken = {}, {}
    for r in out:
        assert r["size"] == len((r["text"] or "").split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= (0.5 if split_last else 20.5) + 1e-6


def test_reruns_agree_and_copies_follow(spark):
    docs = spark.createDataFrame(corpus(300, 5), SCHEMA)
    first, again = (mixing.mix(d, mixing.word_count("text"), split_last=False).orderBy("doc_id").collect() for d in (docs, docs.repartition(7)))
    assert first == again
    assert all(r["taken"] == r["copies"] * r["size"] for r in first if r["size"])
    rows = mixing.mixed_corpus(docs)
    assert rows.columns == docs.columns
    assert rows.count() == sum(r["copies"] for r in first)
    assert {r["size"] for r in rows.collect()} == {"clash"}


def test_repeated_rows_and_empty_table(spark):
    row = (1, "a", "one two three four", "x")
    docs = spark.createDataFrame([row] * 5 + [(2, "b", "one", "x")], SCHEMA)
    out = mixing.mix(docs, mixing.word_count("text")).groupBy("source").agg(F.sum("taken"), F.first("target")).collect()
    assert all(abs(r[1] - r[2]) <= 0.5 for r in out)
    assert mixing.mix(docs.limit(0), mixing.word_count("text")).collect() == []


def test_equal_ids_with_other_texts_keep_their_copies(spark):
    docs = spark.createDataFrame([(i % 3, "ab"[i % 4 == 0], f"one two w{i}", "x") for i in range(120)], SCHEMA)
    first, again = (sorted(r["text"] for r in mixing.mixed_corpus(docs.repartition(n)).collect()) for n in (1, 6))
    assert first == again


@pytest.mark.parametrize("ids", ["none", "equal", "unique"])
def test_edges_are_found_digit_by_digit(spark, monkeypatch, ids):
    """With small buckets the histograms go on until the edge is in one, also where one id has all rows."""
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 4)
    of = {"none": lambda i: None, "equal": lambda i: 1, "unique": lambda i: i}[ids]
    docs = spark.createDataFrame([(of(i), "abc"[i % 7 % 3], f"w{i} " * (i % 9), "x") for i in range(500)], SCHEMA)
    first, again = (mixing.mix(docs.repartition(n), mixing.word_count("text")).orderBy("text").collect() for n in (1, 5))
    assert [(r.text, r.taken) for r in first] == [(r.text, r.taken) for r in again]
    sizes, taken = {}, {}
    for r in first:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6


def test_many_sources(spark):
    """Places of the sources in code point order come from ranges, not from one task."""
    docs = spark.createDataFrame([(i, f"s{i % 300:03}", "one two three", "x") for i in range(900)], SCHEMA)
    out = mixing.mix(docs, mixing.word_count("text")).select("source", "target").distinct().collect()
    want = brute_targets({f"s{k:03}": 9 for k in range(300)})
    assert {r.source: round(r.target, 6) for r in out} == {s: round(t, 6) for s, t in want.items()}
