import math
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from orbitile.llm import sharding

from . import cases


def brute(rows, n_shards, seed=7):
    """Rank rows of each source by hash, order all by fraction, cut evenly."""
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    placed = []
    for s, found in sources.items():
        found.sort(key=lambda r: (md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0))
        placed += [((2 * k - 1) / (2 * len(found)), (s is None, (s or "").encode()), k, r) for k, r in enumerate(found, 1)]
    placed.sort(key=lambda p: p[:3])
    out = []
    for p, (_, _, _, r) in enumerate(placed):
        shard = p * n_shards // len(placed)
        out.append((r[0], shard, p - math.ceil(shard * len(placed) / n_shards)))
    return out


@pytest.mark.parametrize("n_shards", [1, 7, 40, 500])
def test_law(spark, n_shards):
    data = cases.rows(200)
    out = sharding.interleave(cases.table(spark, data).repartition(5), n_shards).collect()
    assert len(out) == len(data)
    assert sorted(((r.doc_id, r.shard, r.slot) for r in out), key=str) == sorted(brute(data, n_shards), key=str)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(n_shards)) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == k) == list(range(n))


def test_every_shard_matches_the_mixture(spark):
    data = [(i, "t", "en", "abc"[min(2, i % 5)], 1, 1, "c", "c", "c", "c", "c") for i in range(2000)]
    out = sharding.interleave(cases.table(spark, data), 10).collect()
    whole = Counter(r.source for r in out)
    for k in range(10):
        part = Counter(r.source for r in out if r.shard == k)
        assert all(abs(part[s] - whole[s] / 10) <= 2 for s in whole)


def test_empty_table_and_sizes(spark):
    assert sharding.interleave(cases.table(spark).limit(0), 40).collect() == []
    rows = cases.table(spark).select("text", sharding.utf8_size("text").alias("b")).collect()
    assert all(r.b == 16 + len((r.text or "").encode()) for r in rows)


def test_equal_ids_with_other_texts_keep_their_places(spark):
    data = [(i % 7, f"text {i}", "en", "a", 1, 1, "c", "c", "c", "c", "c") for i in range(200)]
    first, again = (sharding.interleave(cases.table(spark, data).repartition(n), 10).select("text", "shard", "slot") for n in (1, 6))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("ids", ["none", "equal", "few"])
def test_frequent_ids_are_split(spark, monkeypatch, ids):
    """Rows without an id, or with one id, go to many buckets: no task ranks them all."""
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 8)
    of = {"none": lambda i: None, "equal": lambda i: 5, "few": lambda i: i if i % 3 else 5}[ids]
    data = [(of(i), f"text {i}", "en", "ab"[i % 5 == 0], i, 1, "c", "c", "c", "c", "c") for i in range(600)]
    docs = cases.table(spark, data)
    placed = sharding.packed(docs, F.col("source").alias("__s"), sharding.order_key(docs, 7).alias("__key"))
    out = [sorted((r.text, r.shard, r.slot) for r in sharding.interleave(docs.repartition(n), 10).collect()) for n in (1, 5)]
    assert out[0] == out[1]
    sizes = Counter(shard for _, shard, _ in out[0])
    assert set(sizes.values()) == {60}
    for k in range(10):
        assert sorted(slot for _, shard, slot in out[0] if shard == k) == list(range(60))
    ranks = sharding.ranked(placed, 480).groupBy("__s").agg(F.sort_array(F.collect_list("__r")).alias("r"), F.first("__n").alias("n")).collect()
    assert all(list(r.r) == list(range(1, r.n + 1)) for r in ranks)


def test_maps_count_as_json(spark):
    rows = [(1, "t", "a", {"k": str(i)}) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, props map<string, string>")
    first, again = (sorted((r.props["k"], r.shard, r.slot) for r in sharding.interleave(docs.repartition(n), 4).collect()) for n in (1, 4))
    assert first == again


def test_starts_of_slices(spark, monkeypatch):
    """Starts are sums of closed forms over all sources, in any number of runs and beyond products of 64 bits."""
    monkeypatch.setattr(sharding, "SLICES_PER_RUN", 16)
    sizes, slices = [1, 3, 50, 99, 100, 101, 5000, 3 * 10**15], 100
    sources = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = {r[0]: r[1] for r in sharding.slice_starts(sources, slices).collect()}
    want = {j: sum(((2 * n * j + slices - 1) // slices) // 2 for n in sizes) for j in range(slices)}
    assert got == want


def test_slices_of_a_source_beyond_64_bits(spark):
    """(2r - 1) * slices passes 2^63 from about 9.6e10 rows of one source on."""
    n = 10**12
    slices, ranks = n // 2000, [1, 2, n // 3, n - 1, n]
    rows = spark.createDataFrame([(r, n) for r in ranks], "__r long, __n long")
    got = rows.select(F.expr(sharding._div("2 * __r - 1", str(slices), "2 * __n"))).collect()
    assert [r[0] for r in got] == [(2 * r - 1) * slices // (2 * n) for r in ranks]


def test_more_sources_than_rows_of_a_slice(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 4)
    data = [(i, "t", "en", f"s{i % 61}" if i % 3 else None, 1, 1, "c", "c", "c", "c", "c") for i in range(300)]
    out = sharding.interleave(cases.table(spark, data).repartition(3), 9).collect()
    assert sorted(((r.doc_id, r.shard, r.slot) for r in out)) == sorted(brute(data, 9))
