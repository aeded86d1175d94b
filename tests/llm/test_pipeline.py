import random

import pytest

import corpus_pipeline

from . import cases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, base = random.Random(14), tmp_path_factory.mktemp("tables")
    rest = cases.rows()[0][2:]
    data, labels = [], []
    for i in range(600):
        text = cases.prose(rng, rng.randint(12, 80))
        toxic = i % 5 == 0
        data.append((i, text + (" nitwit blockhead" * 3 if toxic else ""), *rest[:1], rng.choice(["a", "b", None]), *rest[2:]))
        labels.append((i, int(toxic)))
    items = [(k, cases.prose(rng, 14)) for k in range(5)]
    data += [(1000 + k, f"{cases.prose(rng, 30)} {t} {cases.prose(rng, 20)}", *rest) for k, t in items]
    data += [(2000 + k, data[7][1], *rest) for k in range(4)] + [(3000, None, *rest), (3001, "", *rest), (None, cases.prose(rng, 30), *rest)]
    cases.table(spark, data).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        kept[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
            assert {(r.score, r["size"], r.n_words, r.spans, r.sig) for r in kept[name]} == {("c",) * 5}
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert not any(i is not None and i < 600 and i % 5 == 0 for i in ids["toxicity"])
    assert {i for i in range(600) if i % 5} <= ids["toxicity"]
    assert not {2000, 2001, 2002, 2003} & ids["near_duplicates"] and 7 in ids["near_duplicates"]
    assert {3000, 3001, None} <= ids["near_duplicates"]
    assert not {1000, 1001, 1002, 1003, 1004} & ids["decontamination"]
    assert ids["near_duplicates"] - ids["decontamination"] == {1000, 1001, 1002, 1003, 1004}
    before, after = (sum(len((r.text or "").split()) for r in kept[n]) for n in ("decontamination", "mixing"))
    assert abs(before - after) <= 3 * 80
    assert len(kept["sharding"]) == len(kept["mixing"])
    sizes = [sum(r.shard == k for r in kept["sharding"]) for k in range(corpus_pipeline.N_SHARDS)]
    assert max(sizes) - min(sizes) <= 1


def test_run_equals_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"shard", "slot"} <= set(out.columns)
    n = out.count()
    assert n and out.select("shard", "slot").distinct().count() == n


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage_links_from_80_percent_on(spark):
    words = [f"w{i}" for i in range(84)]  # 80 shingles of these 100
    rows = [(k, t, *cases.rows()[0][2:]) for k, t in enumerate([" ".join(words), " ".join(words + [f"v{i}" for i in range(20)])])]
    out = corpus_pipeline.drop_near_duplicates(spark, cases.table(spark, rows), "")
    assert [r.doc_id for r in out.collect()] == [0]
