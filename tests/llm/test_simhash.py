"""Fingerprints, edits and the search of block tables against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from orbitile.llm import queries, simhash
from orbitile.llm.text import WordHasher

from . import cases

M = 2**64 - 1


def plain_bits(word, of):
    out = []
    for k in range(simhash.BITS // 64):
        x = (xxh3_64_intdigest(word) + 0x9E3779B97F4A7C15 * (k + 1)) & M
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
        out += [int(b) for byte in (x ^ (x >> 31)).to_bytes(8, "little") for b in f"{byte:08b}"]
    return out, of[xxh3_64_intdigest(word) >> (64 - simhash.COUNT_BITS)]


def plain_fingerprint(text, of):
    votes = [0] * simhash.BITS
    for word in set((text or "").encode().split()):
        bits, weight = plain_bits(word, of)
        votes = [v + (weight if b else -weight) for v, b in zip(votes, bits, strict=True)]
    return f"{int(''.join('1' if v > 0 else '0' for v in votes), 2):0{simhash.BITS // 4}x}"


def plain_weights(texts):
    counts = {}
    for text in texts:
        for place in {xxh3_64_intdigest(w) >> (64 - simhash.COUNT_BITS) for w in (text or "").encode().split()}:
            counts[place] = counts.get(place, 0) + 1
    out = np.full(1 << simhash.COUNT_BITS, 1 + int(np.floor(simhash.STEPS * np.log2(max(1, len(texts))))))
    for place, n in counts.items():
        out[place] = 1 + int(np.floor(simhash.STEPS * np.log2(max(1.0, len(texts) / n))))
    return out


def distance(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_query(spark, tmp_path):
    rows = [r for r in cases.rows(60) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(1000 + 50 * k, rows[30][1] + " end" * (k % 3), *rows[0][2:]) for k in range(9)]
    cases.table(spark, rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_simhash(spark, str(tmp_path)).collect()}
    ordered = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    of = plain_weights([t for _, t in ordered])
    prints = [plain_fingerprint(t, of) for _, t in ordered]
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == prints[k] and r.edited_fingerprint == plain_fingerprint(edited, of)
        assert r.near_edited == 1 - distance(r.fingerprint, r.edited_fingerprint) / simhash.BITS
        assert r.near_next == 1 - distance(prints[k], prints[(k + 1) % len(ordered)]) / simhash.BITS
        assert r.n_near == (sum(distance(prints[k], p) <= simhash.RADIUS for p in prints) if i % 50 == 0 else None)


def test_awkward_rows(spark):
    table = cases.table(spark)
    weights = simhash.learn(table)
    out = simhash.fingerprints(table, weights)
    assert out.columns == [*table.columns, "fingerprint"]
    rows = out.collect()
    assert len(rows) == table.count()
    assert {r.fingerprint for r in rows if not (r.text or "").encode().split()} == {"0" * (simhash.BITS // 4)}
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.fingerprint) == r.fingerprint
    edits = simhash.with_edits(table, weights).collect()
    assert sorted(str(r.doc_id) for r in edits) == sorted(str(r.doc_id) for r in rows)
    none = table.limit(0)
    assert simhash.with_edits(none, simhash.learn(none)).count() == 0
    assert simhash.fingerprints(none, simhash.learn(none)).count() == 0


def test_one_row(spark):
    table = cases.table(spark).where("doc_id = 30").limit(1)
    r = simhash.with_edits(table, simhash.learn(table)).collect()[0]
    assert r.fingerprint == r.next_fingerprint and r.n_chars == len(cases.rows()[30][1])


def test_votes_in_blocks(monkeypatch):
    rng = random.Random(3)
    weights = simhash.Weights(np.array([rng.randint(1, 60) for _ in range(1 << simhash.COUNT_BITS)], np.int32))
    hashes = simhash.terms(" ".join(str(k) for k in range(3000)), WordHasher())
    whole = weights.fingerprint(hashes)
    monkeypatch.setattr(simhash, "TERMS_AT_ONCE", 64)
    assert (weights.fingerprint(hashes) == whole).all()


@pytest.mark.parametrize("radius, per_key, run_rows", [(3, 32, 10_000), (8, 1e-60, 20), (0, 32, 7)])
def test_search(spark, monkeypatch, radius, per_key, run_rows):
    """All pairs within the radius, once, by tables of one or of several blocks, with keys that are split or not."""
    monkeypatch.setattr(simhash, "PER_KEY", per_key)
    monkeypatch.setattr(simhash, "RUN_ROWS", run_rows)
    if per_key < 1:
        monkeypatch.setattr(simhash, "block_tables", lambda r, n: ([(b * 256 // (r + 2), (b + 1) * 256 // (r + 2)) for b in range(r + 2)], [(a, b) for a in range(r + 2) for b in range(a + 1, r + 2)]))
    rng = random.Random(radius)
    prints = []
    for _ in range(6):
        centre = rng.getrandbits(256)
        for _ in range(20):
            x = centre
            for b in rng.sample(range(256), rng.randint(0, 6)):
                x ^= 1 << b
            prints.append(f"{x:064x}")
    table = spark.createDataFrame([(p,) for p in [*prints, prints[0], None]], "fingerprint string")
    distinct = sorted(set(prints))
    wanted = sorted((a, b, distance(a, b)) for a in distinct for b in distinct if distance(a, b) <= radius)
    assert sorted(map(tuple, simhash.search(table, radius).collect())) == wanted
    some = table.where(F.col("fingerprint").isin(distinct[:5]))
    assert sorted(map(tuple, simhash.search(table, radius, queries=some).collect())) == [w for w in wanted if w[0] in distinct[:5]]
