import random
import re

import numpy as np
import pytest

from orbitile.llm import neardup

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Union of all linked pairs; ids as the contract wants them, by row."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def planted():
    """Exact copies, chains of edits, and a group of copies of one text of different closeness."""
    rng, data = random.Random(11), cases.rows(60)
    rest = data[0][2:]
    base = cases.prose(rng, 220).split()
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = cases.prose(rng, 1)
        data.append((2000 + k, " ".join(w), *rest))
    chain = cases.prose(rng, 150).split()
    for k in range(12):
        chain[k * 12] = f"edit{k}"
        data.append((3000 - k, " ".join(chain), *rest))
    return data


def test_groups(spark, monkeypatch):
    data = planted()
    rows = [(r[0], r[1]) for r in data]
    want = brute(rows)
    docs = cases.table(spark, data).repartition(4)

    def have():
        out = neardup.near_duplicates(docs).collect()
        assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in out)
        return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)

    assert have() == want
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SLAB", 50)
    assert have() == want


def test_one_row_of_each_group_stays(spark):
    data = planted()
    out = neardup.deduplicate(cases.table(spark, data))
    assert out.columns == cases.SCHEMA.replace("\n", "").replace(",", "").split()[0::2]
    sets = [shingles(r.text) for r in out.collect()]
    words = [s for s in sets if s]
    for i, a in enumerate(words):
        for b in words[:i]:
            assert 100 * len(a & b) < 85 * len(a | b)
    assert sum(not s for s in sets) == sum(not shingles(r[1]) for r in data)


def test_empty_table(spark):
    assert neardup.near_duplicates(cases.table(spark).limit(0)).collect() == []


def test_pigeonhole():
    """Any two signatures within the distance share a key; far ones rarely do."""
    rng = np.random.default_rng(12)
    a = rng.integers(0, 1 << neardup.BITS, (400, neardup.SLOTS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(neardup.SLOTS, neardup.MAX_DISTANCE, replace=False)] ^= 1
    x, y = neardup.signature_keys(a), neardup.signature_keys(b)
    assert (x == y).any(axis=1).all()
    assert not (x[1:] == x[:-1]).any()


def test_components(spark):
    rng = random.Random(13)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [tuple(sorted(rng.sample(range(200, 260), 2))) for _ in range(50)]
    got = dict(neardup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_intersections(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(n)]
    if n:
        both = neardup._intersections(sets)
        assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n))


def between(n=24):
    """Pairs of texts of a similarity between 0.80 and 0.85, both ends of it among them, and some outside."""
    rng, out = random.Random(15), []
    for k in range(n):
        w = [f"p{k}x{i}" for i in range(104)]
        other = w[: 104 - rng.randint(8, 12)] + [f"q{k}x{i}" for i in range(10)]
        out += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    exact = [f"e{i}" for i in range(84)]  # 80 of 100 shingles
    return [*out, (900, " ".join(exact)), (901, " ".join(exact + [f"f{i}" for i in range(20)]))]


@pytest.mark.parametrize("percent", [80, 85])
def test_threshold(spark, percent):
    rows = between()
    want = {}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(a), shingles(b)
        want[i] = i
        want[j] = i if 100 * len(x & y) >= percent * len(x | y) else j
    docs = cases.table(spark, [(*r, *cases.rows()[0][2:]) for r in rows])
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent).collect()} == want
    assert sorted(r.doc_id for r in neardup.deduplicate(docs, percent).collect()) == sorted(set(want.values()))
    linked = sum(k != v for k, v in want.items())
    assert linked > 5 if percent == 80 else linked < 5


def test_pigeonhole_at_every_threshold():
    rng = np.random.default_rng(16)
    assert {p: neardup.distance_of(p) for p in (80, 85)} == {80: 23, 85: 19}
    for percent in (80, 90):
        a = rng.integers(0, 1 << neardup.BITS, (400, neardup.SLOTS)).astype(np.uint16)
        b = a.copy()
        for row in b:
            row[rng.choice(neardup.SLOTS, neardup.distance_of(percent), replace=False)] ^= 1
        assert (neardup.signature_keys(a, percent) == neardup.signature_keys(b, percent)).any(axis=1).all()
