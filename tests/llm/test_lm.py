import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitile.llm import lm
from orbitile.llm.common import fold_of
from orbitile.llm.eliasfano import EliasFano, Quantised, Trie

from . import cases


@pytest.mark.parametrize(("n", "universe"), [(1, 2), (5, 100), (1000, 1001), (1000, 10**7), (2000, 10**12)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n)).astype(np.int64)
    arrays, m, bits = EliasFano.arrays(values, universe)
    ef = EliasFano(arrays, m, bits)
    assert (ef.access(np.arange(m)) == values).all()
    asked = np.concatenate([values, rng.integers(0, universe, 500)]).astype(np.int64)
    at, equal = ef.successor(asked, np.zeros(len(asked), np.int64), np.full(len(asked), m))
    assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie_round_trip(tmp_path):
    """Every path of a random trie is found with its values, and no other."""
    rng = np.random.default_rng(2)
    n = 20_000
    paths = np.unique(np.stack([rng.integers(1, 300, n), rng.integers(1, 40, n), rng.integers(1, 500, n)], axis=1), axis=0)
    words, of1 = np.unique(paths[:, 0], return_inverse=True)
    pairs, of2 = np.unique(of1 * 1_000 + paths[:, 1], return_inverse=True)
    p = {k: 10 ** -(8 * rng.random(m)) for k, m in (("own2", len(pairs)), ("rest2", len(pairs)), ("own3", len(paths)))}
    (tmp_path / "t").write_bytes(Trie.build(words, pairs // 1_000, pairs % 1_000, of2, paths[:, 2], **p))
    trie = Trie.open(str(tmp_path / "t"))
    assert isinstance(trie.own3.codes.base, np.memmap) or isinstance(trie.own3.codes, np.memmap)
    asked = np.concatenate([paths, np.stack([rng.integers(0, 400, n), rng.integers(0, 60, n), rng.integers(0, 600, n)], axis=1)])
    node1 = trie.roots(asked[:, 0])
    node2 = trie.children("pairs", "first", node1, asked[:, 1])
    node3 = trie.children("triples", "second", node2, asked[:, 2])
    there = {tuple(x): k for k, x in enumerate(paths.tolist())}
    assert [there.get(tuple(x), -1) for x in asked.tolist()] == node3.tolist()
    got = Quantised.values(trie.codes("own3", node3), trie.own3.low, trie.own3.step)
    assert np.abs(np.log10(got[: len(paths)]) - np.log10(p["own3"])).max() < 1e-3 and not got[node3 < 0].any()


def test_an_empty_trie(tmp_path):
    none, p = np.zeros(0, np.int64), np.zeros(0)
    (tmp_path / "t").write_bytes(Trie.build(none, none, none, none, none, own2=p, rest2=p, own3=p))
    trie = Trie.open(str(tmp_path / "t"))
    assert (trie.roots(np.array([0, 5])) == -1).all() and (trie.children("pairs", "first", np.array([-1]), np.array([3])) == -1).all()


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base, score) of every row, by plain counting."""
    rows = [(i, (t or "").encode().lower().split()) for i, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    tokens = [[*ws, b"\n"] for _, ws in rows]
    counts = [collections.Counter() for _ in range(3)]
    for ws, t in zip(tokens, train, strict=True):
        if t:
            x = [b" ", b" ", *ws]
            counts[0].update(ws)
            counts[1].update(zip(x[1:], x[2:]))  # noqa: B905
            counts[2].update(zip(x, x[1:], x[2:]))  # noqa: B905
    one, two, three = counts
    n, v = sum(one.values()), len(one)
    n1, n2 = (sum(c == k for c in one.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    texts = sum(train)

    def context(h):
        return texts if h in ((b" ",), (b" ", b" ")) else one[h[0]] if len(h) == 1 else two[h]

    def p(h, w):
        if not h:
            return (one[w] - d) / n if one[w] else d * v / n if n else 1.0
        c, shorter = context(h), p(h[1:], w)
        kinds = c**lm.GROWTH
        seen = (two if len(h) == 1 else three)[*h, w]
        return seen / (c + kinds) + kinds / (c + kinds) * shorter if c else shorter

    out = []
    for (i, _), ws, t in zip(rows, tokens, train, strict=True):
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        x = [b" ", b" ", *ws]
        score = sum(math.log10(p((x[k], x[k + 1]), w)) for k, w in enumerate(ws))
        out.append((i, not t, len(ws), sum(one[w] > 0 for w in ws), n, base, score))
    return out


def same(have, want):
    have, want = (sorted(map(tuple, r), key=lambda x: (x[0] is None, x[0] or 0, x[2], x[5])) for r in (have, want))
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-3, abs=1e-2)


def test_scores(spark):
    data = cases.rows()
    got = lm.score(cases.table(spark, data).repartition(3), fold_of("doc_id", 5) != 1).collect()
    same(got, brute([(r[0], r[1]) for r in data]))


def test_scores_in_many_blocks_and_shards(spark, monkeypatch):
    """Small blocks and shards, in which frequent words and pairs are spread."""
    monkeypatch.setattr(lm, "shards_for", lambda docs: 9)
    monkeypatch.setattr(lm, "BLOCK_CHARS", 3_000)
    rng = random.Random(5)
    row = cases.rows()[0][2:]
    data = [r for r in cases.rows(80) if len(r[1] or "") < 9_000]
    data += [(700 + k, " ".join(f"so it {rng.choice('abcdefghijklmnop')}{k % 7}" for _ in range(60)), *row) for k in range(40)]
    docs = cases.table(spark, data).repartition(5)
    same(lm.score(docs, fold_of("doc_id", 5) != 1).collect(), brute([(r[0], r[1]) for r in data]))
    blocks, n = lm.as_blocks(docs, fold_of("doc_id", 5) != 1)
    model, *_ = lm.learn(blocks, n, 9)
    assert len(model.hot) > 0 and model.table(spark, "tries").count() > 4


def test_answers_of_learning_are_those_of_asking(spark, monkeypatch):
    """What ``learn`` answers about its own texts is not asked again, and no score depends on who was asked."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 400)
    blocks, n = lm.as_blocks(cases.table(spark), F.col("doc_id") % 5 != 1)
    model, known, answered = lm.learn(blocks, n, 6)
    asked = {which: known.mapInArrow(lm.ask_paths(model, which), lm.ROWS).agg(F.sum(F.length("payload"))).first()[0] for which in ("all", "rest")}
    assert asked["rest"] < asked["all"] / 2
    assert {r.kind for r in model.table(spark, "tries").select("kind").distinct().collect()} == {"trie", "trained"}
    with_answers, without = (sorted(map(str, lm.score_blocks(known, n, model, given).collect())) for given in (answered, None))
    assert with_answers == without and len(without) == cases.table(spark).count()


def test_a_kept_model_scores_other_rows(spark):
    """A model that is read again from its folder scores rows it never saw, in a pass of its own."""
    data = [r for r in cases.rows(60) if r[0] is not None]
    seen = [r for r in data if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    blocks, n = lm.as_blocks(cases.table(spark, seen), F.lit(True))
    model, *_ = lm.learn(blocks, n, 4)
    again = lm.Model.load(spark, model.folder)
    got = lm.score_with(cases.table(spark, data), again).collect()
    assert all(r.held_out for r in got)
    want = [(w[0], True, *w[2:]) for w in brute([(r[0], r[1]) for r in data])]
    same(got, want)


def test_repeated_texts_score_higher(spark):
    """A held-out text that training has once more stands out from one that it lacks."""
    rng = random.Random(3)
    row = cases.rows()[0][2:]
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 1]
    texts = {k: cases.prose(rng, 60) for k in range(400)}
    for k in held[::2]:
        texts[1000 + k if zlib.crc32(str(1000 + k).encode()) % 5 != 1 else 5000] = texts[k]
    out = {r.doc_id: r.score / r.n_tokens for r in lm.score(cases.table(spark, [(k, t, *row) for k, t in texts.items()]), fold_of("doc_id", 5) != 1).collect()}
    twice = [out[k] for k in held[::2] if 1000 + k in texts]
    once = [out[k] for k in held[1::2]]
    assert min(twice) > max(once)


def test_empty_table_and_no_training_rows(spark):
    docs = cases.table(spark)
    assert lm.score(docs.limit(0), fold_of("doc_id", 5) != 1).collect() == []
    rows = lm.score(docs.where("doc_id = 3"), fold_of("doc_id", 5) == 9).collect()
    assert (rows[0].n_known, rows[0].train_tokens, rows[0].score) == (0, 0, 0.0)
