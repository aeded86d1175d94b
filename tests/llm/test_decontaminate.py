import random
import re

import numpy as np
import pytest

from orbitile.llm import decontaminate as dc

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[p : p + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= ids
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def planted(seed=3):
    rng = random.Random(seed)
    items = [(k, cases.prose(rng, rng.choice([3, 9, 10, 11, 40]))) for k in range(25)] + [(7, "Solo"), (None, cases.prose(rng, 15)), (30, ""), (31, None), (10, cases.prose(rng, 20))]
    data = cases.rows(60)
    for k, (_, text) in enumerate(items):
        w = (text or "").split()
        cut = w[rng.randint(0, 2) :] if k % 3 == 0 else w
        data.append((1000 + k, f"{cases.prose(rng, 9)} {' '.join(cut).upper() if k % 2 else ', '.join(cut)} - {cases.prose(rng, 5)}", *data[0][2:]))
    return data, items


def test_matches(spark, monkeypatch):
    data, items = planted()
    docs, bench = cases.table(spark, data), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute([(r[0], r[1]) for r in data], items), key=str)
    assert sum(r[2] > 0 for r in want) > 15

    def have(**kwargs):
        out = dc.match(docs.repartition(3), bench, **kwargs)
        assert {"label", "score", "size"} <= set(out.columns)
        return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in out.collect()), key=str)

    assert have() == want
    monkeypatch.setattr(dc, "SHARD_CHARS", 2_000)
    assert have() == want
    assert have(block_chars=600) == want
    clean = dc.remove(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(r[2] == 0 for r in want)


def common(a, b):
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def brute_longest(docs, items):
    """{item: (words, doc, start)} over all pairs of places, and {doc: (words, start)} over all items."""
    by_item, by_doc = {}, {}
    for k, text in items:
        w = words(text)
        need = min(10, len(w))
        for i, d in docs if w else ():
            for q in range(len(d)):
                n = max((common(w[p:], d[q:]) for p in range(len(w)) if d[q] == w[p]), default=0)
                if n >= need:
                    by_doc[i] = min(by_doc.get(i, (0, 0)), (-n, q))
                    if k is not None:
                        by_item[str(k)] = min(by_item.get(str(k), (0, 0, 0)), (-n, i, q))
    return {k: (-n, i, q) for k, (n, i, q) in by_item.items()}, {i: (-n, q) for i, (n, q) in by_doc.items()}


def test_longest_matches(spark, monkeypatch):
    data, items = planted()
    data = [r for r in data if r[0] is not None and len(r[1] or "") < 20_000]
    data = list({r[0]: r for r in data}.values())
    by_item, by_doc = brute_longest([(r[0], words(r[1])) for r in data], items)
    docs, bench = cases.table(spark, data), spark.createDataFrame(items, "item_id long, text string")
    for block_chars, shard in ((4_000_000, 8_000_000), (700, 3_000)):
        monkeypatch.setattr(dc, "SHARD_CHARS", shard)
        got = dc.longest_matches(docs, bench, block_chars=block_chars).collect()
        # an id on several rows has the longest match of any of its texts
        assert {r.item_id: (r.n_match, r.doc_id, r.start) for r in got} == by_item
        got = dc.match(docs, bench, block_chars=block_chars).where("longest_match > 0").collect()
        assert {r.doc_id: (r.longest_match, r.longest_start) for r in got} == by_doc


def test_equal_items_and_a_frequent_word(spark):
    """A thousand equal items of one word that a text has thousands of times: one window, and all their ids."""
    row = cases.rows()[0][2:]
    docs = cases.table(spark, [(1, "same " * 20_000, *row), (2, "other words", *row)])
    bench = spark.createDataFrame([(k, "same") for k in range(1_000)], "item_id long, text string")
    out = {r.doc_id: r for r in dc.match(docs, bench).collect()}
    assert (out[1].n_hit, len(out[1].item_ids), out[1].longest_match) == (20_000, 1_000, 1)
    assert out[1].item_ids == sorted(str(k) for k in range(1_000)) and out[2].item_ids == []


@pytest.mark.parametrize("extra", range(1, 41))
def test_word_number_equal_to_the_number_of_word_pairs(extra):
    """The largest word number of the shard takes many values, that of the distinct word pairs among them."""
    rng = random.Random(extra)
    item = [rng.choice("abc") for _ in range(24)]
    items = [(0, " ".join(f"w{k}" for k in range(extra))), (1, " ".join(item))]
    texts = [" ".join([*rng.choices("abc", k=200), *item[3:20], *rng.choices("abc", k=200)]), " ".join(item)]
    bench = dc.Benchmark([([str(i)], t) for i, t in items])
    shard = dc.Shard(texts, bench)
    out = shard.matches()
    got = [(d, int(n), sum(b - a for a, b in out[d][0]) if d in out else 0, sorted(out[d][1]) if d in out else []) for d, n in enumerate(shard.n_words)]
    assert got == brute(list(enumerate(texts)), items)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(4)
    for _ in range(300):
        seq = np.append(rng.choice(rng.permutation(12)[: rng.integers(1, 6)], rng.integers(2, 60)), 0)
        starts = np.flatnonzero(seq)
        heads = [tuple(np.append(seq[a : a + 10], 0)) for a in dc.suffix_array(seq, starts, 10)]
        heads = [h[: h.index(0)] for h in heads]
        assert heads == sorted(heads)


def test_empty_sides(spark):
    docs, none = cases.table(spark), spark.createDataFrame([], "item_id long, text string")
    assert dc.match(docs, none).where("n_hit > 0 or size(item_ids) > 0").count() == 0
    assert dc.match(docs.limit(0), none).count() == 0
