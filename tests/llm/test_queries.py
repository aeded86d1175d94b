"""The registered queries on tables of their own: their columns against plain versions of the definitions."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from orbitile.llm import langid, neardup, quality, queries, toxicity
from orbitile.llm.common import fold_of

from . import cases, test_langid, test_lm, test_neardup, test_quality, test_sharding, test_toxicity

REST = cases.rows()[0][2:]


def store(spark, folder, docs, labels=None, items=None):
    cases.table(spark, docs).write.parquet(f"{folder}/documents.parquet")
    if labels is not None:
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    if items is not None:
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold if doc_id is not None else False


def by_id(rows):
    return sorted(map(tuple, rows), key=str)


def plain_density(lexicon, text):
    """The heaviest term at every place that no exception phrase covers, one place after the other.

    A phrase covers the blank before each of its words, not that behind its last, where the next word begins.
    """
    folded = toxicity.fold(text)
    excused = [(k, k + len(p) + 1) for p in lexicon.exceptions for k in range(len(folded)) if folded.startswith(f" {p} ", k)]
    total = 0.0
    for k in range(len(folded)):
        found = [w for t, w in lexicon.weights.items() if folded.startswith(t, k)]
        if found and not any(a <= k < b for a, b in excused):
            total += max(found)
    return total / (len(folded.split()) + toxicity.BASE_WORDS)


def test_op3(spark, tmp_path):
    docs, labels = test_toxicity.corpus()
    docs += [(5000, "chocolate nitwit " * 30 + "nitwit", *REST), (5001, None, *REST), (5002, "", *REST)]
    folder = store(spark, tmp_path, docs, [(i, t, 1) for i, t in labels])
    lexicon = toxicity.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert lexicon.exceptions and lexicon.weights
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, folder).collect()}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        d = plain_density(lexicon, text or "")
        assert got[i].score == pytest.approx(d / (d + lexicon.cut), abs=1e-12)
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == held(i, 5, 0)


def test_op5(spark, tmp_path):
    docs, labels = test_quality.corpus()
    docs += [(5000 + k, t, *REST) for k, t in enumerate([None, "", "a b", "x\n\nx\nx " * 9, "é" * 5000])]
    folder = store(spark, tmp_path, docs, [(i, 0, q) for i, q in labels])
    got = {r.doc_id: r for r in queries.op5_quality(spark, folder).collect()}

    def grams(text):
        data = text.encode()
        padded = data + b"\n" * quality.GRAM
        return [int.from_bytes(padded[k : k + quality.GRAM], "big") * 2654435761 % 2**32 >> (32 - quality.HASH_BITS) for k in range(len(data))]

    ratio = quality.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    for i, text, *_ in docs:
        counts = test_quality.brute(text or "")
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        own = grams(text or "")
        mean = int(sum(ratio.table[own])) / (max(1, len(own)) * quality.UNITS)
        assert ratio.means([text or ""])[0] == mean
        assert r.kept == (not r.base_failed and mean >= ratio.cut)
    # the ratio itself, from counts of all grams of all rows and of the rows labelled good
    good = {i for i, q in labels if q}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, text, *_ in docs:
        g = grams(text or "")
        raw.update(g)
        if i in good:
            trusted.update(g)
    size = 1 << quality.HASH_BITS
    base = math.log((sum(raw.values()) + size) / (sum(trusted.values()) + size))
    for b in range(0, size, 7):
        assert abs(ratio.table[b] - (math.log((trusted[b] + 1) / (raw[b] + 1)) + base) * quality.UNITS) <= 0.51


def test_op6(spark, tmp_path):
    docs = test_langid.corpus(120)
    docs += [(5000, None, "aa", *REST[1:]), (5001, "12 34", "aa", *REST[1:]), (5002, "", None, *REST[1:])]
    folder = store(spark, tmp_path, docs)
    got = {r.doc_id: r for r in queries.op6_langid(spark, folder).collect()}
    train = {lang: [t for i, t, of, *_ in docs if of == lang and t is not None and not held(i, 4, 2)] for lang in test_langid.SYLLABLES}
    for i, text, *_ in docs[::4] + docs[-3:]:
        assert got[i].held_out == held(i, 4, 2)
        if not any(map(str.isalpha, text or "")):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        bits = {lang: test_langid.brute_bits(texts, text) for lang, texts in train.items()}
        best = min(sorted(bits), key=bits.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(2.0 ** -(b - bits[best]) for b in bits.values()), rel=1e-6)


def test_op1_op7_op10(spark, tmp_path):
    docs = [r for r in test_neardup.planted() if len(r[1] or "") < 20_000]
    folder = store(spark, tmp_path, docs)
    pairs = [(r[0], r[1]) for r in docs]
    test_lm.same(queries.op1_lm(spark, folder).collect(), [(i, held(i, 5, 1), *w) for i, _, *w in test_lm.brute(pairs)])

    out = queries.op7_sharding(spark, folder).collect()
    size = {id(r): len((r[1] or "").encode()) + 16 for r in docs}
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((size[id(r)], zlib.crc32((r[1] or "").encode())) for r in docs)
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    unique = collections.Counter(r[0] for r in docs)
    want = {w[0]: w[1:] for w in test_sharding.brute(docs, 40) if unique[w[0]] == 1}
    assert {r.doc_id: (r.shard, r.slot) for r in out if unique[r.doc_id] == 1} == want

    got = by_id((r.doc_id, r.n_shingles, r.component_id) for r in queries.op10_neardup(spark, folder).collect())
    assert got == by_id(test_neardup.brute(pairs))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in queries.op10_neardup(spark, folder).collect())
    assert neardup.PERCENT == 85


def test_op2_and_op9(spark, tmp_path):
    from . import test_decontaminate, test_mixing

    docs, items = test_decontaminate.planted()
    folder = store(spark, tmp_path, docs, items=items)
    out = queries.op2_decontaminate(spark, folder).collect()
    want = test_decontaminate.brute([(r[0], r[1]) for r in docs], items)
    assert by_id((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out) == by_id((i, n, hit, len(ids), hit > 0) for i, n, hit, ids in want)
    assert all((r.longest_match > 0) == r.contaminated and (r.longest_start is None) == (not r.contaminated) for r in out)

    out = queries.op9_mixing(spark, folder).collect()
    sizes = collections.defaultdict(int)
    for r in docs:
        sizes[r[3]] += len(test_quality.W.findall(r[1] or ""))
    targets = test_mixing.brute_targets(dict(sizes))
    assert {round(r.target, 6) for r in out} == {round(t, 6) for t in targets.values()}
    assert sum(r.taken for r in out) == pytest.approx(sum(targets.values()), abs=2)
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)


def test_fold_of_matches_the_contract(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 7, -3, 10**12, None)], "doc_id long")
    assert [r[1] for r in rows.select("doc_id", fold_of("doc_id", 5)).collect()] == [zlib.crc32(str(k).encode()) % 5 for k in (0, 7, -3, 10**12)] + [-1]


def test_plain_trees_are_those_of_the_definition():
    """Merged counts of several texts make the same tree as one dictionary."""
    texts = [r[1] for r in test_langid.corpus(6)]
    codes = np.concatenate([langid.grams(langid.PAD + langid.as_bytes(t)) for t in texts])
    keys, n = np.unique(codes, return_counts=True)
    tree = langid.ContextTree(keys, n.astype(float))
    assert langid.code_lengths(texts[:2], [tree])[:, 0] == pytest.approx([test_langid.brute_bits(texts, t) for t in texts[:2]])


@pytest.mark.parametrize("seed", range(3))
def test_hits_in_one_sweep(seed):
    """Overlapping exception phrases and terms against the plain rule."""
    rng = random.Random(seed)
    words = "bad worse good mood bado".split()
    lexicon = toxicity.Lexicon({" bad": 1.0, " worse ": 2.0, " bado ": 1.5}, ("good bad", "bad mood", "mood worse"), 1.0)
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        assert lexicon.density(text) == pytest.approx(plain_density(lexicon, text))
