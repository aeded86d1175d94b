"""Near words and forms against plain versions."""

import collections
import random
import re
import zlib

import pytest

from orbitile.llm import spelling

from . import cases


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return sorted(out, key=str)


def plain_counts(docs, damage=199):
    words = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            words[run[:k] + run[k + 1 :] if h % damage == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def grouped(spark, words, **options):
    table = spark.createDataFrame(list(words.items()), "word string, n int")
    return sorted(map(tuple, spelling.group_variants(table, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def vocabulary(seed, n, letters="abcé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n)}
    return {w: int(5 ** (1 + 4 * rng.random())) for w in words}


@pytest.mark.parametrize("run_rows", [2, 5, 512])
def test_forms(spark, run_rows):
    """Dense vocabularies, whose runs are subdivided to the last code point or not at all."""
    words = vocabulary(run_rows, 350)
    assert grouped(spark, words, run_rows=run_rows) == brute(words)


def test_a_hot_half(spark):
    """All words share their first half, a third of them also their last."""
    rng = random.Random(5)
    words = {"abcdefgh" + "".join(rng.choice("xyz") for _ in range(rng.randint(7, 9))): rng.randint(5, 5000) for _ in range(250)}
    words |= {"abcdefgh" + "".join(rng.choice("xyzäö") for _ in range(3)) + "klmno": rng.randint(5, 5000) for _ in range(120)}
    assert grouped(spark, words, run_rows=8) == brute(words)


def test_long_chain_and_short_words(spark):
    words = {"letters"[:k] + "x" * (7 - k) + "qqqqqq": 5 ** (k + 1) for k in range(8)} | {"a": 50, "ab": 5, "b": 1, "äb": 300}
    got = {r[0]: r for r in grouped(spark, words)}
    assert got["xxxxxxxqqqqqq"][2] == "lettersqqqqqq"
    wanted = {r[0]: r for r in brute({w: n for w, n in words.items() if len(w) > 1})}
    assert {w: r for w, r in got.items() if len(w) > 1} == wanted and got["a"][4] == 0
    assert grouped(spark, {}) == []


def test_counts(spark):
    docs = [(r[0], r[1]) for r in cases.rows()]
    docs += [(k, "Ältere STRASSE straße ÀÉÿ×÷ naïve-Word's " * (k % 5)) for k in range(1000, 1300)]
    table = cases.table(spark, [(i, t, *cases.rows()[0][2:]) for i, t in docs])
    got = {r.word: r.n for r in spelling.count_words(table, damage=7).collect()}
    assert got == plain_counts(docs, 7) and len(got) > 20
    assert spelling.count_words(table.limit(0)).count() == 0
