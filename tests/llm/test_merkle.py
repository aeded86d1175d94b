"""The manifest against trees built by hand, and the forest's merge as a monoid."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from orbitile.llm import merkle
from orbitile.llm.common import fold_of

from . import cases


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    found, path = [], []
    for level in tree[:-1]:
        run, slot = level[i - i % 8 : i - i % 8 + 8], i % 8
        found.append((run, slot))
        path += run[:slot] + run[slot + 1 :]
        i //= 8
    return found, path


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = [levels([leaf(r) for r in of[x]]) for x in langs]
    above = levels([t[-1][0] for t in trees])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(of[x]):
            runs, path = siblings(trees[k], i)
            more, rest = siblings(above, k)
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf((*r[:4], None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for run, slot in runs + more:
                node = digest([*run[:slot], node, *run[slot + 1 :]])
            out.append((r[0], leaf(r), trees[k][-1][0], above[-1][0], digest(path + rest), node, node == above[-1][0]))
    return out


def proofs(spark, rows, **options):
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    docs = docs.withColumns({"key": F.lit("own"), "leaf": F.lit(1), "by": F.lit(2)})  # names that the operator uses inside
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(map(tuple, merkle.prove(merkle.build(docs, seen={"text": lowered}, when=fold_of("doc_id", 3) == 0, **options)).collect()), key=str)


def narrow(data):
    return [(r[0], r[3], r[2], r[4], r[1]) for r in data]


@pytest.mark.parametrize("n, block_levels", [(1, 4), (130, 2), (400, 1)])
def test_against_plain_trees(spark, monkeypatch, n, block_levels):
    """Trees of one leaf to several levels above their blocks, with repeated rows, null ids and null languages."""
    monkeypatch.setattr(merkle, "NODES_PER_TASK", 5)
    monkeypatch.setattr(merkle, "FAN_IN", 2)
    rng = random.Random(n)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en", "en", "de", None, "é"]), i, rng.choice(["Text", "lower", "", None]) ) for i in range(n)]
    if n > 100:
        rows += [rows[3], rows[3], (None, None, None, None, None), (None, "a", "en", 1, "B"), (5, "other", "en", 2, "Z")]
        rows += [(10_000 + k, None, f"lang{k}", 1, "X") for k in range(70 if n == 400 else 12)]
    assert proofs(spark, rows, block_levels=block_levels) == sorted(brute(rows), key=str)


def test_awkward_rows(spark):
    rows = narrow(cases.rows())
    assert proofs(spark, rows) == sorted(brute(rows), key=str)
    assert proofs(spark, []) == []


def test_merge_in_any_order_and_grouping():
    rng = random.Random(2)
    sizes = [1, 8, 9, 70, 513]
    trees = [levels([digest([f"{t}-{i}"]) for i in range(n)]) for t, n in enumerate(sizes)]
    root = levels([t[-1][0] for t in trees])[-1][0]
    nodes = [(t, n, 0, i, trees[t][0][i]) for t, n in enumerate(sizes) for i in range(n)]
    for _ in range(5):
        rng.shuffle(nodes)
        forests = []
        for k in range(7):
            f = merkle.Forest(len(sizes))
            for node in nodes[k::7]:
                f.add(*node)
            forests.append(f)
        while len(forests) > 1:
            a, b = rng.sample(range(len(forests)), 2)
            merged = forests[a].merge(forests[b])
            forests = [f for k, f in enumerate(forests) if k not in (a, b)] + [merged]
        assert forests[0].root == root and not forests[0].open


def test_a_range_leaves_few_nodes():
    """A forest of consecutive leaves holds at most the edges of its range, whatever its length."""
    f = merkle.Forest(1)
    for i in range(1_003, 60_003):
        f.add(0, 10**6, 0, i, f"{i}")
    assert sum(map(len, f.open.values())) <= 2 * 7 * merkle.height(10**6)
