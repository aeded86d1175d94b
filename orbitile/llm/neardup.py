"""Near-duplicate documents by a multi-index Hamming join of min-hash signatures.

A document's signature is SLOTS min-hashes of BITS bits each.  Two sets of similarity s differ
in a slot with probability 1 - s at most; ``distance_of`` gives the differing slots to allow for
a threshold, so that a link is missed with a chance of at most MISSED (0.85: distance 19 and
7.6e-6; 0.8: 23 and 3.3e-6).  Cut into ``parts_of`` that distance, two signatures within it
agree, by the pigeonhole principle, up to ERRORS slots in at least one part: every way to leave
ERRORS slots out of every part makes a key, and all such pairs share a key.  Each link is
confirmed on the full shingle sets at the same threshold.

Equal sets are one node from the start.  The nodes that share keys are compared in bounded
blocks by incidence matrices, which return spanning forests: no list of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, packed, unpacked
from .text import WordHasher, chunks, mix64, texts_of

SHINGLE = 5
#: Links have 100 * intersection >= percent * union; this is the percent if none is given.
PERCENT = 85
SLOTS, BITS = 48, 16
ERRORS = 1
#: The chance that a link at the threshold has no key may not exceed this.
MISSED = 1e-5


def distance_of(percent: int) -> int:
    """The smallest distance a plan can hold that a pair of this similarity exceeds with a chance of MISSED at most."""
    differ = 1 - percent / 100
    for distance in range(ERRORS, SLOTS, ERRORS + 1):
        if sum(comb(SLOTS, k) * differ**k * (1 - differ) ** (SLOTS - k) for k in range(distance + 1, SLOTS + 1)) <= MISSED:
            # with more parts some would have no slot left for a key
            if parts_of(distance) * (ERRORS + 1) <= SLOTS:
                return distance
    raise ValueError(f"{SLOTS} slots are too few for {percent} percent")


def parts_of(distance: int) -> int:
    return distance // (ERRORS + 1) + 1


MAX_DISTANCE = distance_of(PERCENT)
CHUNK = 1_000_000
DESCRIBED = "struct<n_shingles: bigint, h1: bigint, h2: bigint, sig: binary>"
#: Nodes in a block, and columns of an incidence matrix at a time.
BLOCK, SLAB = 512, 8192

_random = np.random.RandomState(10)
MULTIPLY = _random.randint(0, 2**63, SLOTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.randint(0, 2**63, SLOTS, dtype=np.int64).astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str], hasher: WordHasher) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [t.encode("utf-8", "replace").lower().split() for t in texts]
    h = mix64(hasher([w for ws in words for w in ws]))
    n = max(0, len(h) - SHINGLE + 1)
    window = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        window = window * _STEP + h[k : k + n]
    window = mix64(window)
    out, at = [], 0
    for ws in words:
        if len(ws) >= SHINGLE:
            out.append(np.unique(window[at : at + len(ws) - SHINGLE + 1]))
        else:
            whole = np.uint64(len(ws))
            with np.errstate(over="ignore"):
                for x in h[at : at + len(ws)]:
                    whole = whole * _STEP + x
            out.append(mix64(np.array([whole] if ws else [], np.uint64)))
        at += len(ws)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The min-hashes of a set, BITS bits of each."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[k : k + 2048, None] * MULTIPLY + ADD).min(axis=0))
    return (mix64(least) >> np.uint64(64 - BITS)).astype(np.uint16)


def _key_plan(percent: int) -> list[tuple[int, np.ndarray]]:
    """Number of each key and the slots it reads."""
    parts = np.array_split(np.arange(SLOTS), parts_of(distance_of(percent)))
    return list(enumerate(np.setdiff1d(p, out) for p in parts for out in combinations(p, ERRORS)))


def signature_keys(signatures: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All keys of each signature (rows): equal for signatures that agree in the slots of one key."""
    keys = []
    for number, slots in _key_plan(percent):
        key = np.full(len(signatures), number + 1, np.uint64) * _STEP
        for s in slots:
            key = mix64(key ^ signatures[:, s].astype(np.uint64)) + _STEP
        keys.append(key)
    return np.stack(keys, axis=1)


def _described(column: pa.Array) -> pa.Array:
    texts, hasher, rows = texts_of(column), WordHasher(), []
    for start, end in chunks(texts, CHUNK):
        for s in shingle_sets(texts[start:end], hasher):
            a, b = mix64(s).sum(dtype=np.uint64), mix64(s ^ _STEP).sum(dtype=np.uint64)
            rows.append((len(s), int(a.astype(np.int64)), int(b.astype(np.int64)), signature(s).tobytes() if len(s) else None))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["n_shingles", "h1", "h2", "sig"])


def _keys_of(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        signatures = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint16).reshape(-1, SLOTS)
        keys = signature_keys(signatures, percent)
        nid = np.repeat(np.asarray(b["nid"]), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nid)], ["key", "nid"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node it reaches.

    Alternates the large-star and small-star contractions until the edges are stars.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first())

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    now = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct())
        before, now = now, state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets, by products of incidence matrices."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n[column] > 1  # a shingle of one set is in no intersection
    doc, column = doc[common], (np.cumsum(n > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        here = slice(*np.searchsorted(column, (first, first + SLAB)))
        slab = np.zeros((len(sets), SLAB), np.float32)
        slab[doc[here], column[here] - first] = 1.0
        total += slab @ slab.T
    total[np.arange(len(sets)), np.arange(len(sets))] = [len(s) for s in sets]
    return total.astype(np.int64)


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs that connect all linked ones of a few sets: fewer than there are sets."""
    both = _intersections(sets)
    size = both.diagonal()
    linked = 100 * both >= percent * (size[:, None] + size - both)
    edges, new = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        queue = [start] if new[start] else []
        new[start] = False
        while queue:
            x = queue.pop()
            near = np.flatnonzero(linked[x] & new)
            new[near] = False
            edges += [(x, int(y)) for y in near]
            queue += near.tolist()
    return edges


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Edges within each run of rows of one ball, or of one pair of blocks of a large ball."""
    hasher = WordHasher()
    rows = (r for b in batches for k in range(0, b.num_rows, 64) for r in zip(*(b[c].slice(k, 64).to_pylist() for c in ("g", "nid", "text")), strict=True))
    for _, found in groupby(rows, key=lambda r: r[0]):
        ids, texts = zip(*((r[1], r[2]) for r in found), strict=True)
        if len(ids) > 1:
            edges = [(ids[x], ids[y]) for x, y in forest(shingle_sets(list(texts), hasher), percent)]
            columns = list(zip(*edges, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _links(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame | None:
    """Confirmed edges that connect all nodes linked by a pair within the signature distance.

    The nodes of a key and those of all other keys with the same smallest node form a ball;
    every pair that shares a key is inside one.  A ball of more than BLOCK nodes is cut into
    blocks by a hash of the node, and each pair of blocks is one unit of work, so that no task
    holds more than two blocks.  A unit returns a forest, never its pairs.  The joins are
    merge joins at every size: broadcasting the small side would only suit small inputs.
    """
    keys = materialise(nodes.select("nid", "sig").mapInArrow(partial(_keys_of, percent=percent), "key long, nid long"))
    hubs = keys.groupBy("key").agg(F.min("nid").alias("hub"), F.max("nid").alias("last")).where("hub < last").select("key", "hub")
    balls = materialise(keys.join(hubs.hint("merge"), "key").select("hub", "nid").distinct())
    if balls.isEmpty():
        return None
    sizes = balls.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    units = balls.join(sizes, "hub").withColumn("i", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    units = units.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("hub", F.least("i", "j"), F.greatest("i", "j"))
    units = units.select(unit.alias("g"), "nid").join(texts.hint("merge"), "nid")
    return units.repartition("g").sortWithinPartitions("g").mapInArrow(partial(_linked, percent=percent), "a long, b long")


def group(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """rid, doc_id, n_shingles, component_id, kept and representative; and the packed rows of ``docs`` with that number as __rid.

    Texts are linked from a similarity of ``percent`` on, ends included.
    Lower-cased (A-Z) words make five-word shingles; a text of fewer words is one shingle; a
    text without words, null included, has none and is linked with nothing.  component_id is
    the smallest doc_id of the group (null ids apart, null if all are), kept says that the row
    has that id, representative holds for exactly one such row of each group.  Equal texts,
    repeated rows included, are always in one group.  Other columns, whatever their names, stay
    as they are.
    """
    work = packed(docs, F.arrow_udf(_described, DESCRIBED)(F.col("text")).alias("__d"), F.monotonically_increasing_id().alias("__rid"))
    work = materialise(work)
    doc = F.col("__doc")
    facts = ["n_shingles", "h1", "h2"]
    described = work.select(F.col("__rid").alias("rid"), doc["doc_id"].alias("doc_id"), "__d.*")
    with_words = described.where(F.col("n_shingles") > 0)
    firsts = with_words.groupBy(*facts).agg(F.min("rid").alias("nid"))
    members = with_words.select("rid", "doc_id", *facts, "sig").join(firsts.hint("merge"), facts)
    members = members.withColumn("sig", F.when(F.col("rid") == F.col("nid"), F.col("sig")))
    members = materialise(members.select("rid", "doc_id", "nid", "n_shingles", "sig"))

    edges = _links(members.where(F.col("rid") == F.col("nid")), work.select(F.col("__rid").alias("nid"), doc["text"].alias("text")), percent)
    grouped = members.select("rid", "doc_id", "n_shingles", "nid")
    if edges is not None:
        roots = components(edges)
        grouped = grouped.join(roots, grouped["nid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "nid")).drop("node", "nid")
    else:
        grouped = grouped.withColumnRenamed("nid", "root")
    alone = described.where(F.col("n_shingles") == 0).select("rid", "doc_id", "n_shingles", F.col("rid").alias("root"))
    grouped = materialise(grouped.select("rid", "doc_id", "n_shingles", "root").unionByName(alone))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    names = grouped.groupBy("root").agg(first).select("root", F.col("first.doc_id").alias("component_id"), F.col("first.rid").alias("__first"))
    out = grouped.join(names, "root").drop("root")
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    out = out.withColumn("representative", F.col("rid") == F.col("__first")).drop("__first")
    return out, work


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept; see ``group``."""
    return group(docs, percent)[0].drop("rid", "representative")


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``."""
    grouped, work = group(docs, percent)
    stay = grouped.where("representative").select(F.col("rid").alias("__rid"))
    return unpacked(work.join(stay, "__rid"))
