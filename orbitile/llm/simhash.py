"""Document fingerprints: SimHash over weighted term hashes, and permuted block tables to search them.

The terms of a text are its distinct words.  Each has a hash of ``BITS`` bits that votes on every bit of
the fingerprint, for or against, with the weight of the word: the rarer it is among all documents, the more.
Document counts are kept for hashed words, so their table has a fixed size.  The share of equal bits of two
fingerprints follows the angle between the weighted texts: 1 for equal texts, about 1/2 for unrelated ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BROADCAST_ROWS, beside, materialise, packed
from .text import MIX_A, WordHasher, mix64, texts_of

#: Bits of a fingerprint, a multiple of 64.
BITS = 256
#: Bits of a word's hash that pick its place in the table of document counts.
COUNT_BITS = 16
#: Steps of a weight for each halving of a word's documents.
STEPS = 4
#: Votes are summed in blocks of this many terms, so that long texts need no more memory.
TERMS_AT_ONCE = 4_096
#: Bits in which fingerprints of near copies differ, at most.
RADIUS = 8
#: Fingerprints that a key of the block tables stands for on average, at most: more make keys longer.
PER_KEY = 32
#: Members of a key that one task compares with its queries; pairs of a tile of comparisons.
RUN_ROWS, TILE = 10_000, 65_536


def terms(text: str, hasher: WordHasher) -> np.ndarray:
    """Hashes of the distinct words of a text, in order."""
    return np.unique(hasher(list(set(text.encode("utf-8", "replace").split()))))


def _places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows, hasher = np.zeros(1 << COUNT_BITS, np.int64), 0, WordHasher()
    for b in batches:
        for text in texts_of(b["text"]):
            counts[np.unique(_places(terms(text, hasher)))] += 1
        rows += b.num_rows
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], rows))], ["place", "n"])


@dataclass(frozen=True)
class Weights:
    """The weight of a word by its place in the table of counts: whole numbers, so that votes add up exactly."""

    of_place: np.ndarray

    def fingerprint(self, hashes: np.ndarray) -> np.ndarray:
        """The bits of a text, given the hashes of its terms: those with more votes for than against."""
        votes = np.zeros(BITS)
        for k in range(0, len(hashes), TERMS_AT_ONCE):
            some = hashes[k : k + TERMS_AT_ONCE]
            words = mix64(some[:, None] + MIX_A * np.arange(1, 1 + BITS // 64, dtype=np.uint64))
            bits = np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32)
            weight = self.of_place[_places(some)].astype(np.float32)  # sums of 4,096 weights are exact in single precision
            votes += 2.0 * (weight @ bits) - weight.sum(dtype=np.float64)
        return votes > 0


def learn(docs: DataFrame) -> Weights:
    """Weights from the documents of every hashed word, over all texts.

    The driver gets one row for each place of the table, a number fixed by ``COUNT_BITS``.
    """
    found = docs.select("text").mapInArrow(_count, "place long, n long").groupBy("place").agg(F.sum("n")).collect()
    counts, n = np.ones(1 << COUNT_BITS), 1
    for place, count in found:
        if place < 0:
            n = max(1, count)
        else:
            counts[place] = count
    return Weights((1 + np.floor(STEPS * np.log2(np.maximum(1.0, n / counts)))).astype(np.int32))


def hexed(bits: np.ndarray) -> str:
    return np.packbits(bits).tobytes().hex()


def fingerprints(docs: DataFrame, weights: Weights) -> DataFrame:
    """Add ``fingerprint``, in hexadecimal, to every row, from its whole text.

    A null or empty text, or one without words, has no votes and the fingerprint 0; equal texts have equal
    fingerprints.  A column of this name is replaced; rows stay as they are.
    """

    @F.arrow_udf("string")
    def made(column: pa.Array) -> pa.Array:
        hasher = WordHasher()
        return pa.array([hexed(weights.fingerprint(terms(t, hasher))) for t in texts_of(column)], pa.string())

    return beside(docs, packed(docs, "text").withColumn("fingerprint", made(F.col("text"))), "fingerprint")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits of two fingerprints."""
    words = []
    for k in range(BITS // 64):
        # 64 bits do not fit a signed number read from text, so halves of them are compared
        for h in range(2):
            at = 16 * k + 8 * h + 1
            x, y = (F.conv(F.substring(c, at, 8), 16, 10).cast("long") for c in (a, b))
            words.append(F.bit_count(x.bitwiseXOR(y)))
    return 1.0 - sum(words[1:], words[0]) / float(BITS)


# --- neighbours in an order ------------------------------------------------------------------

EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
_FOUND = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string())]


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as many of the first code points of the following one, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edit(weights: Weights, id_type: pa.DataType):
    """Walks a sorted range: each row meets the next; the last row, and the first one's text, are left for the joint of two ranges."""
    names = ["id", *[n for n, _ in _FOUND], "first", "text"]
    kinds = [id_type, *[t for _, t in _FOUND], pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = WordHasher(), None
        first = None

        def prints(text: str) -> str:
            return hexed(weights.fingerprint(terms(text, hasher)))

        for b in batches:
            rows = []
            for doc_id, text in zip(b["id"].to_pylist(), texts_of(b["text"]), strict=True):
                own = prints(text)
                if held is None:
                    first = (doc_id, text, own)
                else:
                    edited = edited_text(held[1], text)
                    rows.append((held[0], len(held[1]), sha256(edited.encode("utf-8", "replace")).hexdigest(), held[2], prints(edited), own, None, None))
                held = (doc_id, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if held is not None:
            rows = [(held[0], len(held[1]), None, held[2], None, None, False, held[1]), (first[0], None, None, first[2], None, None, True, first[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def with_edits(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) of every row.

    The next document is that of the next smaller doc_id (nulls last, equal ids in an order of their texts);
    after the last comes the first.  Texts are shuffled once, into sorted ranges that are walked; only the last
    row of a range and the first text of the following one are joined afterwards.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    kind = rows.schema["id"].dataType.simpleString()
    walked = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(_edit(weights, to_arrow_type(rows.schema["id"].dataType)), f"id {kind}, {EDITED}, first boolean, text string")
    walked = materialise(walked.withColumn("part", F.spark_partition_id()))
    inner = walked.where("first IS NULL")
    # a number for each range that has rows; this window is as short as the list of tasks and holds no texts
    parts = walked.where("first").select("part")
    every = Window.orderBy("part")
    parts = parts.withColumns({"following": F.lead("part").over(every), "least": F.first("part").over(every)}).select("part", F.coalesce("following", "least").alias("following"))
    starts = walked.where("first").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_of"))
    joints = walked.where("NOT first").join(parts, "part").join(starts, "following")

    @F.arrow_udf("struct<edited_sha256: string, edited_fingerprint: string>")
    def edit(text: pa.Array, following: pa.Array) -> pa.Array:
        hasher = WordHasher()
        made = [edited_text(t, f) for t, f in zip(texts_of(text), texts_of(following), strict=True)]
        digests = [sha256(t.encode("utf-8", "replace")).hexdigest() for t in made]
        return pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array([hexed(weights.fingerprint(terms(t, hasher))) for t in made], pa.string())], ["edited_sha256", "edited_fingerprint"])

    joints = joints.withColumn("e", edit(F.col("text"), F.col("next_text")))
    joints = joints.select("id", "n_chars", "e.edited_sha256", "fingerprint", "e.edited_fingerprint", F.col("next_of").alias("next_fingerprint"))
    return inner.select(*joints.columns).unionByName(joints).withColumnRenamed("id", "doc_id")


# --- search ----------------------------------------------------------------------------------


def block_tables(radius: int, n: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """The blocks (first bit, end) of a fingerprint, and the sets of them that are the keys of the tables.

    With ``radius`` + k blocks, two fingerprints within the radius agree on k of them at least, so a table for
    every k blocks finds all of them.  k grows with the logarithm of the number of fingerprints, until a key
    stands for few: the plan depends on their number, what is found does not.
    """
    k = 1
    while k < 4 and n / 2.0 ** (k * BITS // (radius + k)) > PER_KEY:
        k += 1
    edges = [b * BITS // (radius + k) for b in range(radius + k + 1)]
    return list(zip(edges, edges[1:], strict=False)), list(combinations(range(radius + k), k))


PAIRS = "query string, near string, distance int"
SUMS = "query string, n_near long"


def _bits(column: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(bytes.fromhex(x) for x in column), np.uint8).reshape(-1, BITS // 8)


def _run_scan(radius: int, blocks: list[tuple[int, int]], tables: list[tuple[int, ...]], pairs: bool):
    """Walks sorted block tables: in each run of one key, queries come first and meet the others in tiles."""

    def first_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = np.unpackbits(a ^ b, axis=1)
        same = np.stack([~differ[:, lo:hi].any(axis=1) for lo, hi in blocks], axis=1)
        first = np.full(len(a), len(tables))
        for t in range(len(tables) - 1, -1, -1):
            first[same[:, list(tables[t])].all(axis=1)] = t
        return first

    def tiles(table: int, q: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, TILE // max(1, len(q)))
        qw = q.view(np.uint64)
        for k in range(0, len(m), step):
            some = m[k : k + step]
            distance = np.bitwise_count(qw[:, None, :] ^ some.view(np.uint64)[None, :, :]).sum(axis=2, dtype=np.int32)
            i, j = np.nonzero(distance <= radius)
            for at in range(0, len(i), TILE):
                a, b = i[at : at + TILE], j[at : at + TILE]
                kept = first_table(q[a], some[b]) == table
                yield a[kept], b[kept] + k, distance[a[kept], b[kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = None, []
        for b in batches:
            keys = list(zip(b["key"].to_pylist(), b["salt"].to_pylist(), strict=True))
            is_query, prints, copies = b["asked"].to_pylist(), b["fingerprint"].to_pylist(), b["copies"].to_pylist()
            out: list[tuple] = []
            start = 0
            while start < len(keys):
                end = start + 1
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if keys[start] != held:
                    held, asked = keys[start], []
                asked += [prints[k] for k in range(start, end) if is_query[k]]
                members = [k for k in range(start, end) if not is_query[k]]
                if asked and members:
                    table = held[0][0] * 256 + held[0][1]
                    weight = np.array([copies[k] for k in members], np.int64)
                    sums = np.zeros(len(asked), np.int64)
                    for i, j, d in tiles(table, _bits(asked).copy(), _bits([prints[k] for k in members]).copy()):
                        if pairs:
                            out += [(asked[x], prints[members[y]], z) for x, y, z in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)]
                        else:
                            np.add.at(sums, i, weight[j])
                    out += [] if pairs else [(x, n) for x, n in zip(asked, sums.tolist(), strict=True) if n]
                start = end
            if out:
                columns = [pa.array([r[k] for r in out], pa.string() if k < 1 + pairs else pa.int32() if pairs else pa.int64()) for k in range(2 + pairs)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "near", "distance"] if pairs else ["query", "n_near"])

    return run


def _met(fingerprints: DataFrame, queries: DataFrame | None, radius: int, pairs: bool) -> DataFrame:
    """The walk over the block tables of (fingerprint, copies), all distinct."""
    asked = fingerprints.select("fingerprint") if queries is None else materialise(queries.select("fingerprint").where("fingerprint IS NOT NULL").distinct())
    blocks, tables = block_tables(radius, fingerprints.count())

    @F.arrow_udf("array<binary>")
    def keys(column: pa.Array) -> pa.Array:
        bits = np.unpackbits(_bits(column.to_pylist()), axis=1)
        own = [np.packbits(bits[:, a:b], axis=1) for a, b in blocks]
        out = [np.concatenate([np.full((len(bits), 2), divmod(t, 256), np.uint8), *[own[b] for b in table]], axis=1) for t, table in enumerate(tables)]
        return pa.array([[x[i].tobytes() for x in out] for i in range(len(bits))], pa.list_(pa.binary()))

    of_query = asked.select("fingerprint", F.explode(keys(F.col("fingerprint"))).alias("key"))
    wanted = materialise(of_query.groupBy("key").agg(F.count("*").alias("asked")))
    few = wanted.count() <= BROADCAST_ROWS
    members = fingerprints.select("fingerprint", "copies", F.explode(keys(F.col("fingerprint"))).alias("key"))
    members = materialise(members.join(F.broadcast(wanted.select("key")) if few else wanted.select("key"), "key", "left_semi"))
    # a key of many members is split, and its queries go to every part
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / RUN_ROWS).cast("int").alias("parts"))
    sizes = materialise(sizes.where("parts > 1"))
    split = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    parts = F.coalesce("parts", F.lit(1))
    members = members.join(split, "key", "left").withColumn("salt", F.pmod(F.xxhash64("fingerprint"), parts).cast("int"))
    of_query = of_query.join(split, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = members.select("key", "salt", F.lit(False).alias("asked"), "fingerprint", "copies").unionByName(of_query.select("key", "salt", F.lit(True).alias("asked"), "fingerprint", F.lit(0).cast("long").alias("copies")))
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("asked"))
    return dealt.mapInArrow(_run_scan(radius, blocks, tables, pairs), PAIRS if pairs else SUMS)


def search(fingerprints: DataFrame, radius: int = RADIUS, *, queries: DataFrame | None = None) -> DataFrame:
    """(query, near, distance): for every query all distinct fingerprints within the radius, itself included if it is there.

    Both tables have a column ``fingerprint``; without ``queries`` each is a query, and two different ones stand
    in both directions.  Repeated ones count once, so copies make no pairs.  A pair is reported by the first
    table that it agrees in, after all its bits have been compared.
    """
    distinct = materialise(fingerprints.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("copies")))
    return _met(distinct, queries, radius, True)


def near_counts(rows: DataFrame, radius: int = RADIUS, *, queries: Column) -> DataFrame:
    """Add ``n_near`` to rows with a fingerprint: for those that are queries the number of rows, themselves
    included, whose fingerprint lies within the radius; null for others.  No pair leaves the walk, only sums.
    """
    counted = materialise(rows.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.max(queries).alias("wanted")))
    found = _met(counted.select("fingerprint", "copies"), counted.where("wanted"), radius, False)
    sums = found.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n_near").alias("n_near"))
    return rows.join(sums, "fingerprint", "left").withColumn("n_near", F.when(queries, F.col("n_near")))
