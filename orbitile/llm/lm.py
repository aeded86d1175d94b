"""Language-model scoring with Elias-Fano n-gram tries.

``learn`` counts words and trigrams of the training rows and keeps the model as tables in the shared
folder: for every shard a level of words with their numbers and counts, from which their probabilities and
weights follow, and a three-level trie whose quantised values are the smoothed shares of pairs and triples and
the weights that pairs leave to shorter contexts.  ``score_blocks``
is a pass of its own that can follow at any time, over any rows (of the rows just learned it asks only what ``learn``
hasn't answered): tasks map the trie of their shard and
answer the paths that blocks of texts ask for.

The corpus is turned once into blocks: the documents of a batch as numbers of the block's own words.
Words go, once per block, to word shards; distinct paths of three words go, once per block, to
the shard of their first word: those of training texts to be counted and answered, all others to be answered.  A frequent first word is spread by its second, and a frequent pair, whose
exact count all shards know, by its third.  Those pairs, up to eight for every shard, pass through the driver and
stand in the closures of the tasks; paths do not.  Every block sends a message to each shard that it has paths for.

P(w | uv) = c(uvw) / (c(uv) + t(uv)) + t(uv) / (c(uv) + t(uv)) * P(w | v), in the same way P(w | v)
from P(w), where t(h) = c(h) ** GROWTH stands for the kinds of words after h.  P(w) discounts every
word's count by d = n1 / (n1 + 2 n2) and gives what is freed to the unknown word, one class as in the
base.  All probabilities of a context add up to 1 (before quantisation to 16 bits).
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import discard, materialise, shared_dir
from .eliasfano import Quantised, Trie
from .text import WordHasher, chunks, mix64, texts_of

#: Exponent of the growth of kinds of successors with a context's count.
GROWTH = 0.8
#: Text bytes to one shard, and characters in a block, at most (a longer text is a block of its own).
SHARD_BYTES, BLOCK_CHARS = 8_000_000, 8_000_000
#: Words, and pairs, with more than this share of a shard's tokens are spread over the shards.
HOT_SHARE = 0.25
#: Hash of the token that ends a text: a blank is in no word.
END = int(WordHasher()([b"\n"])[0])
#: Numbers: 0 is a word that training lacks; 1 stands before a text as a context, and behind it ends a path; words follow.
UNKNOWN, EDGE, FIRST_WORD = 0, 1, 2

#: Numbers of pairs and paths stay below this.
LARGEST = 2**62

ROWS = "block long, kind string, shard int, payload binary, n long, v long, n1 long, n2 long"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of their bytes, which compress better than the numbers, one behind the other."""
    heads = b"".join(struct.pack("<3sQ", a.dtype.str[-3:].encode().rjust(3, b"|"), a.size) for a in arrays)
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<B", len(arrays)) + heads + planes)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    heads = [struct.unpack_from("<3sQ", raw, 1 + 11 * k) for k in range(raw[0])]
    at, out = 1 + 11 * len(heads), []
    for kind, n in heads:
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        at += n * dtype.itemsize
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*((*r, *[0] * (8 - len(r))) for r in rows), strict=True)) or [[]] * 8
    types = (pa.int64(), pa.string(), pa.int32(), pa.binary(), *[pa.int64()] * 4)
    names = [c.split()[0] for c in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with equal keys; the rows must be sorted by it."""
    rows = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
    for value, found in groupby(rows, key=lambda r: r[key]):
        yield value, list(found)


def _small(n: np.ndarray) -> np.ndarray:
    """Counts and numbers in as few bytes as hold them all."""
    most = int(n.max()) if n.size else 0
    return n.astype(np.uint8 if most < 256 else np.uint32 if most < 2**32 else np.uint64)


def _kinds(count: np.ndarray) -> np.ndarray:
    return np.power(np.maximum(count, 0).astype(np.float64), GROWTH)


def _rest(count: np.ndarray) -> np.ndarray:
    """The weight that contexts of these counts leave to shorter ones; all of it if never seen."""
    kinds = _kinds(count)
    return np.where(count > 0, kinds / np.maximum(count + kinds, 1e-300), 1.0)


def _parts(of: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(of, kind="stable")
    return np.split(order, np.cumsum(np.bincount(of, minlength=n))[:-1])


class Block:
    """Documents of one batch: sorted word hashes, and tokens as numbers of those words."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, train: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray, has_id: np.ndarray):
        self.words, self.tokens, self.sizes = words, tokens.astype(np.int32), sizes.astype(np.int64)
        self.train, self.ids, self.id_sizes, self.has_id = train.astype(bool), ids, id_sizes, has_id.astype(bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.end = int(self.tokens[self.starts[0] + self.sizes[0] - 1]) if len(sizes) else 0  # every text ends

    @classmethod
    def of_texts(cls, texts: list[str], train: list[bool], ids: list[str | None], hasher: Callable) -> Block:
        split = [t.encode("utf-8", "replace").lower().split() for t in texts]
        sizes = np.array([len(ws) + 1 for ws in split], np.int64)
        hashes = np.full(sizes.sum(), END, np.uint64)
        inside = np.ones(len(hashes), bool)
        inside[np.cumsum(sizes) - 1] = False
        hashes[inside] = hasher([w for ws in split for w in ws])
        number, words = pd.factorize(hashes)
        order = np.argsort(words, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names = [(i or "").encode() for i in ids]
        id_bytes, id_sizes = np.frombuffer(b"".join(names), np.uint8), np.array([len(i) for i in names], np.uint32)
        return cls(words[order], place[number], sizes, np.array(train, bool), id_bytes, id_sizes, np.array([i is not None for i in ids], bool))

    def packed(self) -> bytes:
        """Compact form, with words numbered by falling frequency."""
        order = np.argsort(-np.bincount(self.tokens, minlength=len(self.words)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        rest = (self.train.astype(np.uint8), self.ids, self.id_sizes, self.has_id.astype(np.uint8))
        return pack(self.words[order], place[self.tokens], self.sizes.astype(np.uint32), *rest)

    @classmethod
    def of_packed(cls, payload: bytes) -> Block:
        words, tokens, *rest = unpack(payload)
        order = np.argsort(words, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return cls(words[order], place[tokens], *rest)

    def of_train(self) -> np.ndarray:
        return np.repeat(self.train, self.sizes)

    def doc_ids(self) -> list[str | None]:
        data, ends = self.ids.tobytes(), np.cumsum(self.id_sizes.astype(np.int64))
        return [data[e - n : e].decode() if ok else None for e, n, ok in zip(ends.tolist(), self.id_sizes.tolist(), self.has_id.tolist(), strict=True)]

    def word_shards(self, n_shards: int) -> list[np.ndarray]:
        """Numbers of the block's words that belong to each word shard."""
        return _parts((self.words % np.uint64(n_shards)).astype(np.int64), n_shards)


class Paths:
    """The distinct paths of three words in a block, by the model's numbers.

    A text of n tokens has n + 1 of them: each token behind the two before it, and last the mark
    that ends the text, for the sake of the pair before it.
    """

    def __init__(self, block: Block, numbers: np.ndarray, counts: np.ndarray, model: Model):
        self.block, self.counts, self.model = block, counts, model
        n, k = len(block.tokens), len(block.sizes)
        self.at = np.arange(n) + np.repeat(np.arange(k), block.sizes)  # places of tokens among tokens and marks
        begins = block.starts + np.arange(k)
        edge = len(block.words)
        third = np.full(n + k, edge, np.int64)
        third[self.at] = block.tokens
        second, first = np.empty_like(third), np.empty_like(third)
        second[1:], first[2:] = third[:-1], third[:-2]
        second[begins] = first[begins] = edge
        first[(begins + 1)[begins + 1 < n + k]] = edge
        of_train = np.repeat(block.train, block.sizes + 1)
        names, rank = np.unique(np.append(numbers, np.uint64(EDGE)), return_inverse=True)
        size = len(names)
        pairs, pair_at = rank[first] * size + rank[second], None
        if size**3 >= LARGEST:  # a path's number has no room for three words
            pair_at, pairs = np.unique(pairs, return_inverse=True)
        path, self.of = np.unique(pairs * size + rank[third], return_inverse=True)
        pair = path // size if pair_at is None else pair_at[path // size]
        self.seen = np.bincount(self.of, weights=of_train, minlength=len(path)).astype(np.int64)
        self.words = names[pair // size], names[pair % size], names[path % size]
        self.c1 = self._by_name(names, rank, counts)[pair // size]

    def asking(self, which: str) -> Asking:
        """The paths of training texts (``train``), the others that training may know (``rest``), or both (``all``)."""
        known = (self.words[0] != UNKNOWN) & (self.words[1] != UNKNOWN)
        wanted = {"train": self.seen > 0, "rest": known & (self.seen == 0), "all": known}[which]
        return Asking(self, np.flatnonzero(wanted))

    def _by_name(self, names: np.ndarray, rank: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Counts as contexts by rank: as many texts begin as end."""
        out = np.zeros(len(names), np.int64)
        np.maximum.at(out, rank[:-1], counts)
        out[names == UNKNOWN] = 0
        out[rank[-1]] = counts[self.block.end]
        return out


class Asking:
    """Some of the paths of a block, in the order of their shards."""

    def __init__(self, paths: Paths, wanted: np.ndarray):
        shard = paths.model.shard_of(*(w[wanted] for w in paths.words), paths.c1[wanted])
        order = np.argsort(shard, kind="stable")
        self.order, self.shard = wanted[order], shard[order]
        self.w1, self.w2, self.w3 = (w[self.order] for w in paths.words)
        self.seen = paths.seen[self.order]
        new = np.ones(len(self.order), bool)
        new[1:] = (self.w1[1:] != self.w1[:-1]) | (self.shard[1:] != self.shard[:-1])
        self.new1, self.new2 = new, new.copy()
        self.new2[1:] |= self.w2[1:] != self.w2[:-1]

    def messages(self, *, with_counts: bool) -> Iterator[tuple[int, bytes]]:
        """For each shard its words, pairs below them and third words below those (and the counts of those paths)."""
        at1, at2 = np.flatnonzero(self.new1), np.flatnonzero(self.new2)
        n2, n1 = np.diff(np.append(at2, len(self.order))), np.diff(np.append(np.searchsorted(at2, at1), len(at2)))
        arrays = [_small(self.w1[at1]), _small(n1), _small(self.w2[at2]), _small(n2), _small(self.w3)]
        levels = [0, 0, 1, 1, 2]
        if with_counts:
            arrays.append(_small(self.seen))
            levels.append(2)
        shards, first = np.unique(self.shard, return_index=True)
        cuts = [np.searchsorted(at1, np.append(first, len(self.order))), np.searchsorted(at2, np.append(first, len(self.order))), np.append(first, len(self.order))]
        for k, s in enumerate(shards):
            yield int(s), pack(*[a[cuts[level][k] : cuts[level][k + 1]] for a, level in zip(arrays, levels, strict=True)])


class Asked:
    """The messages of all blocks to one shard, laid out path by path."""

    def __init__(self, payloads: list[bytes]):
        got = [unpack(p) for p in payloads]
        joined = [np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.uint8) for k in range(len(got[0]) if got else 6)]
        self.u1, self.u2, self.w3 = (joined[k].astype(np.int64) for k in (0, 2, 4))
        self.n1, self.n2 = joined[1].astype(np.int64), joined[3].astype(np.int64)
        self.seen = joined[5].astype(np.int64) if len(joined) > 5 else None
        self.ends = [np.cumsum([len(g[k]) for g in got]) for k in (2, 4)]
        self.of1 = np.repeat(np.arange(len(self.u1)), self.n1)  # first word of each pair
        self.of2 = np.repeat(np.arange(len(self.u2)), self.n2)  # pair of each path


@dataclass
class Levels:
    """Words, words behind them and words behind those pairs, each but the first with the place of what it stands behind."""

    first: np.ndarray
    of_first: np.ndarray
    second: np.ndarray
    of_second: np.ndarray
    third: np.ndarray


@dataclass
class Model:
    """A trained model: tables ``words`` and ``tries`` (shard, payload) in a folder, totals, and the frequent pairs with their counts."""

    folder: str
    n_shards: int
    n: int
    v: int
    n1: int
    n2: int
    hot: np.ndarray
    hot_counts: np.ndarray

    @property
    def discount(self) -> float:
        return self.n1 / (self.n1 + 2 * self.n2) if self.n1 and self.n2 else 0.5

    @cached_property
    def limit(self) -> float:
        """Tokens from which a word or pair is spread."""
        return HOT_SHARE * self.n / self.n_shards

    def pair_counts(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Exact counts of frequent pairs, 0 for all others."""
        key, out = pair_key(w1, w2), np.zeros(len(w1), np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            out = np.where(self.hot[at] == key, self.hot_counts[at], 0)
        return out

    def shard_of(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, c1: np.ndarray) -> np.ndarray:
        spread = np.where(c1 > self.limit, mix64(w2.astype(np.uint64) + np.uint64(7)), np.uint64(0))
        spread ^= np.where(self.pair_counts(w1, w2) > 0, mix64(w3.astype(np.uint64) + np.uint64(11)), np.uint64(0))
        return (mix64(w1.astype(np.uint64) ^ spread) % np.uint64(self.n_shards)).astype(np.int64)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        free = self.discount * self.v / self.n if self.n else 1.0
        return np.where(counts > 0, (counts - self.discount) / max(self.n, 1), free)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(ROWS).parquet(f"{self.folder}/{name}")

    def save(self, spark: SparkSession) -> None:
        """Add the totals and frequent pairs to the folder, so that ``load`` finds all."""
        rows = [(self.n_shards, self.n, self.v, self.n1, self.n2, self.hot.view(np.int64).tolist(), self.hot_counts.tolist())]
        spark.createDataFrame(rows, "n_shards int, n long, v long, n1 long, n2 long, hot array<long>, counts array<long>").write.parquet(f"{self.folder}/totals")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Model:
        r = spark.read.parquet(f"{folder}/totals").first()
        return cls(folder, r["n_shards"], r["n"], r["v"], r["n1"], r["n2"], np.array(r["hot"], np.int64).view(np.uint64), np.array(r["counts"], np.int64))


def pair_key(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    return mix64(mix64(w1.astype(np.uint64) + np.uint64(3)) ^ w2.astype(np.uint64))


class Hashes(dict):
    """The hashes of ``WordHasher`` by one look-up a word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxh3_64_intdigest(word)
        return found

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WordHasher.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, hasher = TaskContext.get().partitionId() << 32, Hashes()
    for b in batches:
        texts, train, ids = texts_of(b["text"]), b["train"].to_pylist(), b["doc_id"].to_pylist()
        for start, end in chunks(texts, BLOCK_CHARS):
            yield _rows([(number, "self", -1, Block.of_texts(texts[start:end], train[start:end], ids[start:end], hasher).packed())])
            number += 1


def as_blocks(docs: DataFrame, train: Column) -> tuple[DataFrame, int]:
    """The rows of ``docs`` (doc_id, text) as stored blocks, numbered without gaps, and how many there are.

    ``train`` tells the rows that ``learn`` counts.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    blocks = materialise(rows.mapInArrow(tokenise, ROWS))
    part = F.shiftright("block", 32)
    # one row for each task that made blocks
    sizes = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("made"))
    before = F.sum("made").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialise(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), "made"))
    numbered = blocks.withColumn("part", part).join(F.broadcast(sizes), "part")
    dense = F.col("before") + F.col("block").bitwiseAND((1 << 32) - 1)
    return numbered.withColumn("block", dense).drop("part", "before", "made"), sizes.agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]


def _exchange(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of a key in one task, one key a task: keys are numbered without gaps."""
    return df.repartitionById(max(1, n), F.col(key).cast("int")).sortWithinPartitions(key, "kind", "block", "shard")


def ask_words(n_shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "block"):
            block = Block.of_packed(rows[0]["payload"])
            counts = np.bincount(block.tokens, weights=block.of_train(), minlength=len(block.words)).astype(np.int64)
            parts = enumerate(block.word_shards(n_shards))
            yield _rows([(number, "words", s, pack(block.words[p], _small(counts[p]))) for s, p in parts if len(p)])

    return run


def _answers(asked: list[list[np.ndarray]], rows: list[dict], words: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for row, a in zip(rows, asked, strict=True):
        at = np.minimum(np.searchsorted(words, a[0]), max(0, len(words) - 1))
        known = words[at] == a[0] if len(words) else np.zeros(len(a[0]), bool)
        answer = [_small(np.where(known, x[at], 0)) if len(words) else np.zeros(len(a[0]), np.uint8) for x in (numbers, counts)]
        yield _rows([(row["block"], "known", row["shard"], pack(*answer))])


def count_words(n_shards: int) -> Callable:
    """The word level of each shard: sorted hashes, numbers by falling count, and counts; and answers to the blocks that asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            asked = [unpack(r["payload"]) for r in rows]
            words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([a[1] for a in asked]), minlength=len(words)).astype(np.int64)
            words, counts = words[counts > 0], counts[counts > 0]
            numbers = np.empty(len(words), np.int64)
            numbers[np.lexsort((words, -counts))] = FIRST_WORD + np.arange(len(words)) * n_shards + shard
            yield from _answers(asked, rows, words, numbers, counts)
            stats = (int(counts.sum()), len(counts), int((counts == 1).sum()), int((counts == 2).sum()))
            yield _rows([(-1, "level", shard, pack(words, _small(numbers), _small(counts)), *stats)])

    return run


def find_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers from the kept word level, to blocks that need not be those it was counted from."""
    for _, rows in _groups(batches, "shard"):
        levels, asking = ([r for r in rows if (r["kind"] == "level") == wanted] for wanted in (True, False))
        words, numbers, counts = unpack(levels[0]["payload"]) if levels else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield from _answers([unpack(r["payload"]) for r in asking], asking, words, numbers, counts)


def join_known(n_shards: int) -> Callable:
    """Blocks together with the model's numbers and training counts of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "block"):
            block = next(Block.of_packed(r["payload"]) for r in rows if r["kind"] == "self")
            numbers, counts, parts = np.zeros(len(block.words), np.uint64), np.zeros(len(block.words), np.int64), block.word_shards(n_shards)
            for r in rows:
                if r["kind"] == "known":
                    numbers[parts[r["shard"]]], counts[parts[r["shard"]]] = unpack(r["payload"])
            # the hashes have done their work: places in their order stand for them
            block.words = np.arange(len(block.words), dtype=np.uint64)
            yield _rows([(number, "self", -1, pack(np.frombuffer(block.packed(), np.uint8), _small(numbers), _small(counts)))])

    return run


def _known(row: dict) -> tuple[Block, np.ndarray, np.ndarray]:
    """A block and the model's numbers and training counts of its words."""
    payload, numbers, counts = unpack(row["payload"])
    return Block.of_packed(payload.tobytes()), numbers.astype(np.uint64), counts.astype(np.int64)


def frequent_pairs(share: float, wanted: np.ndarray | None = None) -> Callable:
    """(pair, n): training counts of a block's pairs, those over ``share`` of its tokens, or the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            block, numbers, _ = _known(rows[0])
            first = np.empty(len(block.tokens), np.int64)
            first[1:] = block.tokens[:-1]
            inside = np.ones(len(first), bool)
            inside[block.starts] = False
            inside &= block.of_train()
            key, n = np.unique(first[inside] * len(block.words) + block.tokens[inside], return_counts=True)
            if wanted is None:
                often = n >= max(2.0, share * len(block.tokens))
                key, n = key[often], n[often]
            pair = pair_key(numbers[key // len(block.words)], numbers[key % len(block.words)])
            if wanted is not None and len(pair):
                there = np.isin(pair, wanted)
                pair, n = pair[there], n[there]
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    return run


def ask_paths(model: Model, which: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "block"):
            asking = Paths(*_known(rows[0]), model).asking(which)
            for shard, payload in asking.messages(with_counts=which == "train"):
                yield _rows([(number, "paths", shard, payload)])

    return run


def trie_of(a: Asked, model: Model) -> tuple[bytes, Levels, np.ndarray, np.ndarray]:
    """The trie of a shard, from the counted paths of all blocks; what they ask for, once each, and where each of their pairs and paths is in that."""
    words, where1 = np.unique(a.u1, return_inverse=True)
    second, third, names = a.u2, a.w3, None
    size = 1 + max(int(x.max()) if x.size else 0 for x in (second, third))
    if size * max(len(a.u2), 1) >= LARGEST:  # a word's number is too large to stand behind a pair's
        names, of_name = np.unique(np.concatenate([second, third]), return_inverse=True)
        second, third, size = of_name[: len(second)], of_name[len(second) :], len(names)
    pairs, in_pair = np.unique(where1[a.of1] * size + second, return_inverse=True)
    paths, in_path = np.unique(in_pair[a.of2] * size + third, return_inverse=True)
    c3 = np.bincount(in_path, weights=a.seen, minlength=len(paths))
    (parent2, word2), (parent3, word3) = np.divmod(pairs, size), np.divmod(paths, size)
    if names is not None:
        word2, word3 = names[word2], names[word3]
    c2 = np.bincount(parent3, weights=c3, minlength=len(pairs))
    exact = model.pair_counts(words[parent2], word2)  # of a pair that is spread, this shard has a part only
    c2 = np.where(exact > 0, exact, c2)
    distinct, inner = Levels(words, parent2, word2, parent3, word3), word3 != EDGE
    # shares in units of their contexts, which few values occur of
    return Trie.build(words, parent2, word2, parent3[inner], word3[inner], own2=c2, rest2=_rest(c2), own3=c3[inner]), distinct, in_pair, in_path


def _search(asked: Levels, data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of pairs (two of each) and of paths, and their scale."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "trie")
        with open(path, "wb") as f:
            f.write(data)
        del data
        trie = Trie.open(path)
        node1 = trie.roots(asked.first)
        node2 = trie.children("pairs", "first", node1[asked.of_first], asked.second)
        node3 = trie.children("triples", "second", node2[asked.of_second], asked.third)
        codes = [trie.codes("own2", node2), trie.codes("rest2", node2), trie.codes("own3", node3)]
        scale = np.array([x for name in Trie.VALUES for x in (getattr(trie, name).low, getattr(trie, name).step)])
        del trie
    return codes, scale


def _answer(a: Asked, codes: list[np.ndarray], scale: np.ndarray) -> Iterator[bytes]:
    """The codes for the paths of each message, in its order."""
    for k in range(len(a.ends[0])):
        cut = [slice(e[k - 1] if k else 0, e[k]) for e in a.ends]
        yield pack(codes[0][cut[0]], codes[1][cut[0]], codes[2][cut[1]], scale)


def build_tries(model: Model) -> Callable:
    """The trie of each shard, and its answers to the messages that it was built from: those are not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            a, blocks = Asked([r["payload"] for r in rows]), [r["block"] for r in rows]
            del rows
            data, distinct, in_pair, in_path = trie_of(a, model)
            yield _rows([(-1, "trie", shard, zstandard.ZstdCompressor(level=1).compress(data))])
            (own2, rest2, own3), scale = _search(distinct, data)
            codes = [own2[in_pair], rest2[in_pair], own3[in_path]]
            for block, payload in zip(blocks, _answer(a, codes, scale), strict=True):
                yield _rows([(block, "trained", shard, payload)])

    return run


def query_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of kept tries to blocks that need not be those they were built from."""
    for shard, rows in _groups(batches, "shard"):
        asking = [r for r in rows if r["kind"] == "paths"]
        if not asking:
            continue
        a, blocks = Asked([r["payload"] for r in asking]), [r["block"] for r in asking]
        found = next((r["payload"] for r in rows if r["kind"] == "trie"), None)
        del rows, asking
        if found is None:
            empty, none = np.zeros(0, np.int64), np.zeros(0)
            data = Trie.build(empty, empty, empty, empty, empty, own2=none, rest2=none, own3=none)
        else:
            data = zstandard.ZstdDecompressor().decompress(found)
        codes, scale = _search(Levels(a.u1, a.of1, a.u2, a.of2, a.w3), data)
        for block, payload in zip(blocks, _answer(a, codes, scale), strict=True):
            yield _rows([(block, "codes", shard, payload)])


SCORES = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def add_up(model: Model, which: str) -> Callable:
    """Scores of the documents of each block from the codes that the shards answered, to training paths and to ``which``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            b, numbers, counts = _known(next(r for r in rows if r["kind"] == "self"))
            p = Paths(b, numbers, counts, model)
            asking = {"trained": p.asking("train"), "codes": p.asking(which)}
            n_paths = len(p.c1)
            rest1, own2, rest2, own3 = _rest(p.c1), np.zeros(n_paths), np.ones(n_paths), np.zeros(n_paths)
            c1 = np.maximum(p.c1, 1)
            for r in rows:
                if r["kind"] in asking:
                    got, q = unpack(r["payload"]), asking[r["kind"]]
                    here = slice(*np.searchsorted(q.shard, (r["shard"], r["shard"] + 1)))
                    v2, w2, v3 = (Quantised.values(got[k], got[3][2 * k], got[3][2 * k + 1]) for k in range(3))
                    to2, at = np.cumsum(q.new2[here]) - 1, q.order[here]
                    share, rest = v2[to2], np.where(got[1][to2] > 0, w2[to2], 1.0)
                    # the unit of a context is what it doesn't leave to shorter ones, by its own share
                    own2[at], rest2[at], own3[at] = share * (1 - rest1[at]) / c1[at], rest, v3 * (1 - rest) / np.maximum(share, 1)
            # a token's own path ends with it; the next path has the pair that ends with it
            token, after = p.of[p.at], p.of[p.at + 1]
            short = own2[after] + rest1[after] * model.unigram(counts)[b.tokens]
            score = np.log10(own3[token] + rest2[token] * short)
            base = np.log10((counts + 0.5) / (model.n + 0.5 * (model.v + 1)))[b.tokens]
            known = (counts > 0)[b.tokens].astype(np.int64)
            sums = [np.add.reduceat(x, b.starts) if len(b.starts) else x[:0] for x in (known, base, score)]
            columns = [pa.array(b.doc_ids(), pa.string()), pa.array(~b.train), pa.array(b.sizes), pa.array(sums[0]), pa.array(np.full(len(b.sizes), model.n, np.int64)), *map(pa.array, sums[1:])]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return run


def shards_for(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    return max(4, -(-int(size) // SHARD_BYTES))


def learn(blocks: DataFrame, n_blocks: int, n_shards: int) -> tuple[Model, DataFrame, DataFrame]:
    """Train on the training rows of blocks: the model, kept in a new folder of the shared one, and the blocks with what it knows of their words.

    The table of ``blocks`` is dropped once that of the second result holds all of it.  The third result has the
    tries' answers to the paths of the training texts, which are at their shards already.
    """
    spark = blocks.sparkSession
    folder = f"{shared_dir(spark)}/model"
    counted = materialise(_exchange(blocks.mapInArrow(ask_words(n_shards), ROWS), "shard", n_shards).mapInArrow(count_words(n_shards), ROWS))
    level = counted.where(F.col("kind") == "level")
    level.write.parquet(f"{folder}/words")
    totals = level.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2")]).first()
    known = _with_words(blocks, counted.where(F.col("kind") == "known"), n_blocks, n_shards)
    discard(counted)
    model = Model(folder, n_shards, *totals, np.zeros(0, np.uint64), np.zeros(0, np.int64))

    # a pair that is in no list of a block, or below half the limit in those, has about twice the limit at most
    share = HOT_SHARE / n_shards
    schema = "pair long, n long"
    often = known.mapInArrow(frequent_pairs(share), schema).groupBy("pair").agg(F.sum("n").alias("n"))
    wanted = np.array([r["pair"] for r in often.where(F.col("n") > model.limit / 2).collect()], np.int64).view(np.uint64)
    if len(wanted):
        exact = known.mapInArrow(frequent_pairs(share, np.sort(wanted)), schema).groupBy("pair").agg(F.sum("n").alias("n")).collect()
        keys, counts = np.array([r["pair"] for r in exact], np.int64).view(np.uint64), np.array([r["n"] for r in exact], np.int64)
        order = np.argsort(keys)
        model.hot, model.hot_counts = keys[order], counts[order]
    model.save(spark)
    paths = known.mapInArrow(ask_paths(model, "train"), ROWS)
    tries = _exchange(paths, "shard", n_shards).mapInArrow(build_tries(model), ROWS)
    materialise(tries, f"{folder}/tries", by="kind")
    return model, known, model.table(spark, "tries").where(F.col("kind") == "trained")


def _with_words(blocks: DataFrame, answers: DataFrame, n_blocks: int, n_shards: int) -> DataFrame:
    known = materialise(_exchange(blocks.unionByName(answers), "block", n_blocks).mapInArrow(join_known(n_shards), ROWS))
    discard(blocks)
    return known


def look_up(blocks: DataFrame, n_blocks: int, model: Model) -> DataFrame:
    """Blocks with what a model knows of their words."""
    asked = blocks.mapInArrow(ask_words(model.n_shards), ROWS).unionByName(model.table(blocks.sparkSession, "words"))
    answers = _exchange(asked, "shard", model.n_shards).mapInArrow(find_words, ROWS)
    return _with_words(blocks, answers, n_blocks, model.n_shards)


def score_blocks(known: DataFrame, n_blocks: int, model: Model, answered: DataFrame | None = None) -> DataFrame:
    """Scores of all rows of blocks (from ``learn`` or ``look_up``) under a model that exists already.

    What ``learn`` has ``answered`` about the paths of its training texts is not asked again.
    """
    which = "all" if answered is None else "rest"
    tries = model.table(known.sparkSession, "tries").where(F.col("kind") == "trie")
    asked = known.mapInArrow(ask_paths(model, which), ROWS).unionByName(tries)
    codes = materialise(_exchange(asked, "shard", model.n_shards).mapInArrow(query_tries, ROWS))
    codes = codes if answered is None else codes.unionByName(answered)
    return _exchange(known.unionByName(codes), "block", n_blocks).mapInArrow(add_up(model, which), SCORES)


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text) under a trigram model of the ``train`` rows.

    Words are runs without ASCII white space, A-Z lower-cased, and each text ends with one
    more token; a null text has only that.  Returns for each row doc_id, held_out (not in
    ``train``; a null condition counts as held out), n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (log10 under add-half unigrams) and score (log10 under the model).  Repeated rows are
    scored, and counted in training, each for itself.  Without training rows both scores are
    those of one unknown word, 0.  An empty table gives an empty one.  Other columns are left out.
    """
    blocks, n_blocks = as_blocks(docs, train)
    model, known, answered = learn(blocks, n_blocks, shards_for(docs))
    return score_blocks(known, n_blocks, model, answered).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def score_with(docs: DataFrame, model: Model) -> DataFrame:
    """Score every text of ``docs`` under a kept model, which need not have seen any of them; all rows are held out."""
    blocks, n_blocks = as_blocks(docs, F.lit(False))
    return score_blocks(look_up(blocks, n_blocks, model), n_blocks, model).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
