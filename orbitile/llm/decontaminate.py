"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each task turns the documents of a batch into one word sequence, builds its suffix array and
binary-searches every benchmark suffix in it.  That gives the occurrences of every benchmark
window, the longest verbatim match of every item and where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, materialise, packed, unpacked
from .text import chunks, texts_of

#: Consecutive words of a benchmark item that count as a leak.
WINDOW = 10
#: Characters of training text in one suffix array.
SHARD_CHARS = 8_000_000
#: Characters of benchmark text searched for in one pass over the documents.
BLOCK_CHARS = 4_000_000

# ASCII letters and digits and all bytes above ASCII make words.
_KEPT = {c: c for r in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)) for c in r} | {c: c + 32 for c in range(0x41, 0x5B)}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_BYTES = bytes(_KEPT.get(c, 0x20) for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


def suffix_array(seq: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The ``starts`` in the order of the suffixes, compared over ``depth`` words at least.

    Prefix doubling over the whole sequence; 0 ends a suffix and sorts first.
    """
    # dense from the start, as the largest rank stands for the number of classes
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    rank[seq == 0] = 0
    step = 1
    while True:
        after = np.zeros_like(rank)
        after[:-step or None] = rank[step:] if step < len(rank) else 0
        after[rank == 0] = 0
        _, rank_new = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)
        rank_new = rank_new.astype(np.int64) + 1
        rank_new[seq == 0] = 0
        step *= 2
        done = step >= depth or rank_new.max() == rank.max()
        rank = rank_new
        if done:
            return starts[np.argsort(rank[starts], kind="stable")]


class Benchmark:
    """A block of distinct benchmark texts as one sequence of word numbers, each text ended by 0.

    ``suffixes`` are the places of all words, ``ends`` where their texts end and ``text`` which text it is.
    ``least_match`` are the words of the text's windows.  Equal windows are one: ``window_at`` is a place of each, ``need`` its words, ``kind`` the set of
    texts that have it, and ``texts_of`` lists the sets.
    """

    def __init__(self, items: list[tuple[list[str], str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, flat, sizes = [], [], []
        for ids, text in items:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if seq:
                self.ids.append(ids)
                sizes.append(len(seq))
                flat += [*seq, 0]
        size = np.array(sizes, np.int64)
        self.depth = int(size.max()) if len(size) else 0
        self.words = np.array([*flat, 0], np.int64)
        first = np.cumsum(size + 1) - (size + 1)
        self.text = np.repeat(np.arange(len(size)), size)
        self.suffixes = np.arange(len(self.text)) + self.text  # one 0 for each text before
        self.ends = (first + size)[self.text]
        self.least_match = np.minimum(window, size)[self.text]
        begins = self.suffixes + self.least_match <= self.ends
        self.window_at, self.need, of = self._distinct(self.suffixes[begins], self.least_match[begins])
        # the fewest words a window that begins with this word needs
        self.least = np.full(len(self.vocabulary) + 1, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.words[self.window_at], self.need)
        pair = np.unique(of * max(1, len(size)) + self.text[begins])
        kinds: dict[bytes, int] = {}
        self.kind, self.texts_of = np.zeros(len(self.window_at), np.int64), []
        parts = np.split(pair % max(1, len(size)), np.searchsorted(pair // max(1, len(size)), np.arange(1, len(self.window_at))))
        for w, texts in enumerate(parts if len(pair) else []):
            self.kind[w] = kinds.setdefault(texts.tobytes(), len(kinds))
            if len(self.texts_of) < len(kinds):
                self.texts_of.append(texts)
        self.order = suffix_array(self.words, self.suffixes, self.depth) if len(size) else self.suffixes

    def _distinct(self, at: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A place of each distinct window, its words, and the number of the window at every place."""
        places, sizes, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(at), np.int64)
        for n in np.unique(need):
            here = np.flatnonzero(need == n)
            _, first, of = np.unique(self.words[at[here][:, None] + np.arange(n)], axis=0, return_index=True, return_inverse=True)
            number[here] = sum(map(len, places)) + of.reshape(-1)
            places.append(at[here][first])
            sizes.append(np.full(len(first), n))
        return np.concatenate(places), np.concatenate(sizes), number


def _common(a: np.ndarray, at: np.ndarray, b: np.ndarray, query: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Words that the suffixes of ``a`` at ``at`` share with those of ``b`` at ``query``, up to ``limit``."""
    n = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero(limit > 0)
    while len(open_):
        open_ = open_[a[at[open_] + n[open_]] == b[query[open_] + n[open_]]]
        n[open_] += 1
        open_ = open_[n[open_] < limit[open_]]
    return n


def _bound(seq: np.ndarray, array: np.ndarray, other: np.ndarray, query: np.ndarray, limit: np.ndarray, upper: bool) -> np.ndarray:
    """First place in a suffix array at or (``upper``) after the suffixes that start as those of ``other`` at ``query``, over ``limit`` words."""
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(array), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        at, q, m = array[mid], query[open_], limit[open_]
        n = _common(seq, at, other, q, m)
        go_right = np.where(n == m, upper, seq[at + n] < other[np.minimum(q + n, len(other) - 1)])
        low[open_[go_right]] = mid[go_right] + 1
        high[open_[~go_right]] = mid[~go_right]
    return low


def _longest(seq: np.ndarray, array: np.ndarray, other: np.ndarray, query: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the longest match of each suffix of ``other`` among the sorted ones of ``seq``, and where it is: next to its own place."""
    spot = _bound(seq, array, other, query, limit, False)
    best, at = np.zeros(len(query), np.int64), np.full(len(query), -1)
    for neighbour in (np.minimum(spot, len(array) - 1), np.maximum(spot - 1, 0)):
        n = _common(seq, array[neighbour], other, query, limit)
        at = np.where(n > best, array[neighbour], at)
        best = np.maximum(n, best)
    return best, at


class Shard:
    """Training texts as one sequence of the benchmark's word numbers, with its suffix array.

    0 stands for a word that no benchmark text has, and for the end of a text.  Only suffixes that
    could begin a window are in the array.
    """

    def __init__(self, texts: list[str], bench: Benchmark):
        number = bench.vocabulary.get
        parts = [np.array([*(number(w, 0) for w in words(t)), 0], np.int64) for t in texts]
        self.bench, self.seq = bench, np.concatenate([*parts, np.zeros(1, np.int64)])
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.n_words = np.diff(self.offsets) - 1
        # words from here to the next one that no benchmark text has
        stops = np.flatnonzero(self.seq == 0)
        self.run = stops[np.searchsorted(stops, np.arange(len(self.seq)))] - np.arange(len(self.seq))
        starts = np.flatnonzero((self.seq > 0) & (self.run >= bench.least[self.seq]))
        self.array = suffix_array(self.seq, starts, bench.depth) if len(starts) else starts

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def matches(self) -> dict[int, tuple[list[tuple[int, int]], set[str], int, int]]:
        """By text with an occurring window: runs of hit words, ids of items, words and start of its longest verbatim match.

        Every distinct window is searched once, and an occurrence is listed once for each length of
        windows, however many items have it.
        """
        bench, seq = self.bench, self.seq
        if not len(self.array):
            return {}
        low, high = (_bound(seq, self.array, bench.words, bench.window_at, bench.need, upper) for upper in (False, True))
        found = np.repeat(np.arange(len(low)), high - low)
        place = self.array[np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(len(found))]
        if not len(place):
            return {}
        hit = np.bincount(place, minlength=len(seq) + 1) - np.bincount(place + bench.need[found], minlength=len(seq) + 1)
        edge = np.diff(np.concatenate([[0], np.cumsum(hit) > 0, [0]]))
        run_starts, run_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans: dict[int, list] = {}
        for d, a, b in zip(self.doc_of(run_starts), run_starts, run_ends, strict=True):
            spans.setdefault(int(d), []).append((int(a - self.offsets[d]), int(b - self.offsets[d])))
        ids: dict[int, set] = {}
        kinds = len(bench.texts_of)
        for key in np.unique(self.doc_of(place) * kinds + bench.kind[found]):
            mine = ids.setdefault(int(key // kinds), set())
            for t in bench.texts_of[int(key % kinds)]:
                mine.update(bench.ids[t])
        place = np.unique(place)
        n, _ = _longest(bench.words, bench.order, seq, place, self.run[place])
        doc = self.doc_of(place)
        best = np.lexsort((place, -n, doc))
        best = best[np.unique(doc[best], return_index=True)[1]]
        longest = {int(doc[k]): (int(n[k]), int(place[k] - self.offsets[doc[k]])) for k in best}
        return {d: (spans[d], ids[d], *longest[d]) for d in spans}

    def longest(self, rank: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(benchmark text, words, text, start) of the longest verbatim match of each benchmark text, from its every suffix.

        Of equal ones that in the text of the smallest ``rank``, then the first.
        """
        bench = self.bench
        if not len(self.array):
            return []
        n, at = _longest(self.seq, self.array, bench.words, bench.suffixes, bench.ends - bench.suffixes)
        kept = np.flatnonzero((n >= bench.least_match) & (at >= 0))
        # every occurrence of the longest words counts, so that the first one can be told
        longest = np.zeros(len(bench.ids), np.int64)
        np.maximum.at(longest, bench.text[kept], n[kept])
        kept = kept[n[kept] == longest[bench.text[kept]]]
        low, high = (_bound(self.seq, self.array, bench.words, bench.suffixes[kept], n[kept], upper) for upper in (False, True))
        found = np.repeat(np.arange(len(kept)), high - low)
        place = self.array[np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(len(found))] if len(found) else found
        doc, text = self.doc_of(place), bench.text[kept][found]
        order = np.lexsort((place, rank[doc], text))
        order = order[np.unique(text[order], return_index=True)[1]]
        return [(int(text[k]), int(longest[text[k]]), int(doc[k]), int(place[k] - self.offsets[doc[k]])) for k in order]


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """(block, ids, text) of the distinct benchmark texts, stored, and the number of blocks of about ``block_chars`` characters."""
    texts = benchmark.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    texts = materialise(texts)
    total = texts.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_chars))
    return texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")), n


def _block(blocks: DataFrame, k: int, window: int) -> Broadcast:
    """One block, whose size is bounded, on its way to all tasks."""
    rows = blocks.where(F.col("block") == k).orderBy("text").select("ids", "text").collect()
    return blocks.sparkSession.sparkContext.broadcast(Benchmark([(list(r["ids"]), r["text"]) for r in rows], window))


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
MATCH = "struct<n_words: bigint, spans: array<struct<start: int, end: int>>, item_ids: array<string>, longest_match: bigint, longest_start: bigint>"
MATCH_TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("item_ids", pa.list_(pa.string())), ("longest_match", pa.int64()), ("longest_start", pa.int64())])
ADDED = ("n_words", "n_hit", "spans", "item_ids", "longest_match", "longest_start")


def _matcher(block: Broadcast):
    @F.arrow_udf(MATCH)
    def matched(column: pa.Array) -> pa.Array:
        texts, rows = texts_of(column), []
        for start, end in chunks(texts, SHARD_CHARS):
            shard = Shard(texts[start:end], block.value)
            found = shard.matches()
            for d, n_words in enumerate(shard.n_words):
                spans, ids, n, at = found.get(d, ((), (), 0, None))
                rows.append((int(n_words), [{"start": a, "end": b} for a, b in spans], sorted(ids), n, at))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MATCH_TYPE, strict=True)], [f.name for f in MATCH_TYPE])

    return matched


def _joined(column: pa.Array) -> pa.Array:
    """Spans of several blocks as disjoint ones."""
    out = []
    for spans in column.to_pylist():
        done: list[dict] = []
        for s in sorted(spans or (), key=lambda s: (s["start"], s["end"])):
            if done and done[-1]["end"] >= s["start"]:
                done[-1]["end"] = max(done[-1]["end"], s["end"])
            else:
                done.append(s)
        out.append(done)
    return pa.array(out, pa.list_(SPAN))


def _match_blocks(docs: DataFrame, blocks: DataFrame, n: int, window: int) -> DataFrame:
    """Packed rows with their matches in a benchmark of several blocks: one pass for each, of which only rows with a hit are stored."""
    work = materialise(packed(docs, F.monotonically_increasing_id().alias("rid")))
    parts = []
    for k in range(n):
        block = _block(blocks, k, window)
        found = work.select("rid", _matcher(block)(F.col("__doc")["text"]).alias("m")).select("rid", "m.*").where(F.size("spans") > 0)
        parts.append(materialise(found))
        block.destroy()
    first = F.min(F.struct((-F.col("longest_match")).alias("n"), "longest_start")).alias("first")
    hits = reduce(DataFrame.unionByName, parts).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("ids"), first)
    none = F.array().cast("array<string>")
    joined = F.arrow_udf(_joined, "array<struct<start: int, end: int>>")
    rows = work.join(hits, "rid", "left").withColumn("spans", joined("spans"))
    ids = F.array_sort(F.array_distinct(F.coalesce("ids", none)))
    n_words = F.coalesce(F.regexp_count(F.col("__doc")["text"], F.lit(WORD)), F.lit(0)).cast("long")
    longest = F.coalesce(-F.col("first.n"), F.lit(0))
    return rows.select("__doc", "spans", n_words.alias("n_words"), ids.alias("item_ids"), longest.alias("longest_match"), "first.longest_start")


def match(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add n_words, n_hit, spans, item_ids, longest_match and longest_start to every row of ``docs``.

    ``spans`` are the runs of words covered by benchmark windows (word numbers, end
    exclusive), n_hit their length, item_ids (sorted as strings) the items with an occurring
    window, longest_match the words of the longest verbatim match with any item (0: none), and
    longest_start the word where it first starts.  Texts without words, null ones among them, have none; so has
    every text if no item has words.  An item without an id still marks words but is not listed;
    one id on several rows counts once.  Rows, repeated ones included, stay as they are; columns of
    these names are replaced.

    The benchmark is cut into blocks of about ``block_chars`` characters of distinct text.  The driver
    and a task hold one block at a time: with one block there is one pass over the documents and no
    shuffle, with more there is a pass for each, and the hits are joined to their rows.
    """
    blocks, n = _blocks(benchmark, block_chars)
    if n == 1:
        rows = packed(docs, "text").withColumn("m", _matcher(_block(blocks, 0, window))(F.col("text"))).select("__doc", "m.*")
    else:
        rows = _match_blocks(docs, blocks, n, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return beside(docs, rows.withColumn("n_hit", hit), *ADDED)


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, with their columns as they were."""
    return unpacked(match(packed(docs, "text"), benchmark, window=window).where(F.col("n_hit") == 0))


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each benchmark item with a match of a window or more: item_id (as text), n_match, the words of its longest
    verbatim match over all shards, and doc_id and start, the word number, where it starts.

    Of equally long ones the smallest doc_id wins (a null id last), then the smallest word.  Items with
    equal texts have equal rows; an item without an id has none.
    """
    blocks, n = _blocks(benchmark, block_chars)
    parts = []
    for k in range(n):
        block = _block(blocks, k, window)

        def found(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            bench = block.value
            for b in batches:
                texts, doc_ids = texts_of(b["text"]), b["doc_id"].to_pylist()
                for start, end in chunks(texts, SHARD_CHARS):
                    rank = np.zeros(end - start, np.int64)
                    rank[sorted(range(end - start), key=lambda i: (doc_ids[start + i] is None, doc_ids[start + i] or 0))] = np.arange(end - start)
                    best = [(i, n, doc_ids[start + d], at) for t, n, d, at in Shard(texts[start:end], bench).longest(rank) for i in bench.ids[t]]
                    types = (pa.string(), pa.int64(), b["doc_id"].type, pa.int64())
                    columns = zip(*best, strict=True) if best else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "n_match", "doc_id", "start"])

        id_type = docs.schema["doc_id"].dataType.simpleString()
        parts.append(materialise(docs.select("doc_id", "text").mapInArrow(found, f"item_id string, n_match long, doc_id {id_type}, start long")))
        block.destroy()
    order = F.struct(-F.col("n_match"), F.col("doc_id").isNull(), "doc_id", "start")
    best = reduce(DataFrame.unionByName, parts).groupBy("item_id").agg(F.min_by(F.struct("n_match", "doc_id", "start"), order).alias("b"))
    return best.select("item_id", "b.n_match", "b.doc_id", "b.start")
