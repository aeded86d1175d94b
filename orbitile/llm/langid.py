"""Language identification by prediction by partial matching.

For each language a byte context tree of fixed depth is counted from labelled rows; a text's
exact code length under each frozen tree, in bits, gives the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, join_per_key, materialise, packed, seeded_hash
from .text import chunks, texts_of

#: Bytes of context before the predicted one.
ORDER = 3
#: Labelled ids from which the tree of one language is counted, at most.
ROWS_PER_LANGUAGE = 1_000
#: Bytes of their texts, at most, but for the text that passes the bound.
BYTES_PER_LANGUAGE = 8_000_000
#: Sampled ids of all languages that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Characters coded at a time.
CHUNK = 1_000_000
PAD = b" " * ORDER


def grams(data: bytes) -> np.ndarray:
    """For each byte after the padding, itself and the ORDER bytes before it, as one uint32."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = b[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= b[ORDER - k : len(b) - k] << np.uint32(8 * k)
    return out


def as_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class ContextTree:
    """Byte counts below every context of 0 to ORDER bytes, frozen, with escapes of method C.

    A context seen t times, with d different next bytes, codes byte b seen c times in
    log2((t + d) / c) bits; an unseen byte pays log2((t + d) / d) and is coded by the next
    shorter context; below the empty context every byte costs 8 bits.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER + 1):
            kept = codes & np.uint32(((1 << 8 * (k + 1)) - 1) & 0xFFFFFFFF)
            nodes, at = np.unique(kept, return_inverse=True)
            c = np.bincount(at, weights=counts, minlength=len(nodes))
            contexts, of = np.unique(nodes >> np.uint32(8), return_inverse=True)
            total = np.bincount(of, weights=c, minlength=len(contexts))
            kinds = np.bincount(of, minlength=len(contexts)).astype(float)
            self.levels.append((nodes, np.log2((total + kinds)[of] / c), contexts, np.log2((total + kinds) / kinds)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each byte in its context."""
        cost, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, -1, -1):
            nodes, hit_bits, contexts, escape_bits = self.levels[k]
            if not len(nodes):
                continue
            code = codes[open_] & np.uint32(((1 << 8 * (k + 1)) - 1) & 0xFFFFFFFF)
            at = np.minimum(np.searchsorted(nodes, code), len(nodes) - 1)
            hit = nodes[at] == code
            cost[open_[hit]] += hit_bits[at[hit]]
            open_, code = open_[~hit], code[~hit]
            at = np.minimum(np.searchsorted(contexts, code >> np.uint32(8)), len(contexts) - 1)
            seen = contexts[at] == code >> np.uint32(8)
            cost[open_[seen]] += escape_bits[at[seen]]
        cost[open_] += 8.0
        return cost


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, dict] = {}
    for b in batches:
        frame = pd.DataFrame({"lang": b["lang"].to_pylist(), "text": texts_of(b["text"])})
        for lang, texts in frame.groupby("lang")["text"]:
            codes, n = np.unique(grams(b"".join(PAD + as_bytes(t) for t in texts)), return_counts=True)
            seen.setdefault(lang, []).append(pd.Series(n, codes))
    for lang, parts in seen.items():
        all_of = pd.concat(parts).groupby(level=0).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(all_of)), pa.array(all_of.index.astype(np.int64)), pa.array(all_of.to_numpy(np.int64))],
            ["lang", "code", "n"],
        )


def learn(docs: DataFrame, train: Column, *, rows_per_language: int = ROWS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE) -> dict[str, ContextTree]:
    """Trees of all languages among the ``train`` rows that have text and language.

    Counted from one text each of at most ``rows_per_language`` ids of each language, in the order of a
    seeded hash of doc_id until ``bytes_per_language`` are reached; a row without an id counts as one of
    its own, named by its text.  Every language has a tree, however few ids its rows share.  What reaches
    the driver is bounded for one language by these bytes, and grows with the number of languages.
    """
    fit = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    fit = fit.select("lang", "text", F.coalesce(F.col("doc_id").cast("string"), F.md5("text")).alias("__id"))
    ids = materialise(fit.select("lang", "__id").distinct())
    sizes = materialise(ids.groupBy("lang").agg(F.count("*").alias("__n")))
    n_langs = sizes.count()

    def share(rows: DataFrame) -> DataFrame:
        """Of a large language only the share of the hashes that holds about twice the ids."""
        rows = join_per_key(rows.withColumn("__h", seeded_hash(6, "__id")), sizes, "lang", n_langs)
        place = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / 2**32
        return rows.where(place * F.col("__n") <= 2 * rows_per_language + 100)

    order = Window.partitionBy("lang").orderBy("__h", "__id")
    ids = share(ids).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= rows_per_language)
    ids = materialise(ids.select("__id", "lang"))
    ids = F.broadcast(ids) if n_langs * rows_per_language <= BROADCAST_IDS else ids
    # an id on many rows gives one text, so that the bounds hold for rows too
    sample = share(fit).join(ids, ["__id", "lang"]).groupBy("lang", "__id", "__h").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sample = sample.withColumn("__before", upto - F.octet_length("text")).where(F.col("__before") < bytes_per_language)
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, code long, n long")
    rows = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    return {
        lang: ContextTree(g["code"].to_numpy(np.uint32), g["n"].to_numpy(float)) for lang, g in sorted(rows.groupby("lang"), key=lambda x: x[0])
    }


def code_lengths(texts: list[str], trees: list[ContextTree]) -> np.ndarray:
    """Bits of every text under every tree."""
    out = np.zeros((len(texts), len(trees)))
    for start, end in chunks(texts, CHUNK):
        data = [PAD + as_bytes(t) for t in texts[start:end]]
        ends = np.cumsum([len(d) for d in data])
        firsts = ends - np.array([len(d) for d in data])
        codes = grams(b"".join(data))
        which, different = pd.factorize(codes)
        for j, tree in enumerate(trees):
            # sums up to each byte; codes that reach over the padding of the next text are skipped
            total = np.concatenate([[0.0], np.cumsum(tree.bits(different)[which])])
            out[start:end, j] = total[ends - ORDER] - total[firsts]
    return out


def predict(docs: DataFrame, trees: dict[str, ContextTree], *, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the share of that language in the posterior.

    A null text, one without a letter, or any text if no language was learned, is ``und``
    with score 0.  Of equal code lengths the first language in code point order wins.
    Columns of these two names are replaced; rows stay as they are.
    """
    names, order = sorted(trees), [trees[k] for k in sorted(trees)]

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(column: pa.Array) -> pa.Array:
        texts = texts_of(column)
        letter = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
        if not names:
            letter[:] = False
        bits = code_lengths(texts, order) if names else np.zeros((len(texts), 1))
        best = bits.argmin(axis=1)
        share = 1.0 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)).sum(axis=1)
        lang = [names[i] if ok else "und" for i, ok in zip(best, letter, strict=True)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(letter, share, 0.0))], ["lang_pred", "score"])

    rows = packed(docs, F.col(text).alias("text")).withColumn("__p", predicted(F.col("text"))).select("__doc", "__p.*")
    return beside(docs, rows, "lang_pred", "score")
