"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length.

The lexicon (words and word beginnings with weights), its exception phrases and the cut are
learned from a bounded sample of labelled rows; every text is then scored whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, label_sample, packed, unpacked
from .text import best_cut, texts_of

#: Labelled rows from which the lexicon is learned, at most.
SAMPLE_ROWS = 20_000
#: A term enters if its log-likelihood ratio statistic and its share of toxic rows reach these, hits in
#: exception phrases left out; terms from the third figure on are tried for exception phrases.
MIN_G2, MIN_PURITY, TRIED_PURITY = 18.0, 0.97, 0.75
#: Lengths of word beginnings that are tried as terms.
STEMS = range(4, 11)
#: Words added to the length, so that one word in a short text doesn't decide alone.
BASE_WORDS = 20

# Look-alike letters of other scripts, and digits and signs used as letters.
HOMOGLYPHS = dict(zip("авеіјкмнорсԛѕтԝхуһԁӏαβεικνορτυχ", "abeijkmhopcqstwxyhdlabeiknoptux", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INSIDE = re.compile(r"(?<![^\W\d_])[@$]|[@$](?![^\W\d_])")


def _folded(char: str) -> str:
    if char in HOMOGLYPHS or char in SUBSTITUTES:
        return HOMOGLYPHS.get(char) or SUBSTITUTES[char]
    kind = unicodedata.category(char)
    if kind in ("Cf", "Mn"):
        return ""
    base = unicodedata.normalize("NFKD", char)[0].lower()
    return base if base.isalpha() else " "


#: Latin, Greek and Cyrillic letters, general punctuation and full-width forms; others stay.
FOLD = {c: _folded(chr(c)) for r in (range(0x530), range(0x2000, 0x2070), range(0xFF00, 0xFF5F)) for c in r}


def fold(text: str) -> str:
    """Lower-case words between single blanks, look-alikes and substitutions undone."""
    return f" {' '.join(INSIDE.sub(' ', text.lower()).translate(FOLD).split())} "


def terms_of(folded: str) -> set[str]:
    """Whole words (blank on either side) and word beginnings (blank before)."""
    found = set()
    for w in set(folded.split()):
        if len(w) > 2:
            found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in STEMS if k <= len(w))
    return found


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights, phrases that excuse the terms in them, and the density at score 1/2."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    cut: float

    @cached_property
    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            made.add_word(term, (len(term), weight, term))
        for phrase in self.exceptions:
            made.add_word(f" {phrase} ", (len(phrase) + 2, None, ""))
        made.make_automaton()
        return made

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("weights", "exceptions", "cut")}

    def hits(self, folded: str) -> list[tuple[int, float, str]]:
        """Starts, weights and terms found in a folded text where no exception phrase covers them."""
        if not self.weights:
            return []
        best: dict[int, tuple[float, str]] = {}
        excused: dict[int, int] = {}
        for end, (size, weight, term) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                excused[start] = max(end, excused.get(start, 0))
            else:
                best[start] = max((weight, term), best.get(start, (0.0, "")))
        out, reached = [], 0  # how far the phrases that began so far extend
        for s in sorted(best.keys() | excused.keys()):
            reached = max(reached, excused.get(s, 0))
            if s in best and s >= reached:
                out.append((s, *best[s]))
        return out

    def density(self, text: str) -> float:
        """Weight of the hits per word."""
        folded = fold(text)
        return sum(w for _, w, _ in self.hits(folded)) / (folded.count(" ") - 1 + BASE_WORDS)

    def score(self, text: str) -> float:
        """0 to 1: density / (density + cut); 0 for an empty text."""
        d = self.density(text)
        return d / (d + self.cut)


def _signature(folded: str) -> int:
    """One min-hash over three-word windows: near copies mostly share it."""
    from xxhash import xxh3_64_intdigest

    w = folded.split()
    return min((xxh3_64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1


def _fold_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        folded = [fold(t) for t in texts_of(b["text"])]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"].cast(pa.string()), b["label"].cast(pa.int32()), pa.array([_signature(t) for t in folded], pa.int64()), pa.array(folded, pa.string())],
            ["doc_id", "label", "sig", "folded"],
        )


def _counted(folded: DataFrame, features: Callable[[str], set[str]]) -> DataFrame:
    """(term, toxic, clean): rows of each kind that have a feature, counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for label, text in zip(b["label"].to_pylist(), b["folded"].to_pylist(), strict=True):
                seen[int(label > 0)].update(features(text))
        terms = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

    counted = folded.mapInArrow(run, "term string, toxic long, clean long").groupBy("term")
    return counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _telling(counted: DataFrame, n_toxic: int, n_clean: int, purity: float) -> list:
    """Terms that mark toxic rows, the most telling first: as many as the bounded sample gives."""
    rate_t, rate_c = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    kept = counted.withColumns({"g2": _g2(F.col("toxic"), F.col("clean"), n_toxic, n_clean), "purity": rate_t / (rate_t + rate_c)})
    kept = kept.where((F.col("g2") >= MIN_G2) & (F.col("purity") >= purity))
    return kept.orderBy(F.desc("g2"), "term").collect()


def _g2(toxic, clean, n_toxic: int, n_clean: int):
    """Log-likelihood ratio statistic of a term's document counts against one common rate."""
    p = (toxic + clean) / F.lit(float(n_toxic + n_clean))

    def part(k, n):
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)

    return 2 * (part(toxic, n_toxic) + part(clean, n_clean))


def learn(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, bound: int = SAMPLE_ROWS) -> Lexicon:
    """Learn a lexicon from ``labels.toxic``, on rows outside the held-out fold.

    The sample is bounded by ``bound`` rows, near copies in it count once, and all that the
    driver gets are the selected terms and phrases, none left out, and one density per sampled row.  Without
    labels of both kinds the lexicon is empty and every score is 0.
    """
    train = fold_of("doc_id", folds) != held_out
    sample = F.broadcast(label_sample(labels, "toxic", train, bound))
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    folded = rows.mapInArrow(_fold_sample, "doc_id string, label int, sig long, folded string")
    # an id on many rows gives one of them, so that the bound holds for rows too
    folded = folded.groupBy("doc_id", "label").agg(F.min(F.struct("sig", "folded")).alias("t")).select("label", "t.*")
    folded = folded.groupBy("sig", "label").agg(F.min("folded").alias("folded")).persist()
    try:
        n = {bool(r[0]): r[1] for r in folded.groupBy(F.col("label") > 0).count().collect()}
        n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
        if not n_toxic or not n_clean:
            return Lexicon({}, (), 1.0)
        counted = _counted(folded, terms_of)
        found = _telling(counted, n_toxic, n_clean, TRIED_PURITY)
        tried = Lexicon(dict.fromkeys(_to_try(found), 1.0), (), 1.0)
        tried = Lexicon(tried.weights, _exceptions(folded, tried, n_toxic, n_clean), 1.0)
        counted = _counted(folded, lambda text: {t for _, _, t in tried.hits(text)})
        weights = {
            r["term"]: float(np.log((r["toxic"] + 0.5) / (n_toxic + 1)) - np.log((r["clean"] + 0.5) / (n_clean + 1)))
            for r in _telling(counted, n_toxic, n_clean, MIN_PURITY)
        }
        lexicon = Lexicon(weights, tried.exceptions, 1.0)
        return Lexicon(weights, lexicon.exceptions, _cut(folded, lexicon))
    finally:
        folded.unpersist()


def _longest_of_family(found: list) -> list:
    """One term for each family of extensions of a beginning: the longest that keeps its toxic rows."""
    families: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (len(r["term"]), r["term"])):
        root = next((r["term"][:k] for k in range(2, len(r["term"])) if r["term"][:k] in families), r["term"])
        families.setdefault(root, []).append(r)
    return [max((r for r in f if r["toxic"] >= 0.9 * f[0]["toxic"]), key=lambda r: (len(r["term"]), r["term"])) for f in families.values()]


def _to_try(found: list) -> list[str]:
    """Pure terms, one a family, and impure whole words that no pure beginning covers: exception phrases may clear those."""
    pure = {r["term"] for r in _longest_of_family([r for r in found if r["purity"] >= MIN_PURITY])}
    impure = (r["term"] for r in found if r["purity"] < MIN_PURITY and r["term"].endswith(" "))
    return sorted(pure | {t for t in impure if not any(t[:k] in pure for k in range(2, len(t)))})


def _exceptions(folded: DataFrame, lexicon: Lexicon, n_toxic: int, n_clean: int) -> tuple[str, ...]:
    """Two-word phrases around a hit that mark clean rows."""

    def phrases(text: str) -> set[str]:
        near = set()
        for start, _, _ in lexicon.hits(text):
            end = text.index(" ", start + 1)
            word, before = text[start + 1 : end], text[text.rfind(" ", 0, start) + 1 : start]
            after = text[end + 1 : max(text.find(" ", end + 1), end + 1)]
            near.update(p for p in (f"{before} {word}" if before else "", f"{word} {after}" if after else "") if p)
        return near

    near = _counted(folded, phrases)
    near = near.where((F.col("clean") >= 3) & (F.col("clean") / n_clean > 20 * F.col("toxic") / n_toxic))
    return tuple(r[0] for r in near.orderBy(F.desc("clean"), "term").collect())


def _cut(folded: DataFrame, lexicon: Lexicon) -> float:
    """The density that best parts the sample: balanced accuracy, middle of the best gap."""

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [sum(w for _, w, _ in lexicon.hits(t)) / (t.count(" ") - 1 + BASE_WORDS) for t in b["folded"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["label"], pa.array(d, pa.float64())], ["label", "d"])

    pairs = folded.mapInArrow(densities, "label int, d double").collect()  # as many as the bounded sample
    return max(1e-9, best_cut(np.array([p[1] for p in pairs]), np.array([p[0] > 0 for p in pairs]), share=0.25))


def score(docs: DataFrame, lexicon: Lexicon, *, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if the score is 1/2 or more) to every row.

    A null or empty text scores 0.  Rows, repeated ones included, stay as they are; columns
    of these two names are replaced.
    """

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([lexicon.score(t) for t in texts_of(texts)], pa.float64())

    out = docs.withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def remove(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns as they were."""
    return unpacked(score(packed(docs, "text"), lexicon).where(F.col("predicted") == 0))
