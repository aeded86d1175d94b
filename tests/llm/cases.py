"""Rows with the awkward cases every operator must take: nulls, empties, ties, long texts, clashing columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score string, size string, n_words string, spans string, sig string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "a", "en"]) for _ in range(n))


def rows(n: int = 120, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "one two three four", "   ", "ÄÖ \U0001f600 word", "x" * 30_000, prose(rng, 12_000)]
    texts += [prose(rng, rng.randint(1, 150)) for _ in range(n)]
    texts += [texts[20]] * 5 + [texts[21] + " tail", texts[21].upper()]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 1, 7, "c", "c", "c", "c", "c") for i, t in enumerate(texts)]
    return [*out, out[15], out[15], (None, texts[16], "en", "a", 1, 7, "c", "c", "c", "c", "c"), (None, None, None, None, None, None, "c", "c", "c", "c", "c")]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
