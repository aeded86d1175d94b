"""Vectorised text helpers that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers for mixing 64-bit values.
MIX_A, MIX_B, MIX_C = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(30))) * MIX_B
    x = (x ^ (x >> U64(27))) * MIX_C
    return x ^ (x >> U64(31))


class WordHasher:
    """64-bit hashes of byte words; remembers those it has seen, up to a fixed number."""

    LIMIT = 500_000

    def __init__(self, seed: int = 0):
        from xxhash import xxh3_64_intdigest

        self.seed, self.seen, self.digest = seed, {}, xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > self.LIMIT:
            self.seen.clear()
        seen, digest, seed = self.seen, self.digest, self.seed
        get = seen.get
        out = [get(w) for w in words]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    w = words[i]
                    out[i] = h = get(w)
                    if h is None:
                        out[i] = seen[w] = digest(w, seed)
        return np.array(out, dtype=U64)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def chunks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of texts with about ``limit`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def best_cut(value: np.ndarray, positive: np.ndarray, share: float = 0.5, slack: float = 0.0) -> float:
    """The lowest cut whose balanced accuracy of ``value >= cut`` is within ``slack`` of the best.

    It lies at ``share`` of the gap between the neighbouring values; without values it is 0.
    """
    if not len(value):
        return 0.0
    order = np.argsort(value, kind="stable")
    v, y = value[order], positive[order]
    below_neg = np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum())
    below_pos = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    edges = np.concatenate([[True], v[1:] > v[:-1], [True]])
    gain = np.where(edges, below_neg - below_pos, -2.0)
    k = int(np.argmax(gain >= gain.max() - slack))
    low, high = v[max(k - 1, 0)], v[min(k, len(v) - 1)]
    return float(low + share * (high - low))
