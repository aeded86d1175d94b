"""Elias-Fano sequences and a three-level n-gram trie of them, kept in one memory-mapped file."""

from __future__ import annotations

import json

import numpy as np

_SELECT = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    for _r, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _SELECT[_byte, _r] = _bit
#: Masks of every second bit, pair and nibble of a word, and the lowest and highest bit of every byte.
_PAIRS, _QUADS, _NIBBLES, _EACH, _TOPS = (np.uint64(0x0101010101010101 * m) for m in (0x55, 0x33, 0x0F, 0x01, 0x80))
_THREE, _EIGHT, _BYTE = np.uint64(3), np.uint64(8), np.uint64(0xFF)
#: Values whose low bits are packed at a time; a multiple of eight, so that parts end on bytes.
PACKED = 1 << 16


class EliasFano:
    """A sorted sequence of n integers below ``universe``: low bits packed, high bits in unary.

    Bit (v_i >> low_bits) + i of the high part is set.  A count of set bits per 64-bit word
    makes ``select`` a search over words plus one inside a word.
    """

    def __init__(self, arrays: dict[str, np.ndarray], n: int, low_bits: int):
        self.low, self.high, self.ones, self.n, self.low_bits = arrays["low"], arrays["high"], arrays["ones"], n, low_bits

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> tuple[dict[str, np.ndarray], int, int]:
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        at = (values >> low_bits) + np.arange(n)
        words = int((universe >> low_bits) + n) // 64 + 2
        bits = np.zeros(words * 64, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        shifts = np.arange(low_bits)
        parts = [np.packbits(((values[k : k + PACKED, None] >> shifts) & 1).astype(np.uint8).reshape(-1), bitorder="little") for k in range(0, n, PACKED)]
        low = np.concatenate([*parts, np.zeros(8, np.uint8)])
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return {"low": low, "high": high, "ones": ones}, n, low_bits

    def _select_in(self, word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of set bit number r within each word: its byte by the running counts of all eight at once, then a table."""
        x = word - ((word >> 1) & _PAIRS)
        x = (x & _QUADS) + ((x >> 2) & _QUADS)
        upto = ((x + (x >> 4)) & _NIBBLES) * _EACH  # set bits in a byte and those below it
        r = np.minimum(r, 63).astype(np.uint64)
        bits = np.minimum(np.bitwise_count(((r * _EACH | _TOPS) - upto) & _TOPS), 7).astype(np.uint64) << _THREE
        before = (upto << _EIGHT) >> bits & _BYTE
        return bits.astype(np.int64) + _SELECT[(word >> bits) & _BYTE, np.minimum(r - before, 7)]

    def select1(self, i: np.ndarray) -> np.ndarray:
        j = np.searchsorted(self.ones, i, side="right") - 1
        return j * 64 + self._select_in(self.high[j], i - self.ones[j])

    def select0(self, i: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        j = np.searchsorted(zeros, i, side="right") - 1
        return j * 64 + self._select_in(~self.high[j], i - zeros[j])

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        byte, out = bit >> 3, np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return ((out >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self.select1(i) - i) << self.low_bits) | self.low_of(i)

    def successor(self, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in [first, last) of the first element at or over each value, and whether it is equal."""
        high, low = value >> self.low_bits, value & ((1 << self.low_bits) - 1)
        before = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) + 1 - high, 0)
        after = self.select0(high) - high
        a, b = np.maximum(first, before), np.minimum(last, after)
        end = np.maximum(a, b)
        a, b = a.copy(), end.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) // 2
            less = self.low_of(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        inside = np.flatnonzero(a < end)
        equal = np.zeros(len(value), bool)
        equal[inside] = self.low_of(a[inside]) == low[inside]
        return a, equal


class Quantised:
    """Logarithms of probabilities as 16-bit codes; code 0 stands for none."""

    STEPS = 65_534

    def __init__(self, codes: np.ndarray, low: float, step: float):
        self.codes, self.low, self.step = codes, low, step

    @classmethod
    def of(cls, p: np.ndarray) -> Quantised:
        """The codes of positive probabilities."""
        log = np.log10(p)
        low = float(log.min()) if len(log) else 0.0
        step = (float(log.max()) - low) / cls.STEPS if len(log) else 0.0
        return cls((1 + np.rint((log - low) / (step or 1.0))).astype(np.uint16), low, step)

    @staticmethod
    def values(codes: np.ndarray, low: float, step: float) -> np.ndarray:
        return np.where(codes > 0, np.power(10.0, low + (codes.astype(np.float64) - 1) * step), 0.0)


class Trie:
    """Words, their successors, and the successors of those pairs.

    Every level is one sorted Elias-Fano sequence: word numbers, lifted by the number of their parent
    times the size of the vocabulary, so that the children of a node are found by successor search
    between two pointers, which are an Elias-Fano sequence themselves.  Values are quantised:
    ``rest2`` is the weight that a pair leaves to shorter contexts, ``own2`` and ``own3`` the share of an
    n-gram in its context, relative to the context: P = own * (1 - rest) / own of the context.
    """

    SEQUENCES = ("words", "first", "pairs", "second", "triples")
    VALUES = ("own2", "rest2", "own3")

    def __init__(self, sequences: dict[str, EliasFano], values: dict[str, Quantised], vocabulary: int):
        self.__dict__ |= sequences | values
        self.vocabulary = vocabulary

    @classmethod
    def build(cls, words: np.ndarray, parent2: np.ndarray, word2: np.ndarray, parent3: np.ndarray, word3: np.ndarray, **p: np.ndarray) -> bytes:
        """The file of a trie; every level sorted by parent, then word; ``p`` has the probabilities by name."""
        vocabulary = int(max((int(x.max()) for x in (words, word2, word3) if len(x)), default=0)) + 1

        def pointers(parent: np.ndarray, n: int) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=n))]).astype(np.int64)

        levels = {
            "words": (words, vocabulary),
            "first": (pointers(parent2, len(words)), len(word2) + 1),
            "pairs": (parent2 * vocabulary + word2, len(words) * vocabulary + 1),
            "second": (pointers(parent3, len(word2)), len(word3) + 1),
            "triples": (parent3 * vocabulary + word3, len(word2) * vocabulary + 1),
        }
        head, parts, at = {"vocabulary": vocabulary, "sequences": {}, "values": {}}, [], 0

        def add(a: np.ndarray) -> list:
            nonlocal at
            parts.append(a.tobytes() + bytes(-a.nbytes % 8))
            at += len(parts[-1])
            return [at - len(parts[-1]), len(a), a.dtype.str]

        for name, (values, universe) in levels.items():
            arrays, n, bits = EliasFano.arrays(values.astype(np.int64), int(universe))
            head["sequences"][name] = {"n": n, "bits": bits, "arrays": {k: add(a) for k, a in arrays.items()}}
        for name in cls.VALUES:
            q = Quantised.of(p[name])
            head["values"][name] = {"low": q.low, "step": q.step, "codes": add(q.codes)}
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        return len(text).to_bytes(8, "little") + text + b"".join(parts)

    @classmethod
    def open(cls, path: str) -> Trie:
        """A trie over the mapped file."""
        data = np.memmap(path, np.uint8, mode="r")
        size = int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8 : 8 + size].tobytes())

        def mapped(place: list) -> np.ndarray:
            start, n, kind = place
            dtype = np.dtype(kind)
            return data[8 + size + start : 8 + size + start + n * dtype.itemsize].view(dtype)

        sequences = {k: EliasFano({a: mapped(x) for a, x in s["arrays"].items()}, s["n"], s["bits"]) for k, s in head["sequences"].items()}
        values = {k: Quantised(mapped(v["codes"]), v["low"], v["step"]) for k, v in head["values"].items()}
        return cls(sequences, values, head["vocabulary"])

    def children(self, level: str, pointers: str, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Nodes of words below their parents, -1 where there is none (or no parent)."""
        ef, out = getattr(self, level), np.full(len(word), -1, np.int64)
        known = np.flatnonzero((parent >= 0) & (word < self.vocabulary))
        if len(known) and ef.n:
            p, w, links = parent[known], word[known].astype(np.int64), getattr(self, pointers)
            at, equal = ef.successor(p * self.vocabulary + w, links.access(p), links.access(p + 1))
            out[known[equal]] = at[equal]
        return out

    def roots(self, word: np.ndarray) -> np.ndarray:
        out = np.full(len(word), -1, np.int64)
        known = np.flatnonzero(word < self.vocabulary)
        if len(known) and self.words.n:
            at, equal = self.words.successor(word[known].astype(np.int64), np.zeros(len(known), np.int64), np.full(len(known), self.words.n))
            out[known[equal]] = at[equal]
        return out

    def codes(self, name: str, node: np.ndarray) -> np.ndarray:
        """Codes of a value at the nodes, 0 where there is no node."""
        codes, out = getattr(self, name).codes, np.zeros(len(node), np.uint16)
        there = node >= 0
        out[there] = codes[node[there]]
        return out
