"""Texts as NumPy arrays of code points: words, pieces and their 64-bit hashes, without per-word Python.

A batch of texts becomes one array with a separator after each text, so runs never cross texts. A
span's hash is the sum of one mixed 64-bit value for each of its code points and their places in the span,
mixed again. A polynomial would not do: modulo 2**64 those of some words (Thue-Morse) are equal for any base.
"""

from __future__ import annotations

from functools import cache
from unicodedata import category

import numpy as np

SEPARATOR = 0x110000


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by SEPARATOR; starts of the texts, and the end of all."""
    texts = ["" if t is None else t for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    joined = "\n".join(texts) + "\n" if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[starts[1:] - 1] = SEPARATOR
    return points, starts


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: each output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``points[start:end]``; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # some spans at a time: the arrays of places are as long as their points
        after = max(first + 1, int(np.searchsorted(ends, starts[first] + (1 << 18), "right")))
        a, b = starts[first:after], ends[first:after]
        lo, hi = int(a[0]), int(b[-1])
        place = np.arange(lo, hi, dtype=np.uint64)
        place -= np.repeat(a, np.diff(np.append(a, hi))).astype(np.uint64)
        place *= np.uint64(0x9E3779B97F4A7C15)
        place += points[lo:hi]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(mix(place), out=sums[1:])
        out[first:after] = sums[b - lo] - sums[a - lo] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = after
    return mix(out)


_SPACE = np.zeros(SEPARATOR + 1, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13, SEPARATOR]] = True


def words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    space = _SPACE[points]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    return edge[0::2], edge[1::2]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the elements of spans, span after span."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out[:0]
    starts, lengths = starts[full], lengths[full]
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out[at] = starts
    out[at[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)


#: Bits of a character's kind.
BLANK, LETTER, NUMBER, OTHER, KIND, UNFAMILIAR = 0, 1, 2, 3, 3, 8


@cache
def kind_runs() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of all code points as runs (last code points, kinds), read off the tokenizers library.

    UNFAMILIAR marks what Python's Unicode tables lack: the library may know it as a letter, or another case
    of it. Takes seconds, so the driver makes the runs once and tasks get them.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    kinds = np.full(SEPARATOR + 1, OTHER, np.uint8)
    points = [c for c in range(SEPARATOR) if not 0xD800 <= c < 0xE000]
    texts = ["\x00".join(map(chr, points[k : k + 20_000])) for k in range(0, len(points), 20_000)]
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        split = Split(Regex(pattern), "removed", invert=True)
        kinds[[ord(c) for text in texts for c, _ in split.pre_tokenize_str(text)]] = kind
    for c in points:
        if category(chr(c)) == "Cn":
            kinds[c] |= UNFAMILIAR
    kinds[SEPARATOR] = BLANK
    last = np.concatenate((np.flatnonzero(np.diff(kinds)), [SEPARATOR]))
    return last, kinds[last]


def char_kinds(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The kind of every code point, and of the separator."""
    last, kinds = runs
    return np.repeat(kinds, np.diff(np.concatenate(([-1], last))))


class IntTable:
    """A hash table of non-negative integers in arrays; keys are looked up and put in many at a time."""

    def __init__(self, bits: int):
        self.size, self.shift = 0, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 where it is absent."""
        slot, last = self._slots(keys), len(self.keys) - 1
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        live = np.flatnonzero((held != keys) & (held >= 0))
        while len(live):
            slot[live] = (slot[live] + 1) & last
            held = self.keys[slot[live]]
            hit = held == keys[live]
            out[live[hit]] = self.values[slot[live[hit]]]
            live = live[~hit & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are absent; more than half the slots are never filled."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.keys >= 0)
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values))
            bits = 65 - int(self.shift)
            while 2 * len(keys) > 1 << bits:
                bits += 1
            self.__init__(bits)
        self.size += len(keys)
        slot, last = self._slots(keys), len(self.keys) - 1
        while len(keys):
            _, one = np.unique(slot, return_index=True)
            one = one[self.keys[slot[one]] < 0]
            self.keys[slot[one]], self.values[slot[one]] = keys[one], values[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & last
