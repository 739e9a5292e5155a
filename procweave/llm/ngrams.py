"""Words and hashed character n-grams of a batch of texts, as numpy arrays.

A word is a run of letters and of the combining marks after them, such as vowel signs; it is
lower-cased, digits and other signs end it, and it is framed by a boundary sign on either side, so n-grams tell prefixes and suffixes from the rest. The
n-grams' rolling hashes are computed for the whole batch at once."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

_rng = np.random.default_rng(777)
#: Random odd numbers, one for each place of an n-gram.
PLACES = _rng.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Scripts by code point ranges: fixed values from the Unicode blocks.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF)),
}
SCRIPT_NAMES = (*SCRIPTS, "other")
#: Code points from here on are no letters: planes without characters, tags, private use.
PLANES = 0x40000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its lower case where it is a letter, itself for a combining mark, else 0; its
    script's number; whether it is a letter."""
    lower, script, letter = np.zeros(PLANES, np.uint32), np.full(PLANES, len(SCRIPTS), np.uint8), np.zeros(PLANES, bool)
    for c in range(PLANES):
        if 0xD800 <= c < 0xE000:
            continue
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            lower[c], letter[c] = ord(low) if len(low) == 1 else c, True
        elif unicodedata.category(ch)[0] == "M":
            lower[c] = c
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, script, letter


_made: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _made:
        _made.extend(_tables())
    return _made[0], _made[1], _made[2]


@dataclass
class Words:
    """The words of a batch. doc: each word's text. begin: its place there, in characters. size: its letters and
    marks. script: of its first letter.

    framed: code points of all words, a 0 before and after each; start: each word's first 0."""

    doc: np.ndarray
    size: np.ndarray
    script: np.ndarray
    framed: np.ndarray
    start: np.ndarray
    begin: np.ndarray | None = None

    def sums(self, orders: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
        """For each word, the sum of weights[bucket] over its n-grams of the given orders, and of the word as a whole."""
        total = np.zeros((len(self.doc), *weights.shape[1:]), np.float64)
        for at, buckets in self.grams(orders, len(weights)):
            values = weights[buckets]
            # words shorter than the order have no n-gram of it: reduceat would take their neighbour's
            have = np.diff(np.searchsorted(at, [*self.start, len(self.framed)])) > 0
            first = np.searchsorted(at, self.start[have])
            if len(first):
                total[have] += np.add.reduceat(values, first, axis=0)
        return total

    def ids(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.doc):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.framed)) - np.repeat(self.start, self.size + 2)
        powers = np.cumprod(np.full(int(self.size.max()) + 2, PLACES[0], np.uint64))
        return np.add.reduceat((self.framed.astype(np.uint64) + np.uint64(1)) * powers[place], self.start)

    def counts(self, orders: tuple[int, ...]) -> np.ndarray:
        """The n-grams of each word."""
        framed = self.size + 2
        return sum(np.maximum(framed - n + 1, 0) for n in orders)

    def grams(self, orders: tuple[int, ...], buckets: int):
        """(place in framed of each n-gram, ascending; its bucket) for each order."""
        codes = self.framed.astype(np.uint64)
        end = np.repeat(self.start + self.size + 2, self.size + 2)  # of the word that holds the place
        places = np.arange(len(codes))
        for n in orders:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h += (codes[k : len(codes) - n + 1 + k] + np.uint64(1)) * PLACES[k]
            h ^= h >> np.uint64(29)
            h *= PLACES[7]
            ok = places[: len(h)] + n <= end[: len(h)]
            yield np.flatnonzero(ok), (h[ok] >> np.uint64(32)).astype(np.int64) % buckets


def words_of(texts: list[str | None]) -> Words:
    lower, script, letter = tables()
    joined = "\n".join(t or "" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < len(lower), codes, 0)
    letters = lower[codes]
    inside = letters > 0
    stray = inside & ~letter[codes]  # marks before a run's first letter belong to no word
    if stray.any():
        first = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)
        run = np.cumsum(np.diff(inside.astype(np.int8), prepend=0) == 1) - 1
        at = np.append(np.flatnonzero(letter[codes]), len(codes))
        begin = at[np.searchsorted(at, first)]
        inside &= np.arange(len(codes)) >= begin[np.maximum(run, 0)]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = last - first
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    doc = np.searchsorted(ends, first, side="right")
    start = np.concatenate([[0], np.cumsum(size + 2)[:-1]]) if len(size) else np.zeros(0, np.int64)
    framed = np.zeros(int((size + 2).sum()), np.uint32)
    where = np.flatnonzero(inside)
    framed[np.arange(len(where)) + 1 + 2 * np.repeat(np.arange(len(size)), size)] = letters[where]
    return Words(doc, size, script[codes[first]], framed, start.astype(np.int64), first - np.concatenate([[0], ends])[doc])
