"""Words of a chunk in Python, as functions/text.py has them as Columns: between white space, without marks at their ends, lower-cased.

What a letter or number is, and how characters are lower-cased, is asked of Spark itself once per session, so that both ways follow the same Unicode tables.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import SHORTEST, STOPWORDS

#: Unicode's White_Space: a fixed list.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What Python's split() takes for white space besides.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


@cache
def _flags(letters: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(letters), np.uint8))


@dataclass(frozen=True)
class Rules:
    """letters: a bit per code point that is a letter or number, compressed; lowers: lower-case forms in which Spark differs from Python.

    steps: from each code point to its lower-case form, compressed; odd: characters that have none of one character, or one that depends on their neighbours.
    """

    letters: bytes
    lowers: tuple[tuple[str, str], ...]
    steps: bytes
    odd: str

    def lower(self, text: str) -> str:
        if text.isascii() or not self.lowers or max(text) < self.lowers[0][0]:
            return text.lower()
        own = dict(self.lowers)
        parts = re.split(f"([{re.escape(''.join(own))}])", text)
        return "".join(own[p] if p in own else p.lower() for p in parts)

    def bare(self, raw: str) -> str:
        if raw.isascii():
            return raw.strip(_MARKS).lower()
        letter, low, high = _flags(self.letters), 0, len(raw)
        while low < high and not letter[ord(raw[low])]:
            low += 1
        while low < high and not letter[ord(raw[high - 1])]:
            high -= 1
        return self.lower(raw[low:high])


_RULES: dict[str, Rules] = {}


def rules(spark: SparkSession) -> Rules:
    """The rules of this session's Spark."""
    known = spark.sparkContext.applicationId
    if known not in _RULES:
        points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, points))
        others = [c for c in map(chr, points) if c != "\n"]
        rows = spark.createDataFrame([(every, "\n".join(others))], "a string, b string").repartition(1)
        found = rows.select(F.regexp_replace("a", r"[\p{IsAlphabetic}\p{N}]", "x").alias("a"), F.lower("b").alias("b")).first()
        flags = np.zeros(0x110000, np.uint8)
        flags[points] = np.frombuffer(found.a.encode("utf-32-le"), np.uint32) == ord("x")
        lowers = tuple((c, d) for c, d in zip(others, found.b.split("\n"), strict=True) if c.lower() != d)
        steps = np.zeros(0x110000, "<i4")
        odd = ["\u03a3"]  # sigma, at the end of a word
        for c, d in zip(others, found.b.split("\n"), strict=True):
            if c != d:
                if len(d) == 1:
                    steps[ord(c)] = ord(d) - ord(c)
                else:
                    odd.append(c)
        _RULES[known] = Rules(zlib.compress(np.packbits(flags).tobytes()), lowers, zlib.compress(steps.tobytes()), "".join(odd))
    return _RULES[known]


def split(text: str) -> list[str]:
    """The runs between white space; there may be empty ones at the ends."""
    return _SPACES.split(text) if any(c in text for c in _SEPARATORS) else text.split()


_STOPS = frozenset(STOPWORDS)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number to another one, all of whose bits depend on all of its own."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    return h ^ (h >> np.uint64(31))


@cache
def _tables(rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for letters and numbers, 2 for white space, else 0; the lower-case form; a random number of that. Then the sorted hashes of the stop words."""
    kind, points = _flags(rules.letters).copy(), np.arange(0x110000)
    for c in points[:0x3001]:
        if _SPACES.fullmatch(chr(c)):
            kind[c] = 2
    low = (points + np.frombuffer(zlib.decompress(rules.steps), "<i4")).astype(np.uint32)
    value = mixed((low.astype(np.uint64) + np.uint64(1)) * _ODD)
    words = [np.array([ord(c) for c in w]) for w in STOPWORDS]
    powers = _powers(max(map(len, words)) + 1)[0]
    stops = mixed(np.array([(value[w] * powers[: len(w)]).sum(dtype=np.uint64) for w in words], np.uint64))
    return kind, low, value, np.sort(stops)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2^64."""
    out = []
    for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


#: Characters, with one between chunks, that are cut into words at once: fewer than 2^21 words.
CHARACTERS = 4_000_000


class Words:
    """The words of many chunks on arrays: where they start and end in `low`, the lower-cased characters, their chunks, hashes, and whether they are stop words (told by their hash)."""

    def __init__(self, texts: list[str], rules: Rules):
        kinds, lows, values, stops = _tables(rules)
        odd = [k for k, t in enumerate(texts) if not t.isascii() and any(c in t for c in rules.odd)]
        # what has such characters is cut as text, and its words stay as they are
        bare = {k: " ".join(filter(None, map(rules.bare, split(texts[k])))) for k in odd}
        order = [k for k in range(len(texts)) if k not in bare] + odd
        ready = [bare[k] if k in bare else texts[k] for k in order]
        sizes = np.fromiter(map(len, ready), np.int64, len(ready)) + 1
        starts = np.cumsum(sizes) - sizes
        points = np.frombuffer("\n".join([*ready, ""]).encode("utf-32-le"), np.uint32)
        kind = kinds[points]
        if odd:
            tail = kind[starts[len(order) - len(odd)] :]
            tail[tail == 0] = 1
        at = np.flatnonzero(kind == 1)
        run = np.cumsum(kind == 2, dtype=np.int32)[at]
        edge = np.flatnonzero(run[1:] != run[:-1])
        self.starts = at[np.concatenate(([0], edge + 1))] if len(at) else at
        self.ends = (at[np.append(edge, len(at) - 1)] if len(at) else at) + 1
        self.low = lows[points]
        up, down = (p[: len(points) + 1] for p in _powers(max(CHARACTERS + 2100, 1 << (len(points) + 1).bit_length() if len(points) > CHARACTERS + 2000 else 0)))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values[points] * up[:-1], out=sums[1:])
        self.hashes = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])
        place = np.minimum(np.searchsorted(stops, self.hashes), len(stops) - 1)
        self.stop = stops[place] == self.hashes
        # a word of SHORTEST characters has that many bytes
        size = self.ends - self.starts
        some = np.flatnonzero(size < SHORTEST)
        octets = np.zeros(len(some), np.int64)
        for k in range(SHORTEST - 1):
            point = self.low[np.minimum(self.starts[some] + k, len(self.low) - 1)]
            octets += np.where(size[some] > k, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000).astype(np.int64), 0)
        self.short = np.zeros(len(size), bool)
        self.short[some] = octets < SHORTEST
        self.chunk = np.array(order, np.int64)[np.searchsorted(starts, self.starts, "right") - 1]

    def text(self, k: int) -> str:
        return self.low[self.starts[k] : self.ends[k]].tobytes().decode("utf-32-le")

    def numbers(self) -> np.ndarray:
        """A number for each word, the same for equal ones only: equal hashes are held against their characters."""
        numbers, unique = pd.factorize(self.hashes)
        first = np.empty(len(unique), np.int64)
        first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        size = self.ends - self.starts
        model = first[numbers]
        at = np.repeat(self.starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        other = at + np.repeat(self.starts[model] - self.starts, size)
        same = size == size[model]
        if len(size):
            same &= np.logical_and.reduceat(self.low[at] == self.low[np.minimum(other, len(self.low) - 1)], np.cumsum(size) - size)
        odd: dict[str, int] = {}
        for k in np.flatnonzero(~same).tolist():
            numbers[k] = len(unique) + odd.setdefault(self.text(k), len(odd))
        return numbers


def is_term(term: str, max_n: int) -> bool:
    """Whether a chunk can have it as a term: up to max_n words, none of them empty, a stop word neither first nor last, not too short."""
    words = term.split(" ")
    return len(words) <= max_n and all(words) and words[0] not in _STOPS and words[-1] not in _STOPS and len(term.encode()) >= SHORTEST
