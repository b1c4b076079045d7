"""Pre-tokens of byte-level BPE for a block of texts at once, on arrays.

The published pattern  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+  is regular enough
for that: a pre-token is a run of letters, digits or other marks, with one space before it if there is one; of a run of white space that goes
before something else, the last character stands alone, or is that one space; an apostrophe that opens a run of marks
takes the letters of a contraction with it.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, MARK, UNKNOWN = 1, 2, 3, 4, 5


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point. UNKNOWN: not assigned in this Python's Unicode tables, so other libraries may differ."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((UNKNOWN if (k := unicodedata.category(chr(c))) == "Cn" else kinds.get(k[0], MARK) for c in range(0x110000)), np.uint8, 0x110000)
    # Unicode's White_Space: a fixed list
    for low, high in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[low : high + 1] = SPACE
    return out


def has_unknown(text: str) -> bool:
    return not text.isascii() and bool((classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNKNOWN).any())


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, where each pre-token starts, and where the pre-tokens of each text end (in pre-tokens)."""
    joined = "".join(texts)
    flat = np.frombuffer(joined.encode(), np.uint8)
    n = len(joined)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if not n:
        return flat, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes()[point]
    opens = np.zeros(n + 1, bool)  # a text starts here
    opens[0] = True
    opens[ends] = True
    same = np.zeros(n, bool)  # of the same class and text as the character before
    same[1:] = kind[1:] == kind[:-1]
    same &= ~opens[:-1]
    starts = ~same
    space = kind == SPACE
    last = np.zeros(n, bool)  # last of a run of white space that something follows
    last[:-1] = space[:-1] & ~space[1:] & ~opens[1:-1]
    starts |= last
    blank = last & (point == 32)
    starts[1:] &= ~blank[:-1]
    quote = np.flatnonzero(starts & (point == 39))
    if len(quote):
        ahead = np.zeros((2, len(quote)), np.uint32)
        for k in (0, 1):
            there = quote + k + 1 < n
            at = quote[there]
            ok = ~opens[at + 1] if k == 0 else ~opens[at + 1] & ~opens[at + 2]
            ahead[k, np.flatnonzero(there)[ok]] = point[at[ok] + k + 1]
        one = np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (ahead[0] == ord(a)) & (ahead[1] == ord(b))
        starts[quote[one | two] + 1] = False
        for which, k in ((one, 2), (two, 3)):
            after = quote[which] + k
            starts[after[after < n]] |= ~space_attached(starts, blank, after[after < n])
    at = np.flatnonzero(starts)
    wide = point >= 0x80
    if wide.any():
        width = 1 + wide.astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
        offset = np.cumsum(width) - width
        begin = offset[at]
    else:
        begin = at.astype(np.int64)
    return flat, begin, np.searchsorted(at, ends)


def space_attached(starts: np.ndarray, blank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character belongs to a space right before it."""
    return blank[at - 1]


@functools.cache
def _table() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, (64, 256), dtype=np.int64).astype(np.uint64)


def distinct(flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one of each distinct word among begin, and for each word which of these it equals. The hashes are checked byte by byte."""
    length = np.diff(np.append(begin, len(flat)))
    depth = (np.arange(len(flat)) - np.repeat(begin, length)) & 63
    hashes = np.add.reduceat(_table()[depth, flat], begin)
    hashes ^= length.astype(np.uint64) << np.uint64(40)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    model = first[inverse]
    if (length[model] == length).all():
        shift = np.repeat(begin[model] - begin, length)
        if (flat[np.arange(len(flat)) + shift] == flat).all():
            return first, inverse
    seen: dict[bytes, int] = {}  # two words with one hash
    raw = flat.tobytes()
    inverse = np.fromiter((seen.setdefault(raw[a : a + k], len(seen)) for a, k in zip(begin.tolist(), length.tolist(), strict=True)), np.int64, len(begin))
    return np.unique(inverse, return_index=True)[1], inverse
