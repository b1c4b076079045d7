"""Blockwise suffix sorting by a difference cover (after Burkhardt & Kaerkkaeinen, 2003, and Kaerkkaeinen, 2007).

A difference cover D of the residues modulo V has, for any two positions i and j, a shift below V that takes both to positions whose
residues are in D. So once the suffixes at those sampled positions are ranked, two suffixes that agree on their first V
bytes are told apart by one comparison of ranks, however long they agree. Memory is a few words per position of the block.
"""

from __future__ import annotations

import numpy as np

V = 31
#: A difference cover modulo 31: every residue is the difference of two of these. Fixed values.
COVER = (1, 5, 11, 24, 25, 27)
_IN = np.isin(np.arange(V), COVER)
#: The shift for each pair of residues.
SHIFT = np.array([[next(d for d in range(V) if _IN[(i + d) % V] and _IN[(j + d) % V]) for j in range(V)] for i in range(V)])


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, in the order of bytes."""
    n = len(text) - 7
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | text[k : k + n].astype(np.uint64)
    return out


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each row of keys, the first key being the most significant; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), np.int64)
    for key in keys:
        step[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Rank of the suffix at each sampled position below n, compared to at least `depth` bytes; -1 elsewhere."""
    at = np.flatnonzero(_IN[np.arange(n) % V])
    rank = _dense([words[at + k] for k in (0, 8, 16, 24)])
    full = np.full(n + 4 * V + depth, -1, np.int64)
    reach = V
    while True:
        full[at] = rank
        if reach >= depth:
            return full
        rank = _dense([rank, full[at + reach]])
        reach *= 2


def equal_windows(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at starts and tells which share their first `depth` bytes.

    Gives the starts in suffix order and a class per entry; equal classes, which are neighbours, are equal windows. text must go on for
    `depth` bytes from every start.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 4 * V + 40, np.uint8)))
    words = _words(padded)
    rank = cover_ranks(words, n, depth)
    prefix = _dense([words[starts + k] for k in (0, 8, 16, 24)])
    order = np.argsort(prefix, kind="stable")
    at, group = starts[order], prefix[order]
    draw = np.random.default_rng(1)
    open_ = np.ones(len(at), bool)  # not yet known to be alone or equal to its whole group
    while True:
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(begin, len(group)))
        todo = np.repeat(size > 1, size) & open_
        if not todo.any():
            break
        # three-way split of every open group by a pivot of its own
        pivot = at[np.repeat(begin + (draw.random(len(begin)) * size).astype(np.int64), size)]
        rows = np.flatnonzero(todo)
        i, p = at[rows], pivot[rows]
        shift = SHIFT[i % V, p % V]
        side = np.full(len(at), 1, np.int64)
        side[rows] = 1 + np.sign(rank[i + shift] - rank[p + shift])
        open_[rows] = side[rows] != 1
        key = group * 3 + side
        order = np.argsort(key, kind="stable")
        at, open_, key = at[order], open_[order], key[order]
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    # neighbours that differ only beyond the depth are one class
    same = np.concatenate(([False], group[1:] == group[:-1]))
    rest = np.flatnonzero(~same)[1:]
    for k in [*range(0, depth - 7, 8), depth - 8]:
        rest = rest[words[at[rest] + k] == words[at[rest - 1] + k]]
    same[rest] = True
    return at, np.cumsum(~same)
