"""A word lexicon as a minimal acyclic transducer: shared prefixes and suffixes, token ids as outputs, read through a memory map.

Words are inserted in sorted order and each finished branch is replaced by an equal one if there is any (Daciuk et al.,
2000), so equal suffixes are one. Transitions carry additive outputs: their sum along a word is the word's position in
sorted order, which addresses its token ids. Transitions are stored in the order of (state, byte); a batch of words walks
the automaton together, one search per byte position.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_PARTS = ("keys", "target", "out", "final", "offsets", "ids")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] steps, then the same for the next."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Transitions and finality per state, and the start state, of the minimal automaton of sorted distinct words."""
    edges: list[dict[int, int]] = []
    final: list[bool] = []
    register: dict[tuple, int] = {}
    path: list[tuple[dict[int, int], list[bool]]] = [({}, [False])]  # the branch that can still change

    def frozen(node: tuple[dict[int, int], list[bool]]) -> int:
        key = (node[1][0], tuple(node[0].items()))
        if key not in register:
            register[key] = len(edges)
            edges.append(node[0])
            final.append(node[1][0])
        return register[key]

    def shorten(to: int, word: bytes) -> None:
        while len(path) - 1 > to:
            state = frozen(path.pop())
            path[-1][0][word[len(path) - 1]] = state

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        shorten(shared, last)
        path.extend(({}, [False]) for _ in word[shared:])
        path[-1][1][0] = True
        last = word
    shorten(0, last)
    return edges, final, frozen(path.pop())


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of these words as one blob."""
    words = sorted(entries)
    edges, final, start = _minimal(words)
    count = [0] * len(edges)  # words from a state on; targets are frozen before the states that point to them
    keys, target, out = [], [], []
    for s, (row, end) in enumerate(zip(edges, final, strict=True)):
        before = int(end)
        for b in sorted(row):
            keys.append(s << 8 | b)
            target.append(row[b])
            out.append(before)
            before += count[row[b]]
        count[s] = before
    lengths = [len(entries[w]) for w in words]
    arrays = [keys or [-1], target or [0], out or [0], final, np.concatenate(([0], np.cumsum(lengths))), [i for w in words for i in entries[w]]]
    arrays = [np.array(a, np.int64) for a in arrays]
    return np.array([start, *map(len, arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Lookup in a compiled lexicon, mapped from an unnamed file of this process."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self._map, np.int64, 1 + len(_PARTS))
        self.start, at = int(head[0]), head.nbytes
        for name, n in zip(_PARTS, head[1:].tolist(), strict=True):
            setattr(self, name, np.frombuffer(self._map, np.int64, n, at))
            at += 8 * n

    def find(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Position in the lexicon of each word flat[begin : begin + length], -1 if it is not there."""
        found = np.full(len(begin), -1, np.int64)
        live, state, index, depth = np.arange(len(begin)), np.full(len(begin), self.start), np.zeros(len(begin), np.int64), 0
        while len(live):
            ends = length[live] == depth
            if ends.any():
                whole = ends & (self.final[state] == 1)
                found[live[whole]] = index[whole]
                live, state, index = live[~ends], state[~ends], index[~ends]
            key = state << 8 | flat[begin[live] + depth].astype(np.int64)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at, index = live[ok], at[ok], index[ok]
            state, index, depth = self.target[at], index + self.out[at], depth + 1
        return found
