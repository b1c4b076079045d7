"""Byte-level BPE encoding and decoding over a transducer lexicon.

Frequent words, counted over all documents by mergeable heavy-hitter summaries (Misra & Gries, 1982), are compiled with
their token ids into a minimal acyclic transducer, which workers read through a memory map. A word that is not in it is merged
exactly, many words at a time. What is frequent decides the speed only, never a result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, id_text, written
from .bytewords import distinct, has_unknown, split_words
from .lexicon import Lexicon, compile_lexicon, ragged

#: Words of the lexicon, counters of each summary, and the longest word that is compiled: they bound what is broadcast.
WORDS, LONGEST = 32_768, 64
#: Bytes of text that are encoded at once.
BLOCK = 1 << 20
#: Bytes of a word beyond which it is merged by itself.
LONG = 256

_NONE = np.iinfo(np.int32).max


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


class ByteBpe:
    """The vocabulary of a tokenizers .json file (byte-level BPE without normaliser) and exact merging.

    lexicon: known words, found before anything is merged.
    """

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        if not covered(made):
            raise ValueError(f"{path}: only byte-level BPE without normaliser and prefix space is covered")
        model = made["model"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.path, self.lexicon = path, lexicon
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        keys = np.array([(a << 32) | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.array([k for k, _ in self.rank.values()], np.int64)[order]
        self._made = np.array([t for _, t in self.rank.values()], np.int64)
        # leftmost, and the longest of those that start there
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._library = None

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)

    def merge(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words flat[begin : begin + length], one after the other, and how many each has."""
        long = np.flatnonzero(length > LONG)
        short = np.flatnonzero(length <= LONG)
        words, tokens = self._merge_short(flat[ragged(begin[short], length[short])], np.repeat(short, length[short]))
        for k in long.tolist():
            found = self._merge_long(flat[begin[k] : begin[k] + length[k]].tobytes())
            words, tokens = np.append(words, np.full(len(found), k)), np.append(tokens, found)
        order = np.argsort(words, kind="stable")
        return tokens[order], np.bincount(words, minlength=len(begin))

    def _merge_short(self, flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and id of each token; in every round each word merges all places of its lowest-ranked pair."""
        flat = self.first[flat]
        done_word, done_flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rank = np.full(len(flat), _NONE, np.int64)  # of each symbol with the next one of its word
        if len(flat) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self._pair_ranks(flat[:-1], flat[1:]), _NONE)
        while len(flat):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(begin, len(flat)))
            least = np.repeat(np.minimum.reduceat(rank, begin), size)
            over = least == _NONE
            if over.any():
                done_word.append(word[over])
                done_flat.append(flat[over])
                keep = ~over
                flat, word, rank, least = flat[keep], word[keep], rank[keep], least[keep]
                if not len(flat):
                    break
            hit = rank == least
            touch = hit.copy()
            touch[1:] &= hit[:-1]
            touch[0] = False
            if touch.any():  # of a chain like aaa every second pair merges, from the left
                at = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~touch, at, 0))
                hit &= (at - start) % 2 == 0
            at = np.flatnonzero(hit)
            flat[at] = self._made[rank[at]]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            flat, word, rank, merged = flat[keep], word[keep], rank[keep], hit[keep]
            stale = merged.copy()  # a merged symbol and the one before it have new neighbours
            stale[:-1] |= merged[1:]
            at = np.flatnonzero(stale)
            rank[at] = _NONE
            inner = at[at + 1 < len(flat)]
            same = inner[word[inner] == word[inner + 1]]
            rank[same] = self._pair_ranks(flat[same], flat[same + 1])
        return np.concatenate(done_word), np.concatenate(done_flat)

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one long word, by a heap of pairs over a linked list."""
        tokens = self.first[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(tokens)), -1]
        before = list(range(-1, len(tokens) - 1))
        heap = [(self.rank[p][0], k, p) for k in range(len(tokens) - 1) if (p := (tokens[k], tokens[k + 1])) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            right = after[k]
            if right < 0 or tokens[k] < 0 or (tokens[k], tokens[right]) != pair:
                continue
            tokens[k], tokens[right] = self.rank[pair][1], -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (p := (tokens[left], tokens[after[left]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], left, p))
        return [t for t in tokens if t >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not any(map(has_unknown, texts)):
            return split_words(texts)
        # characters that are newer than this Python: the library itself says where its words start
        if self._library is None:
            from tokenizers import pre_tokenizers

            self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        cut = [[t[a:b].encode() for _, (a, b) in self._library.pre_tokenize_str(t)] for t in texts]
        words = [w for ws in cut for w in ws]
        size = np.fromiter(map(len, words), np.int64, len(words))
        return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, np.cumsum([len(ws) for ws in cut])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, which hold no special tokens, one after the other, and where each text's ids end."""
        flat, begin, ends = self._split(texts)
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        first, inverse = distinct(flat, begin)
        length = np.diff(np.append(begin, len(flat)))[first]
        begin = begin[first]
        count, place = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        pools, new = [], np.arange(len(first))
        if self.lexicon is not None:
            at = self.lexicon.find(flat, begin, length)
            old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            offsets = self.lexicon.offsets
            place[old], count[old] = offsets[at[old]], offsets[at[old] + 1] - offsets[at[old]]
            pools.append(self.lexicon.ids)
        tokens, many = self.merge(flat, begin[new], length[new])
        count[new] = many
        place[new] = np.cumsum(many) - many + sum(map(len, pools))
        pools.append(tokens)
        per_word = count[inverse]
        return np.concatenate(pools)[ragged(place[inverse], per_word)], np.concatenate(([0], np.cumsum(per_word)))[ends]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; a special token's string is that token."""
        parts = [self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t] for t in texts]
        plain = [p for ps in parts for p in ps[::2]]
        ids, ends = self._plain(plain)
        found = iter(np.split(ids, ends[:-1]))
        out = []
        for ps in parts:
            made = [next(found)]
            for special in ps[1::2]:
                made += [np.array([self.special[special]]), next(found)]
            out.append(made[0] if len(made) == 1 else np.concatenate(made))
        return out

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def covered(made: dict) -> bool:
    """Whether ByteBpe covers the tokenizer of this parsed .json file."""
    pre, model = made.get("pre_tokenizer") or {}, made["model"]
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in made["added_tokens"])
    return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not made["normalizer"] and model["type"] == "BPE" and not model.get("ignore_merges") and plain


def frequent_words(docs: DataFrame, words: int = WORDS) -> list[str]:
    """The words (between white space) of all documents that are most frequent by merged Misra-Gries summaries, at most `words`, in order of the alphabet."""

    def pruned(counts: Counter) -> Counter:
        if len(counts) <= words:
            return counts
        least = heapq.nlargest(words + 1, counts.values())[-1]
        return Counter({w: n - least for w, n in counts.items() if n > least})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in blocks(batches):
            for text in part.column("text").to_pylist():
                counts.update(text.split())
            if len(counts) > 8 * words:
                counts = pruned(counts)
        counts = pruned(counts)
        rows = [(w, n) for w, n in counts.items() if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    counts = bounded(id_text(docs)).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * 8).cast("int")
    merged = written(counts.withColumn("level", level), "word-counts")
    # words that are as frequent on a logarithmic scale come together or not at all, so that no partition sends more than is used
    room, least = words, None
    for r in sorted(merged.groupBy("level").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return [] if least is None else sorted(r.word for r in merged.filter(F.col("level") >= least).select("word").collect())


def compiled(docs: DataFrame, path: str, words: int = WORDS) -> bytes:
    """The lexicon of the frequent words, as pre-tokens after a space and without one."""
    return lexicon_of([x for w in frequent_words(docs, words) for x in (" " + w, w)], ByteBpe(path))


def lexicon_of(texts: list[str], bpe: ByteBpe) -> bytes:
    """A compiled lexicon of the pre-tokens of these texts."""
    flat, begin, _ = bpe._split(texts)
    raw, edges = flat.tobytes(), [*begin.tolist(), len(flat)]
    found = sorted({raw[a:b] for a, b in zip(edges, edges[1:], strict=False) if b - a <= LONGEST})
    size = np.array([len(w) for w in found], np.int64)
    tokens, count = bpe.merge(np.frombuffer(b"".join(found), np.uint8), np.cumsum(size) - size, size)
    parts = np.split(tokens, np.cumsum(count)[:-1]) if found else []
    return compile_lexicon({w: ids.tolist() for w, ids in zip(found, parts, strict=True)})


_open: dict[tuple[str, str], ByteBpe] = {}


def _encoder(path: str, blob: bytes) -> ByteBpe:
    key = (path, hashlib.sha256(blob).hexdigest())
    if key not in _open:
        _open.clear()  # a worker serves one tokenizer and lexicon at a time
        _open[key] = ByteBpe(path, Lexicon(blob))
    return _open[key]


def _encoded(docs: DataFrame, path: str, words: int, row, schema: dict[str, pa.DataType]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(compiled(docs, path, words))
    names = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path, held.value)
        strings = [str(i).encode() for i in range(max(bpe.bytes_of) + 1)]
        for part in blocks(batches, BLOCK):
            rows = [row(bpe, strings, ids) for ids in bpe.encode(part.column("text").to_pylist())]
            columns = [part.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(schema.values()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *schema])

    return bounded(id_text(docs)).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{k} {names[v]}" for k, v in schema.items()))


def bpe_encode(docs: DataFrame, path: str, words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids. A null text encodes as the empty one; an empty table gives no rows; repeated rows
    each give a row; a special token's string in a text is that token. Columns besides doc_id and text are not looked at."""
    return _encoded(docs, path, words, lambda bpe, strings, ids: (len(ids), ids.astype(np.int32)), {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())})


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); special tokens stay, bytes that are no whole character give U+FFFD, null ids the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return bounded(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id bigint, text string")


def bpe_round_trip(docs: DataFrame, path: str, words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, and SHA-256 of the ids (decimal, comma-joined) and of the text decoded from them. Cases as in bpe_encode."""

    def row(bpe: ByteBpe, strings: list[bytes], ids: np.ndarray) -> tuple[int, str, str]:
        ids = ids.tolist()
        text = bpe.decode(ids)
        return len(ids), hashlib.sha256(b",".join([strings[i] for i in ids])).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _encoded(docs, path, words, row, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})
