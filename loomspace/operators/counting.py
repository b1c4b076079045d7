"""How many chunks of its source hold each term, for terms that reach a floor.

Nearly all n-grams of a corpus occur once or twice, and the floor drops them. So the chunks are read twice. The first pass counts hashes of (source, term), 42 bits
wide, on arrays: a sorted array per bucket of hashes and block of chunks is what it shuffles. The hashes that reach the floor become a bitmap of fixed size. The second pass
makes strings of those terms alone whose hash is marked, and counts them exactly. Terms that share a hash can only raise its count, so none is lost, and what
passes by chance falls to the exact counts: the bitmap decides how much is shuffled, never what is found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Scoring
from ..functions import words as W
from ..functions.text import SHORTEST

#: Hashes that a task gathers before it sends them.
GATHERED = 1 << 22
#: Bits of a hash, of its bucket, and of the bitmap: 32 MB before compression.
_HASH, _BUCKET, _MAP = 42, 10, 28
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(64 - _HASH)
_MOST = np.uint64((1 << (64 - _HASH)) - 1)


class _Block:
    """Words of chunks in a row, and the source of each chunk."""

    def __init__(self, texts: list[str], sources: list, kind: pa.DataType, rules: W.Rules):
        self.words, self.kind = W.Words(texts, rules), kind
        codes: dict = {}
        self.source = np.fromiter((codes.setdefault(s, len(codes)) for s in sources), np.int64, len(sources))
        self.names = list(codes)

    def places(self, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, where its terms start, and their hashes. Terms of two words or more have SHORTEST bytes in any case."""
        w = self.words
        own = np.array([int.from_bytes(blake2b(repr(s).encode(), digest_size=8).digest(), "little") for s in self.names], np.uint64)
        joined = w.hashes
        for n in range(1, max_n + 1):
            m = len(w.hashes) - n + 1
            if m <= 0:
                return
            if n > 1:
                joined = joined[:m] * _ODD + w.hashes[n - 1 :]
            fits = ~w.short if n == 1 else w.chunk[:m] == w.chunk[n - 1 :]
            at = np.flatnonzero(fits & ~w.stop[:m] & ~w.stop[n - 1 :])
            yield n, at, W.mixed(joined[at] ^ own[self.source[w.chunk[at]]]) >> _LOW

    def counts(self, max_n: int) -> np.ndarray:
        """Hash and number of chunks in one word each, sorted."""
        keys = np.concatenate([(h << _LOW) | self.words.chunk[at].astype(np.uint64) for _, at, h in self.places(max_n)] or [np.zeros(0, np.uint64)])
        keys.sort()
        keys = keys[_first(keys)]
        starts = np.flatnonzero(_first(keys >> _LOW))
        return (keys[starts] & ~_MOST) | np.diff(np.append(starts, len(keys))).astype(np.uint64)

    def terms(self, max_n: int, marked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """(source, term, df) of this block, as far as the hash is marked; terms are told apart by the numbers of their words."""
        w, ids, chunks, names = self.words, self.words.numbers(), len(self.source), len(self.names)
        low = w.low.tobytes().decode("utf-32-le")
        for n, at, h in self.places(max_n):
            if marked is not None:
                bit = h >> np.uint64(_HASH - _MAP)
                at = at[(marked[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0]
            if not len(at):
                continue
            gram = ids[at]
            for j in range(1, n):
                gram = pd.factorize(gram << 21 | ids[at + j])[0]
            gram, unique = pd.factorize(gram)
            where = np.empty(len(unique), np.int64)
            where[gram[::-1]] = at[::-1]  # the first place of each
            pairs = gram * chunks + w.chunk[at]
            pairs.sort()
            pairs = pairs[_first(pairs)]
            found = pairs // chunks * names + self.source[pairs % chunks]
            found.sort()
            starts = np.flatnonzero(_first(found))
            df, found = np.diff(np.append(starts, len(found))), found[starts]
            columns = [[low[a:b] for a, b in zip(w.starts[where + j].tolist(), w.ends[where + j].tolist(), strict=True)] for j in range(n)]
            text = pa.array(columns[0] if n == 1 else list(map(" ".join, zip(*columns, strict=True))), pa.string())
            source = pa.array(self.names, self.kind).take(pa.array(found % names))
            yield pa.RecordBatch.from_arrays([source, text.take(pa.array(found // names)), pa.array(df, pa.int64())], ["source", "term", "df"])


def _first(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], rules: W.Rules) -> Iterator[_Block]:
    texts, sources, held, kind = [], [], 0, None
    for batch in batches:
        kind = batch.schema.field("source").type
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for source, text in zip(part.column("source").to_pylist(), part.column("text").to_pylist(), strict=True):
                if held + len(text) + 1 > W.CHARACTERS and texts:
                    yield _Block(texts, sources, kind, rules)
                    texts, sources, held = [], [], 0
                texts.append(text)
                sources.append(source)
                held += len(text) + 1
    if texts:
        yield _Block(texts, sources, kind, rules)


def _sums(packed: np.ndarray) -> np.ndarray:
    """Counts of equal hashes added up; they stay below the bits that they have, which any floor is held against."""
    packed.sort()
    starts = np.flatnonzero(_first(packed >> _LOW))
    return (packed[starts] & ~_MOST) | np.minimum(np.add.reduceat(packed & _MOST, starts), _MOST)


def _sent(packed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per bucket: the rest of its hashes, and their counts."""
    hashes, counts = packed >> _LOW, (packed & _MOST).astype("<u4")
    edges = np.searchsorted(hashes, np.arange((1 << _BUCKET) + 1, dtype=np.uint64) << np.uint64(_HASH - _BUCKET))
    rest = hashes.astype("<u4")
    full = [b for b in range(1 << _BUCKET) if edges[b] < edges[b + 1]]
    keys, sums = ([x[edges[b] : edges[b + 1]].tobytes() for b in full] for x in (rest, counts))
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(keys, pa.binary()), pa.array(sums, pa.binary())], ["bucket", "hashes", "counts"])


def _marked(chunks: DataFrame, rules: W.Rules, max_n: int, least: int) -> list[tuple[int, bytes]]:
    """The part of the bitmap that each bucket has, compressed: where the counts of hashes reach the floor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in _blocks(batches, rules):
            held.append(block.counts(max_n))
            n += len(held[-1])
            if n >= GATHERED:
                yield from _sent(_sums(np.concatenate(held)))
                held, n = [], 0
        if n:
            yield from _sent(_sums(np.concatenate(held)))

    def reached(table: pa.Table) -> pa.Table:
        hashes, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<u4").astype(np.uint64) for c in ("hashes", "counts"))
        packed = (hashes << np.uint64(32)) | counts
        packed.sort()
        starts = np.flatnonzero(_first(packed >> np.uint64(32)))
        enough = starts[np.add.reduceat(packed & np.uint64(0xFFFFFFFF), starts) >= least]
        bits = np.zeros(1 << (_MAP - _BUCKET), np.uint8)
        bits[packed[enough] >> np.uint64(32 + _HASH - _MAP)] = 1
        found = pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)] if len(enough) else [], pa.binary())
        return pa.table({"bucket": table.column("bucket").slice(0, len(found)), "bits": found})

    packed = chunks.mapInArrow(count, "bucket int, hashes binary, counts binary")
    return [(r.bucket, bytes(r.bits)) for r in packed.groupBy("bucket").applyInArrow(reached, "bucket int, bits binary").collect()]


def term_frequencies(cut: DataFrame, settings: Scoring | None = None) -> DataFrame:
    """(source, ..., text) of chunks to (source, term, df): chunks of the source that hold the term, at least min_occurrences. The same as document_frequency(chunk_terms(cut))."""
    s = settings or Scoring()
    spark = cut.sparkSession
    rules, chunks, max_n = W.rules(spark), cut.select("source", "text"), s.max_n
    few = s.min_occurrences <= 1
    # counts of one hash stop at what their bits hold, so a higher floor marks by that
    parts = [] if few else _marked(chunks, rules, max_n, min(s.min_occurrences, int(_MOST)))
    held = spark.sparkContext.broadcast(parts)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = None
        if not few:
            marked = np.zeros(1 << (_MAP - 3), np.uint8)
            rows = marked.reshape(1 << _BUCKET, -1)
            for bucket, bits in held.value:
                rows[bucket] = np.frombuffer(zlib.decompress(bits), np.uint8)
        for block in _blocks(batches, rules):
            yield from block.terms(max_n, marked)

    kind = cut.schema["source"].dataType.simpleString()
    found = chunks.mapInArrow(terms, f"source {kind}, term string, df bigint")
    return found.groupBy("source", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= s.min_occurrences)
