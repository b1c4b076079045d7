"""Removal of repeated substrings: every byte that a 200-byte string covers which starts anywhere else in the corpus.

Suffixes are dealt to buckets by content: each 200-byte window belongs to the bucket of its anchor, the 32-byte gram of
least hash in it (winnowing: Schleimer, Wilkerson & Aiken, 2003), so equal windows meet in one bucket and consecutive
windows with one anchor travel as one snippet. Anchors that occur once hold no repeats. Snippets that are equal as wholes are
counted, not compared. Where an anchor has several different snippets, a bucket's suffixes are sorted one
bucket at a time, long ties being resolved by precomputed ranks of a difference-cover sample (cover_sort), and neighbours that share
200 bytes are repeats. An anchor with very many different snippets, as at the border of a passage that a large
part of the corpus quotes, would make a bucket without bound: its windows are compared by 128-bit digests instead, first
within batches of snippets and then, one of each different window, across them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, id_text, text_bytes, written
from .cover_sort import equal_windows

LENGTH = 200
GRAM = 32
GRAMS = LENGTH - GRAM + 1
#: Bytes that are looked at together, of one long text or of many; bytes of snippets that are sorted together.
BLOCK, BUCKET = 1 << 20, 1 << 20
#: Different snippets of an anchor from which on its windows are grouped by digest.
MANY = 1024
_BASE = 0x9E3779B97F4A7C15 | 1
_KEYS = ["doc_id", "h"]


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                row = np.full(n, base, np.uint64)
                row[0] = 1
                made.append(np.multiply.accumulate(row))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


def gram_hashes(flat: np.ndarray, powers: Powers) -> np.ndarray:
    """A mixed rolling hash of the GRAM bytes from each position on."""
    up, down = powers.get(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(flat) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def snippets(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Anchor hash, anchor position, first and last window start of each run of windows with one anchor; begin and end bound the texts in flat."""
    hashes = gram_hashes(flat, powers)
    place = np.uint64((1 << 24) - 1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < GRAMS:
        least = np.minimum(least[: len(least) - (GRAMS - width)], least[GRAMS - width :])
    size = np.maximum(end - begin - LENGTH + 1, 0)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))  # valid window starts
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    anchor = (least[at] & place).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return hashes[anchor[first]], anchor[first], at[first], at[last]


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) in groups of about BLOCK bytes; a long text is cut into pieces that overlap by LENGTH - 1 bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, t in enumerate(texts):
        for offset in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            part = t[offset : offset + BLOCK + LENGTH - 1]
            if size and size + len(part) > 2 * BLOCK:
                yield held
                held, size = [], 0
            held.append((row, offset, part))
            size += len(part)
    if held:
        yield held


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, h, text) to a row per snippet: doc_id, h, anchor, digest, first (byte offset), size (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, digest = Powers(), xxhash.xxh3_64_intdigest
        for part in blocks(batches, BLOCK):
            ids, hs = part.column("doc_id"), part.column("h")
            for group in pieces(text_bytes(part.column("text"))):
                joined = b"".join(b for _, _, b in group)
                end = np.cumsum([len(b) for _, _, b in group])
                begin = np.concatenate(([0], end[:-1]))
                if len(joined) < LENGTH:
                    continue
                anchor, at, first, last = snippets(np.frombuffer(joined, np.uint8), begin, end, powers)
                owner = np.searchsorted(end, first, side="right")
                view = memoryview(joined)
                found = [digest(view[a:b], s) for a, b, s in zip(first.tolist(), (last + LENGTH).tolist(), (at - first).tolist(), strict=True)]
                row = pa.array(np.array([k for k, _, _ in group])[owner])
                offset = first - begin[owner] + np.array([o for _, o, _ in group])[owner]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), hs.take(row), pa.array(anchor.view(np.int64)), pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(offset.astype(np.int64)), pa.array((last - first + LENGTH).astype(np.int32))],
                    ["doc_id", "h", "anchor", "digest", "first", "size"],
                )

    return bounded(rows).mapInArrow(run, "doc_id bigint, h bigint, anchor bigint, digest bigint, first bigint, size int")


def _cut_out(texts: DataFrame) -> DataFrame:
    """(text, wanted: array of (anchor, digest, copies, first, size)) to (anchor, digest, copies, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, BLOCK):
            rows = []
            for t, wanted in zip(text_bytes(part.column("text")), part.column("wanted").to_pylist(), strict=True):
                rows += [(w["anchor"], w["digest"], w["copies"], t[w["first"] : w["first"] + w["size"]]) for w in wanted]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], ["anchor", "digest", "copies", "bytes"])

    return bounded(texts).mapInArrow(run, "anchor bigint, digest bigint, copies bigint, bytes binary")


def repeated_ranges(parts: list[bytes]) -> list[tuple[int, int, int]]:
    """(snippet, start, end) of what windows cover that occur in these snippets twice or more."""
    flat = np.frombuffer(b"".join(parts), np.uint8)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(size) - size
    count = size - LENGTH + 1
    starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    at, group = equal_windows(flat, starts, LENGTH)
    hit = np.sort(at[np.bincount(group)[group] > 1])
    if not len(hit):
        return []
    owner = np.searchsorted(begin, hit, side="right") - 1
    new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])))
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hit)) - 1
    base = begin[owner[first]]
    return list(zip(owner[first].tolist(), (hit[first] - base).tolist(), (hit[last] - base + LENGTH).tolist(), strict=True))


def _sorted_ranges(rows: DataFrame) -> DataFrame:
    """(anchor, digest, bytes) to (anchor, digest, start, end): bucket after bucket, each of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def out(some: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            found = repeated_ranges([b for _, _, b in some])
            columns = [[some[k][0] for k, _, _ in found], [some[k][1] for k, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "digest", "start", "end"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "bytes")), strict=True):
                if size >= BUCKET and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield out(held)

    return rows.select("anchor", "digest", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor bigint, digest bigint, start bigint, end bigint")


def _merged(owner: np.ndarray, start: np.ndarray, rows: list[tuple]) -> pa.RecordBatch:
    """Windows of snippets, sorted by snippet and start, as ranges."""
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))) if len(owner) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner))[: len(first)] - 1
    at = owner[first].tolist()
    columns = [[rows[k][0] for k in at], [rows[k][1] for k in at], start[first], start[last] + LENGTH]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "digest", "start", "end"])


#: A window of a hot anchor, as it travels: its 128-bit digest, its snippet, and where it starts in it.
_RECORD = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("anchor", "<i8"), ("digest", "<i8"), ("start", "<i4")])


def _digest_ranges(rows: DataFrame, windows: int) -> DataFrame:
    """The same for anchors with very many snippets, through a digest of every window; windows: about how many there are.

    A batch of snippets finds the repeats within itself, and sends one record of each different window on, packed by buckets of digests. So a
    window that very many snippets share reaches its bucket once per batch, and a bucket's size follows from the number of buckets.
    """
    buckets = max(16, windows // 500_000)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        low = (1 << 64) - 1

        def out(some: list[tuple]) -> Iterator[pa.RecordBatch]:
            count = np.array([len(r[3]) - LENGTH + 1 for r in some])
            owner = np.repeat(np.arange(len(some)), count)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            made = [digest(v[k : k + LENGTH], r[0] & low) for r in some for v in (memoryview(r[3]),) for k in range(len(r[3]) - LENGTH + 1)]
            records = np.empty(len(made), _RECORD)
            records["w1"], records["w2"] = [x & low for x in made], [x >> 64 for x in made]
            records["anchor"], records["digest"], records["start"] = np.array([r[0] for r in some])[owner], np.array([r[1] for r in some])[owner], start
            _, first, group, n = np.unique(records[["w1", "w2"]], return_index=True, return_inverse=True, return_counts=True)
            twice = (n[group] > 1) | (np.array([r[2] for r in some])[owner] > 1)
            found = _merged(owner[twice], start[twice], some)
            yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.int64()), pa.nulls(found.num_rows, pa.binary())], names)
            sent = records[first]
            at = (sent["w1"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(buckets + 1))
            full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
            blobs = [sent[order[edges[b] : edges[b + 1]]].tobytes() for b in full]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(full), pa.int64()) for _ in range(4)), pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], names)

        names = ["anchor", "digest", "start", "end", "bucket", "blob"]
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "copies", "bytes")), strict=True)
            if len(held) >= 8 * MANY:
                yield from out(held)
                held = []
        if held:
            yield from out(held)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(blobs: list[bytes]) -> pa.RecordBatch:
            records = np.frombuffer(b"".join(blobs), _RECORD)
            _, group, n = np.unique(records[["w1", "w2"]], return_inverse=True, return_counts=True)
            hit = records[n[group] > 1]
            hit = hit[np.lexsort((hit["start"], hit["digest"], hit["anchor"]))]
            return _merged(np.arange(len(hit)), hit["start"].astype(np.int64), hit[["anchor", "digest"]].tolist())

        held: list[bytes] = []
        now = None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if bucket != now and held:
                    yield out(held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield out(held)

    schema = "anchor bigint, digest bigint, start bigint, end bigint"
    made = written(bounded(rows).mapInArrow(near, f"{schema}, bucket bigint, blob binary"), "hot-windows")
    packed = made.filter("bucket is not null").select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket")
    return made.filter("bucket is null").select("anchor", "digest", "start", "end").union(packed.mapInArrow(far, schema))


def repeated_spans(rows: DataFrame, many: int = MANY) -> DataFrame:
    """(doc_id, h, text) to (doc_id, h, start, end), byte ranges that repeats cover; they may overlap."""
    occ = written(occurrences(rows.filter(F.octet_length("text") >= LENGTH)), "snippets")
    keys = occ.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    keys = written(keys, "anchors")  # a plain table, so that Spark can split an anchor that very many rows have
    shared = written(occ.join(keys, "anchor"), "shared-snippets")
    counts = shared.groupBy("anchor", "digest", "mixed").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h", "first", "size")).alias("one"))
    counts = written(counts, "snippet-counts")
    whole = shared.join(counts.filter("copies > 1").select("anchor", "digest"), ["anchor", "digest"]).select(*_KEYS, F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("end"))
    mixed = counts.filter("mixed")
    wanted = mixed.groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.h").alias("h")).agg(F.collect_list(F.struct("anchor", "digest", "copies", F.col("one.first").alias("first"), F.col("one.size").alias("size"))).alias("wanted"))
    cut = written(_cut_out(_keyed(rows, wanted, "inner").select("text", "wanted")).dropDuplicates(["anchor", "digest"]), "cut-snippets")
    sizes = cut.groupBy("anchor").agg(F.count("*").alias("n"))
    hot = written(sizes.filter(F.col("n") > many).select("anchor"), "hot-anchors")
    ranges = _sorted_ranges(cut.join(hot, "anchor", "left_anti"))
    if hot.head(1):
        windows = cut.join(hot, "anchor", "left_semi")
        number = windows.agg(F.sum(F.octet_length("bytes") - LENGTH + 1)).first()[0]
        ranges = ranges.union(_digest_ranges(windows, number))
    ranges = written(ranges, "ranges")
    # a snippet that occurs once is where counts found it
    alone = counts.filter("copies = 1 and mixed").select("anchor", "digest", "one.*").join(ranges, ["anchor", "digest"])
    return whole.union(alone.select(*_KEYS, (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end")))


def _keyed(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    a, b = rows.alias("a"), other.alias("b")
    extra = [F.col(f"b.{c}") for c in other.columns if c not in _KEYS]
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")), how).select("a.*", *extra)


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The rest of text without the spans, how many bytes go, and in how many maximal runs."""
    kept, gone, runs, at = [], 0, 0, 0
    open_until = -1
    for start, end in sorted(spans):
        if start > open_until:
            runs += 1
            kept.append(text[at:start])
        gone += max(0, end - max(start, open_until))
        open_until = max(open_until, end)
        at = open_until
    kept.append(text[at:])
    return b"".join(kept), gone, runs


def remove_repeats(docs: DataFrame, many: int = MANY) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (bytes) without the bytes that repeated 200-byte strings cover.

    Texts are UTF-8; null counts as empty; texts under 200 bytes stay whole. Repeated rows are documents of their own, so from 200 bytes
    on they vanish. Texts of any length are looked at whole, in overlapping pieces. Rows of one id with different texts, and null ids, are kept apart by a hash of the text. An
    empty table gives no rows. Only doc_id and text are looked at.
    """
    rows = id_text(docs).withColumn("h", F.xxhash64("text"))
    spans = repeated_spans(rows, many).groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, BLOCK):
            texts = text_bytes(part.column("text"))
            made = [without(t, [(s["start"], s["end"]) for s in spans or []]) for t, spans in zip(texts, part.column("spans").to_pylist(), strict=True)]
            numbers = ([len(t) for t in texts], [m[1] for m in made], [m[2] for m in made])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in numbers), pa.array([m[0] for m in made], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return bounded(_keyed(rows, spans, "left").select("doc_id", "text", "spans")).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

