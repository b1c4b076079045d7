"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints of 64 bits link when at most 3 bits differ. Covering LSH (Pagh, 2016) takes a map m from bit positions to
{0,1}^4 and, for each non-zero v of {0,1}^4, the mask of those positions i with <m(i), v> = 1. Three differing
positions span at most a 3-dimensional space, so some v is orthogonal to all of them: its mask keeps none of the
differing bits, and the pair meets in that table. With every value of {0,1}^4 given to 4 positions, each of the 15 masks
has 32 bits.

Equal fingerprints are one node. A bucket of more than SMALL distinct fingerprints is dealt again by covering masks over the 32
bits its table left out, so at the second level 48 bits are the same and a bucket holds at most 2^16 fingerprints,
whatever the data. Within a bucket pairs are compared, but only a spanning forest of those within the radius leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bounded, id_text, nested, text_bytes, written
from .components import components

RADIUS = 3
SHINGLE = 3
#: Distinct fingerprints of a first-level bucket beyond which it is dealt again.
SMALL = 256


def covering_masks(positions: list[int]) -> list[int]:
    """The 15 masks over these bit positions; two fingerprints that differ in at most 3 of them agree under one mask at least."""
    side = 1 << (RADIUS + 1)
    value = {p: k % side for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (value[p] & v).bit_count() & 1) for v in range(1, side)]


def tables() -> list[tuple[int, list[int]]]:
    """Each first-level mask with the second-level masks over the bits that it leaves out."""
    return [(mask, covering_masks([p for p in range(64) if not mask >> p & 1])) for mask in covering_masks(list(range(64)))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    """SimHash of the word 3-shingles of a text (UTF-8), repeats included; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= SHINGLE:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    view, h = memoryview(line), xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):  # a very long text needs no more memory than a short one
        some = [h(view[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * votes > len(starts)).astype(np.uint8), bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp bigint) per row; h, a hash of the text, tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            found = np.array([fingerprint(t) for t in text_bytes(part.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])

    return bounded(id_text(docs).withColumn("h", F.xxhash64("text"))).mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


class Forest:
    """Links found so far among the rows of a batch, as a union-find without pairs that add nothing."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root[:] = root[root]


def near_links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what can be reached by links within each group. group: sorted ids; fp: uint64, distinct within a group."""
    n = len(fp)
    forest = Forest(n)
    sizes = np.bincount(group - group[0]) if n else np.zeros(0, int)
    for shift in range(1, int(sizes.max(initial=1))):
        a = np.flatnonzero(group[shift:] == group[:-shift])
        for k in range(0, len(a), 1 << 20):
            some = a[k : k + (1 << 20)]
            near = np.bitwise_count(fp[some] ^ fp[some + shift]) <= RADIUS
            forest.link(some[near], some[near] + shift)
    moved = np.flatnonzero(forest.root != np.arange(n))
    return fp[moved], fp[forest.root[moved]]


def bucket_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp) to edges (u, v); each bucket's rows come together in one task, bucket after bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            key = np.stack([table.column(k).to_numpy() for k in keys])
            group = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))))
            u, v = near_links(group, table.column("fp").to_numpy().view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:  # the last bucket of a batch may go on in the next one
            key = np.stack([batch.column(k).to_numpy() for k in keys])
            if not batch.num_rows:
                continue
            last = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield out([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield out(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u bigint, v bigint")


def links(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp`, enough to connect all that links within the radius connect."""
    made = tables()

    def dealt(masks: list[int]) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks))))

    first = fps.select("fp", dealt([m for m, _ in made]).alias("b")).select("fp", "b.t", "b.key")
    sizes = written(first.groupBy("t", "key").count().filter("count > 1"), "bucket-sizes")
    both = first.join(sizes, ["t", "key"])
    flat = bucket_links(both.filter(F.col("count") <= small).select("t", "key", "fp"), ["t", "key"])
    if not sizes.filter(F.col("count") > small).head(1):
        return flat
    large = both.filter(F.col("count") > small)
    inner = F.array(*(F.array(*(F.lit(_signed(m)) for m in masks)) for _, masks in made))
    again = large.select("t", "key", "fp", F.posexplode(F.element_at(inner, F.col("t") + 1)).alias("t2", "mask")).select("t", "key", "fp", "t2", F.col("fp").bitwiseAND(F.col("mask")).alias("key2"))
    full = again.groupBy("t", "key", "t2", "key2").count().filter("count > 1").drop("count")
    return flat.union(bucket_links(again.join(full, ["t", "key", "t2", "key2"]), ["t", "key", "t2", "key2"]))


def simhash_components(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    Texts without words (null, empty, white space) have fingerprint zero and link like others. Rows with a null doc_id
    belong to their component but never name it, unless it has no other rows: then component_id is null. Repeated rows
    each give a row. Texts of any length are hashed whole, in bounded memory beyond the text itself. An empty table gives no rows. Columns besides doc_id and text are not looked at.
    """
    found = written(fingerprints(docs), "fingerprints")
    named = _roots(found, small)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _roots(found: DataFrame, small: int) -> DataFrame:
    """(fp, least, root): each distinct fingerprint, its least doc_id, and the fingerprint that names its component."""
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = components(written(links(nodes.select("fp"), small), "links"))
    return nodes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def simhash_filter(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (null last, then the least hash of the text), all columns kept, whatever they are called. Other cases as in simhash_components."""
    found = written(fingerprints(docs), "fingerprints")
    named = _roots(found, small)
    # the least row of a fingerprint first, so that a group with very many rows is aggregated before it is joined
    first = found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first"))
    stay = first.join(named, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("stay_id"), F.col("first.h").alias("stay_h"))
    rows = nested(docs).drop("row_text")
    both = rows.join(stay, F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("row_hash") == F.col("stay_h")), "left_semi")
    order = Window.partitionBy("row_id", "row_hash").orderBy(*(F.col("row")[c] for c in docs.columns if c != "text"))
    return both.withColumn("copy", F.row_number().over(order)).filter("copy = 1").select("row.*")
