"""Token counts through a digest cache.

The count of a text is a function of its content and of the tokenizer alone. So counts are stored under
(tokenizer version, content digest), a folder per version; a run joins the distinct digests of its documents to the store, encodes one
copy of each distinct content that misses, and appends those counts, which the next run finds. Texts never travel by digest, so a content that a third of
all rows share makes no hot task: the one copy to encode is known by (digest, doc_id). While the misses are few enough to broadcast 64-bit keys of
them, their texts are encoded where they are read; else they are fetched by a shuffle.

Normalisation of content is only what cannot change a count: null becomes the empty text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BLOCK, ByteBpe, covered
from .common import blocks, bounded, fresh_path, id_text, written

CACHE_SCHEMA = "digest binary, n_tokens bigint, version string"
#: Keys of misses, 8 bytes each, up to which they are broadcast.
BROADCAST_KEYS = 1 << 20


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file is another version of the cache."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Exact token counts of texts: by the encoder of this package where it covers the tokenizer, else by the library itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.bpe = ByteBpe(path) if covered(json.load(f)) else None
        if self.bpe is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        if self.bpe is not None:
            return [len(x) for x in self.bpe.encode(texts)]
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for part in blocks(batches, BLOCK):
            unique = dict(zip(part.column("digest").to_pylist(), part.column("text").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(unique), pa.binary()), pa.array(counter.counts(list(unique.values())), pa.int64())], ["digest", "n_tokens"])

    return bounded(texts).mapInArrow(run, "digest binary, n_tokens bigint")


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of a version, one row a digest; none where the cache is not there yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _texts(rows: DataFrame, misses: DataFrame, keys: int) -> DataFrame:
    """(digest, text) of the rows that misses, (digest, rep), name. By 64-bit keys it may hold another row too, whose count is then simply known as well."""
    if misses.count() <= keys:
        key = F.xxhash64("digest", "doc_id")
        few = misses.select(F.xxhash64("digest", "rep").alias("key")).distinct()
        return rows.withColumn("key", key).join(F.broadcast(few), "key", "left_semi").select("digest", "text")
    named = (F.col("r.digest") == F.col("m.digest")) & F.col("r.doc_id").eqNullSafe(F.col("m.rep"))
    return rows.alias("r").join(misses.alias("m"), named).select("r.digest", "r.text")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024, keys: int = BROADCAST_KEYS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    tokenizer: a tokenizers .json file at the same place on every machine. cache: folder of the store, which later runs
    extend; None: a new one in the shared folder. Repeated rows, equal texts under several ids and null ids each give a
    row; a null text counts as empty, with 0 tokens; a text of any length is encoded whole, in a block of its own if it is long; an empty table gives no
    rows. Columns besides doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    cache = cache or fresh_path(spark, "token-cache")
    version = tokenizer_version(tokenizer)
    rows = id_text(docs).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    keyed = written(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    wanted = keyed.groupBy("digest").agg(F.min("doc_id").alias("rep")).join(cached(spark, cache, version), "digest", "left")
    wanted = written(wanted, "token-counts")
    misses = wanted.filter("n_tokens is null").select("digest", "rep")
    known = wanted.filter("n_tokens is not null").select("digest", "n_tokens")
    if not misses.isEmpty():
        fresh = written(encode_counts(_texts(rows, misses, keys), tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-fresh")
        fresh.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
        known = known.union(fresh)
    return keyed.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
