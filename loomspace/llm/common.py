"""Plumbing that the training-data operators share: table reads and bounded Arrow batches; the shared folder is that of the library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, remove, scratch, shared_dir, written

__all__ = ["blocks", "bounded", "fresh_path", "id_text", "labelled_sample", "nested", "read_table", "remove", "scratch", "shared_dir", "text_bytes", "text_offsets", "written"]

#: Rows of one Arrow batch. Texts may be very long, so the default of 10,000 rows would not bound memory.
ARROW_ROWS = 512
#: Bytes of text that a vectorised step handles at once.
BLOCK_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by a path that only Spark has to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """df, after limiting the Arrow batches of this session, so that a worker's memory does not depend on the row count.

    Spark reads that setting when a plan runs, which for a returned DataFrame is after the operator is done, so it cannot be put back here: a
    session that has used these operators keeps batches of at most ARROW_ROWS rows. It changes no result.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty: columns of any other name cannot clash later. Ids are integers; under ANSI rules a text id that is no number is an error."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def nested(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), row_id, row_hash (of the text) and row_text (null as empty): whatever docs' columns are called, they stay apart from others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(columns.alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(text).alias("row_hash"), text.alias("row_text"))


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose column `text` holds about `most` bytes; a longer text is a slice by itself."""
    for batch in batches:
        offsets = text_offsets(batch.column("text"))
        start = 0
        for row in range(1, batch.num_rows + 1):
            if row == batch.num_rows or offsets[row + 1] - offsets[start] > most:
                yield batch.slice(start, row - start)
                start = row


def text_offsets(column: pa.Array) -> np.ndarray:
    """Where each text begins and ends in the buffer of the column."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, rows: int, most_bytes: int, seed: str) -> DataFrame:
    """(text, y) in a fixed order: at most `rows` texts of either label for which train (a condition on doc_id) holds, the first by a hash of doc_id.

    The bound is a parameter of the fit, as is most_bytes: longer texts are not used for fitting. Rows with a null
    doc_id, text or label are not used either.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(train)
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = marked.filter("y = 1").orderBy(order, "doc_id").limit(rows).union(marked.filter("y = 0").orderBy(order, "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length("text") <= most_bytes)
    return texts.join(F.broadcast(picked), "doc_id").orderBy(order, "doc_id", "text").limit(2 * rows).select("text", "y")
