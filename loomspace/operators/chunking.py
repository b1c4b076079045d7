"""Overlapping chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Ingest

#: Documents whose chunk counts one task sums up: numbering within a source goes in two levels, so that a source with a large share of
#: all documents is not summed up in one task.
_SPAN = 4096


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt to all cores where the scan has fewer splits than there are cores (one small file); larger inputs stay where they are read."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores else docs


#: Characters of chunks that one Arrow batch takes, and documents or chunks that it takes at most: texts may be very long.
_CHARACTERS, _ROWS = 4 << 20, 512


def chunks(docs: DataFrame, settings: Ingest | None = None) -> DataFrame:
    """(doc_id, source, text) to (source, doc_id, start, text, source_line); a text of no characters has no chunks, the last chunk may be short.

    source_line is 1 + line breaks before start, a running sum, so the work is linear in the length of a text.
    """
    s = settings or Ingest()
    rows = spread(docs.select("source", "doc_id", "text"))
    conf = docs.sparkSession.conf  # read when the plan runs, so it stays as it is set here
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= _ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_ROWS))
    names = ["source", "doc_id", "start", "text", "source_line"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("source").type, batch.schema.field("doc_id").type, pa.int32(), pa.string(), pa.int32()]
            found, held = [], 0
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for source, doc_id, text in zip(*(part.column(c).to_pylist() for c in names[:2] + ["text"]), strict=True):
                    line = 1
                    for start in range(0, len(text or ""), s.stride):
                        found.append((source, doc_id, start, text[start : start + s.chunk_size], line))
                        line += text.count("\n", start, start + s.stride)
                        held += s.chunk_size
                        if held >= _CHARACTERS:
                            yield _batch(found, names, kinds)
                            found, held = [], 0
            if found:
                yield _batch(found, names, kinds)

    kind = {c: rows.schema[c].dataType.simpleString() for c in names[:2]}
    return rows.mapInArrow(cut, f"source {kind['source']}, doc_id {kind['doc_id']}, start int, text string, source_line int")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def chunk_offsets(docs: DataFrame, settings: Ingest | None = None) -> DataFrame:
    """(source, doc_id, before): chunks of the source in documents of smaller id. Ids are distinct within a source."""
    s = settings or Ingest()
    counts = docs.select("source", "doc_id", F.ceil(F.length("text") / s.stride).alias("n"), F.floor(F.col("doc_id") / _SPAN).alias("span"))
    spans = counts.groupBy("source", "span").agg(F.sum("n").alias("total"))
    earlier = spans.withColumn("earlier", F.coalesce(F.sum("total").over(Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    inside = Window.partitionBy("source", "span").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(earlier, ["source", "span"]).select("source", "doc_id", (F.col("inside") + F.col("earlier")).alias("before"))


def numbered(docs: DataFrame, cut: DataFrame, settings: Ingest | None = None) -> DataFrame:
    """cut with chunk_no: 0, 1, ... within each source in the order of doc_id and start."""
    s = settings or Ingest()
    return cut.join(chunk_offsets(docs, s), ["source", "doc_id"]).withColumn("chunk_no", F.col("before") + F.expr(f"start div {s.stride}")).drop("before")
