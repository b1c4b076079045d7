"""Chunks held against the terms of their own source, which a cap per source bounds: what they contain, what they hold, and how much signal that is.

Only the terms asked for are looked for, in Python, a chunk at a time; no other term of a chunk is made. The terms of a source travel as one JSON text, which is parsed once
per source and task; while sources are few these texts are broadcast, so that chunks are not dealt out by source.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions import words as W
from ..sources.shared import counted

#: Sources whose terms are broadcast, sources whose terms a task keeps parsed, and rows that it gathers before it sends them.
_FEW, _PARSED, _GATHERED = 2_000, 2_000, 1 << 20
_PLACES = Decimal("1e-9")


def _lists(strong: DataFrame | None, kept: DataFrame | None) -> DataFrame:
    """(source, wanted): strong terms with their strengths, in order of the terms, and kept terms, without."""
    parts = []
    if strong is not None:
        parts.append(strong.select("source", "term", F.col("strength").cast("double").alias("strength"), F.lit(0).alias("kept")))
    if kept is not None:
        parts.append(kept.select("source", "term", F.lit(None).cast("double").alias("strength"), F.lit(1).alias("kept")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return counted(rows.groupBy("source").agg(F.to_json(F.sort_array(F.collect_list(F.struct("kept", "term", "strength")))).alias("wanted")), "wanted-terms", _FEW)


class _Wanted:
    """The terms of one source: strong ones to be contained, kept ones to be held as words in a row."""

    def __init__(self, text: str | None, max_n: int):
        rows = [r for r in json.loads(text or "[]") if r.get("term") is not None]
        self.strong = [(r["term"], r["strength"]) for r in rows if not r["kept"] and r.get("strength") is not None]
        self.single, self.longer = set(), {}
        for term in (r["term"] for r in rows if r["kept"] and W.is_term(r["term"], max_n)):
            words = term.split(" ")
            if len(words) == 1:
                self.single.add(term)
            else:
                self.longer.setdefault(words[0], []).append((words, term))

    def signal(self, low: str) -> float:
        return sum([s for term, s in self.strong if term in low], 0.0)

    def held(self, words: list[str]) -> list[str]:
        found = self.single.intersection(words)
        if self.longer:
            for at in [k for k, w in enumerate(words) if w in self.longer]:
                found.update(term for own, term in self.longer[words[at]] if words[at : at + len(own)] == own)
        return list(found)


class _Bare(dict):
    """Runs between white space to their words, which may be empty."""

    def __init__(self, rules: W.Rules):
        super().__init__()
        self.rules = rules

    def __missing__(self, raw: str) -> str:
        if len(self) >= 1 << 20:
            self.clear()
        word = self[raw] = self.rules.bare(raw)
        return word

    def words(self, text: str) -> list[str]:
        return list(filter(None, map(self.__getitem__, W.split(text))))


def _rows(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[dict]:
    """Rows of chunks, with their parsed terms as `wanted`."""
    parsed: dict[str | None, _Wanted] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                source = row["source"]
                if source not in parsed:
                    if len(parsed) >= _PARSED:
                        parsed.clear()
                    parsed[source] = _Wanted(row["wanted"], max_n)
                row["wanted"] = parsed[source]
                yield row


def _over(cut: DataFrame, columns: str, max_n: int, run: Callable[[Iterator[dict]], Iterator[list[tuple]]]) -> DataFrame:
    """The portions of rows that run makes of all rows: source and doc_id, then these columns."""
    fields = [cut.schema[c] for c in ("source", "doc_id")]
    schema = StructType([StructField(f.name, f.dataType) for f in fields] + StructType.fromDDL(columns).fields)
    arrow = to_arrow_schema(schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in run(_rows(batches, max_n)):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return cut.mapInArrow(made, schema)


def _portions(rows: Iterator[tuple], most: int = 1 << 15) -> Iterator[list[tuple]]:
    rows = iter(rows)
    while part := list(islice(rows, most)):
        yield part


def signals(cut: DataFrame, strong: DataFrame) -> DataFrame:
    """(source, doc_id, start, signal) of each chunk: the strengths of the strong terms of its source that it contains, lower-cased, as substrings, summed."""
    rules = W.rules(cut.sparkSession)

    def run(rows: Iterator[dict]) -> Iterator[list[tuple]]:
        return _portions((r["source"], r["doc_id"], r["start"], r["wanted"].signal(rules.lower(r["text"]))) for r in rows)

    return _over(cut.select("source", "doc_id", "start", "text").join(_lists(strong, None), "source", "left"), "start int, signal double", 0, run)


def best_chunks(cut: DataFrame, strong: DataFrame, kept: DataFrame, max_n: int, n: int) -> DataFrame:
    """(source, doc_id, start, signal, term): of each kept term of a source at least the n chunks of most signal that hold it; each task leaves out what comes after its own n best."""
    rules = W.rules(cut.sparkSession)

    def run(rows: Iterator[dict]) -> Iterator[list[tuple]]:
        words, best, gathered = _Bare(rules).words, {}, 0
        for r in rows:
            held = r["wanted"].held(words(r["text"]))
            if not held:
                continue
            signal = r["wanted"].signal(rules.lower(r["text"]))
            # as Spark rounds and sorts: half up, nulls first
            key = (-Decimal(repr(signal)).quantize(_PLACES, ROUND_HALF_UP), r["doc_id"] is not None, r["doc_id"] or 0, r["start"])
            for term in held:
                found = best.setdefault((r["source"], term), [])
                found.append((key, (r["source"], r["doc_id"], r["start"], signal, term)))
                gathered += 1
                if len(found) >= 4 * n:
                    found.sort()
                    gathered -= len(found) - n
                    del found[n:]
            if gathered >= _GATHERED:
                yield from _portions(x for found in best.values() for _, x in sorted(found)[:n])
                best, gathered = {}, 0
        yield from _portions(x for found in best.values() for _, x in sorted(found)[:n])

    return _over(cut.select("source", "doc_id", "start", "text").join(_lists(strong, kept), "source"), "start int, signal double, term string", max_n, run)


def first_lines(cut: DataFrame, kept: DataFrame, max_n: int) -> DataFrame:
    """kept with first_line, the line of the first chunk that holds the term; terms that no chunk holds go."""
    rules = W.rules(cut.sparkSession)

    def run(rows: Iterator[dict]) -> Iterator[list[tuple]]:
        words, first = _Bare(rules).words, {}
        for r in rows:
            key = (r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["source_line"])
            for term in r["wanted"].held(words(r["text"])):
                at = (r["source"], term)
                if at not in first or key < first[at][0]:
                    first[at] = (key, (r["source"], r["doc_id"], r["start"], r["source_line"], term))
            if len(first) >= _GATHERED:
                yield from _portions(x for _, x in first.values())
                first = {}
        yield from _portions(x for _, x in first.values())

    found = _over(cut.select("source", "doc_id", "start", "source_line", "text").join(_lists(None, kept), "source"), "start int, source_line int, term string", max_n, run)
    first = found.groupBy("source", "term").agg(F.min(F.struct("doc_id", "start", "source_line"))["source_line"].alias("first_line"))
    return kept.join(first, ["source", "term"])


def chunk_lists(cut: DataFrame, offsets: DataFrame, kept: DataFrame, max_n: int, stride: int) -> DataFrame:
    """(source, term, chunk_nos, first_line): the numbers, within the source, of the chunks that hold each kept term, in order, and the line of the first.

    offsets: (source, doc_id, before), as chunking.chunk_offsets gives it. Texts do not meet it, only what their chunks hold.
    """
    rules = W.rules(cut.sparkSession)

    def find(rows: Iterator[dict]) -> Iterator[list[tuple]]:
        words = _Bare(rules).words
        found = ((r["source"], r["doc_id"], r["start"] // stride, r["source_line"], r["wanted"].held(words(r["text"]))) for r in rows)
        return _portions((r for r in found if r[-1]), 1 << 12)

    held = _over(cut.select("source", "doc_id", "start", "source_line", "text").join(_lists(None, kept), "source"), "k int, source_line int, terms array<string>", max_n, find)
    rows = held.join(offsets, ["source", "doc_id"]).select("source", (F.col("before") + F.col("k")).alias("chunk_no"), "source_line", "terms")
    kind = to_arrow_type(rows.schema["source"].dataType)
    names = ["source", "term", "nos", "first_no", "first_line"]
    types = [kind, pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int32()]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[pa.RecordBatch]:
            for part in _portions((*at, [no for no, _ in nos], *min(nos)) for at, nos in lists.items()):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

        lists, n = {}, 0
        for batch in batches:
            for source, no, at_line, terms in zip(*(batch.column(c).to_pylist() for c in ("source", "chunk_no", "source_line", "terms")), strict=True):
                for term in terms:
                    lists.setdefault((source, term), []).append((no, at_line))
                n += len(terms)
            if n >= _GATHERED:
                yield from sent()
                lists, n = {}, 0
        yield from sent()

    parts = rows.mapInArrow(gather, f"source {rows.schema['source'].dataType.simpleString()}, term string, nos array<bigint>, first_no bigint, first_line int")
    nos = F.array_join(F.sort_array(F.flatten(F.collect_list("nos"))).cast("array<string>"), ",").alias("chunk_nos")
    return parts.groupBy("source", "term").agg(nos, F.min(F.struct("first_no", "first_line"))["first_line"].alias("first_line"))
