"""Terms counted on arrays, and chunks held against kept terms, against the Columns and brute force."""

import random

import numpy as np
import pytest

from loomspace.config import Ingest, Scoring
from loomspace.functions import words as W
from loomspace.operators import chunking, counting, holding, scoring
from loomspace.plans import catalogue
from pyspark.sql import functions as F

ODD = ["İstanbul", "ΟΔΟΣ", "ΣΑΣ,", "(Σ)", "don't", "the", "of", "naïve", "日本語", "éa", "́x́", "a\x1cb", "x y", "--", "…", "no", "É", "\U00010400z", "Ⅰ", "٣", "tab\tline\n", "word", "word", "other", "A7Ɤ"]


def texts(seed, n=40, words=60):
    rnd = random.Random(seed)
    return [rnd.choice([" ", "\n", ""]).join(["", *(rnd.choice([" ", "  ", "\n", " "]) + rnd.choice(ODD) for _ in range(rnd.randrange(words)))]) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(f"s{k % 3}" if k % 7 else None, k, t) for k, t in enumerate(rows)], "source string, doc_id long, text string")


@pytest.mark.parametrize("least", [1, 2, 5])
@pytest.mark.parametrize("size", [40, 4_000_000])
def test_frequencies_are_those_of_the_columns(spark, monkeypatch, least, size):
    """F7, F9, F10, F16, F17, F19 to F21, in blocks of a few chunks and of all."""
    monkeypatch.setattr(W, "CHARACTERS", size)
    cut = chunking.chunks(frame(spark, texts(least)), Ingest(50, 10))
    s = Scoring(min_occurrences=least)
    wanted = {tuple(r) for r in scoring.document_frequency(scoring.chunk_terms(cut), s).collect()}
    assert {tuple(r) for r in counting.term_frequencies(cut, s).collect()} == wanted != set()


def test_only_terms_whose_hash_reaches_the_floor_are_made(spark):
    """Nearly all terms occur once; before, every one of them became a string and was dealt out."""
    rules = W.rules(spark)
    rows = [f"common word{k} alone{k}" for k in range(50)]
    batch = [b for b in frame(spark, rows).select("source", "text").toArrow().to_batches() if b.num_rows]
    blocks = list(counting._blocks(iter(batch), rules))
    marked = np.zeros(1 << (counting._MAP - 3), np.uint8)
    for bucket, bits in counting._marked(frame(spark, rows), rules, 3, 5):
        at = bucket << (counting._MAP - counting._BUCKET - 3)
        part = np.frombuffer(__import__("zlib").decompress(bits), np.uint8)
        marked[at : at + len(part)] = part
    made = [t for b in blocks for r in b.terms(3, marked) for t in r.column("term").to_pylist()]
    assert "common" in made and len(set(made)) <= 2
    assert len({t for b in blocks for r in b.terms(3, None) for t in r.column("term").to_pylist()}) == 251


def test_equal_hashes_are_held_against_characters(spark):
    w = W.Words(["one two one", "two ones"], W.rules(spark))
    assert len(set(w.numbers())) == 3
    w.hashes[:] = 7
    numbers = w.numbers()
    assert numbers[0] == numbers[2] and numbers[1] == numbers[3] and len(set(numbers)) == 3


def test_words_follow_the_columns(spark):
    from loomspace.functions import text as T

    rules = W.rules(spark)
    rows = [c for c in map(chr, range(1, 0x3100)) if not 0xD800 <= ord(c) < 0xE000] + ODD
    wanted = spark.createDataFrame([(f"A{c}B {c}c {c}", ) for c in rows], "t string").select("t", T.tokens(F.col("t")).alias("w"), F.lower("t").alias("low")).collect()
    for r in wanted:
        assert [x for x in map(rules.bare, W.split(r.t)) if x] == r.w
        assert rules.lower(r.t) == r.low
        found = W.Words([r.t], rules)
        assert [found.text(k) for k in range(len(found.starts))] == r.w


def test_lists_of_chunks_and_first_lines_of_kept_terms(spark, monkeypatch):
    """only kept terms are looked for, and texts meet no other table."""
    docs = frame(spark, texts(9)).filter("source is not null")
    cut = chunking.chunks(docs, Ingest(50, 10))
    kept = spark.createDataFrame([("s0", "word"), ("s0", "other word"), ("s1", "naïve"), ("s1", "the"), ("s2", "日本語"), ("s2", "not there"), ("s3", "word")], "source string, term string")
    rows = scoring.chunk_terms(chunking.numbered(docs, cut, Ingest(50, 10)).drop("chunk_no")).join(kept, ["source", "term"])
    numbers = {(r.source, r.doc_id, r.start): r.chunk_no for r in chunking.numbered(docs, cut, Ingest(50, 10)).collect()}
    wanted = {}
    for r in rows.collect():
        wanted.setdefault((r.source, r.term), []).append((numbers[r.source, r.doc_id, r.start], r.source_line))
    for gathered in (3, 1 << 20):
        monkeypatch.setattr(holding, "_GATHERED", gathered)
        found = holding.chunk_lists(cut, chunking.chunk_offsets(docs, Ingest(50, 10)), kept, 3, 40)
        assert {(r.source, r.term): (r.chunk_nos, r.first_line) for r in found.collect()} == {k: (",".join(str(n) for n, _ in sorted(v)), min(v)[1]) for k, v in wanted.items()} != {}
        assert {(r.source, r.term): r.first_line for r in holding.first_lines(cut, kept, 3).collect()} == {k: min(v)[1] for k, v in wanted.items()}


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_not_dealt_out_by_source(spark):
    """F3, F8, F18, F1, F2: with a hint, whichever side is ready first, the chunks stay where they are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = chunking.chunks(frame(spark, texts(3)))
        strong = spark.createDataFrame([("s0", "word", 0.9)], "source string, term string, strength double")
        assert "SortMergeJoin" not in _exchanges(holding.signals(cut, strong)) and "SortMergeJoin" not in _exchanges(holding.best_chunks(cut, strong, strong, 3, 5))
        sf = "/root/testdata/sf0.001"
        assert "SortMergeJoin" not in _exchanges(catalogue.tfidf_scores(spark, sf)) and "SortMergeJoin" not in _exchanges(catalogue.strength_left_join(spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
