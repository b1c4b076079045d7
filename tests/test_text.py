import pytest
from pyspark.sql import functions as F

from loomspace.config import Ingest, Settings, settings_from
from loomspace.functions import text as T
from loomspace.operators import chunking


def cut(spark, text, size=2000, overlap=200):
    docs = spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string")
    return [(r.start, r.text, r.source_line) for r in chunking.chunks(docs, Ingest(size, overlap)).orderBy("start").collect()]


def test_no_text_no_chunks(spark):
    assert cut(spark, "") == [] and cut(spark, None) == []


def test_short_text_is_one_chunk(spark):
    assert cut(spark, "a short piece of text") == [(0, "a short piece of text", 1)]


def test_overlap(spark):
    found = cut(spark, "0123456789ABCDEFGHIJ", 10, 2)
    assert [t for _, t, _ in found][:2] == ["0123456789", "89ABCDEFGH"]
    assert len(found) == 3  # the last chunk may lie inside the one before


def test_code_points(spark):
    found = cut(spark, "“quotes” — and ‘more’ — dashes", 10, 2)
    assert all(len(t) == 10 for _, t, _ in found[:-1])


def test_lines(spark):
    found = cut(spark, "line one\nline two\nline three\nline four\nline five", 10, 2)
    assert [found[k][2] for k in (0, 2, 3, 4, 5)] == [1, 2, 3, 4, 5]


def test_bad_overlap():
    with pytest.raises(ValueError):
        Ingest(5, 10)


def terms(spark, text, max_n=3):
    row = spark.createDataFrame([(text,)], "t string").select(T.ngrams(T.tokens(F.col("t")), max_n).alias("g")).first()
    return set(row.g)


def test_ngrams_edges(spark):
    assert "bank of america" in terms(spark, "The Bank of America!")
    assert terms(spark, "of the bank") == {"bank"}
    assert "alpha beta gamma delta" not in terms(spark, "alpha beta gamma delta")
    assert "alpha beta gamma delta" in terms(spark, "alpha beta gamma delta", 4)
    assert terms(spark, "ok") == set() and terms(spark, "") == set() and terms(spark, "the of and") == set()
    assert {"elon musk", "spacex"} <= terms(spark, "SpaceX was founded by Elon Musk.")


def test_length_is_in_bytes(spark):
    assert terms(spark, "éa") == {"éa"}  # two characters, three bytes


def test_names(spark):
    rows = [("orbital mechanics", "orbital mechanics"), ("one two three four five", "raw"), ("a" * 50, "raw"), ("  Mixed CASE  ", "mixed case"), ("", "")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "p string").select(T.valid_name(F.col("p"), F.lit("raw")).alias("n"))
    assert [r.n for r in df.collect()] == [b for _, b in rows]


def test_numbering_spans_documents(spark):
    docs = spark.createDataFrame([(k, "s", "x" * 25) for k in (1, 5, 9000, 9001)], "doc_id long, source string, text string")
    rows = chunking.numbered(docs, chunking.chunks(docs, Ingest(10, 0)), Ingest(10, 0)).orderBy("doc_id", "start").collect()
    assert [r.chunk_no for r in rows] == list(range(12))


def test_settings():
    s = settings_from('output_dir = "x"\n[tfidf]\nmin_occurrences = 3\n[placement]\nk_neighbors = 7\n[placement.sharding]\nshard_radius = 0.5\n')
    assert (s.output_dir, s.scoring.min_occurrences, s.placement.k_neighbors, s.placement.shard_radius) == ("x", 3, 7, 0.5)
    assert s.ingest == Settings().ingest
    with pytest.raises(ValueError):
        settings_from("[placement]\nnothing = 1")
