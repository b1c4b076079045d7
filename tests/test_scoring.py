import math

from loomspace.config import Scoring
from loomspace.operators import scoring


def scored(spark, chunks, least=1, source="s"):
    """chunks: a set of terms each."""
    rows = [(source, k, 0, 1, t) for k, terms in enumerate(chunks) for t in terms]
    terms = spark.createDataFrame(rows, "source string, doc_id long, start int, source_line int, term string")
    counts = spark.createDataFrame([(source, len(chunks))], "source string, n_chunks long")
    return scoring.tfidf(scoring.document_frequency(terms, Scoring(min_occurrences=least)), counts)


def test_score(spark):
    found = {r.term: r.score for r in scored(spark, [{"hyperbolic", "geometry"}, {"hyperbolic", "space"}, {"x1"}]).collect()}
    assert math.isclose(found["hyperbolic"], 2 * math.log(4 / 3)) and math.isclose(found["space"], math.log(2))


def test_term_of_every_chunk_scores_zero(spark):
    found = {r.term: r.score for r in scored(spark, [{"distance", "rare"}, {"distance"}, {"distance"}]).collect()}
    assert found["distance"] == 0 < found["rare"]


def test_floor_keeps_its_own_value(spark):
    chunks = [{"frequent", "twice"}, {"frequent", "twice"}, {"frequent", "once"}]
    assert {r.term for r in scored(spark, chunks, 2).collect()} == {"frequent", "twice"}


def test_strengths(spark):
    scores = scored(spark, [{"distance", "rare"}, {"distance"}, {"distance"}])
    assert {r.term: r.strength for r in scoring.strengths(scores).collect()} == {"rare": 1.0, "distance": 0.0}
    assert {r.strength for r in scoring.strengths(scores.filter("term = 'distance'")).collect()} == {0.0}
    assert scoring.strengths(scores.filter("false")).count() == 0
    both = scores.union(scored(spark, [{"a"}, set(), set(), set()], source="t"))
    assert [r.strength for r in scoring.strengths(both, "per_source").filter("source = 't'").collect()] == [1.0]


def test_survival_never_rises(spark):
    strong = scoring.strengths(scored(spark, [{"aa", "bb"}, {"aa"}, {"cc"}, set()]))
    counts = [r.survivors for r in scoring.survival(strong).orderBy("threshold").collect()]
    assert len(counts) == 12 and counts == sorted(counts, reverse=True)


def test_top_terms(spark):
    scores = scored(spark, [{"bb", "aa"}, {"cc"}, set()])
    assert [r.term for r in scoring.top_terms(scores, 2).orderBy("rank").collect()] == ["aa", "bb"]
