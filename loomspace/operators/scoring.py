"""Terms of chunks, document frequencies, TF-IDF per source, strengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Scoring
from ..functions import text as T
from ..sources.shared import counted, written

#: Thresholds that the survival report lists: fixed values.
THRESHOLDS = (0.001, 0.01, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9)


def chunk_terms(cut: DataFrame, max_n: int = 3) -> DataFrame:
    """(source, doc_id, start, text) to a row per distinct term of each chunk, without a shuffle."""
    words = cut.select("source", "doc_id", "start", "source_line", T.tokens(F.col("text")).alias("words"))
    return words.select("source", "doc_id", "start", "source_line", F.explode(T.ngrams(F.col("words"), max_n)).alias("term"))


def document_frequency(terms: DataFrame, settings: Scoring | None = None) -> DataFrame:
    """(source, term, df): chunks that hold the term, at least min_occurrences. One hash aggregation, combined before its shuffle."""
    s = settings or Scoring()
    return terms.groupBy("source", "term").agg(F.count("*").alias("df")).filter(F.col("df") >= s.min_occurrences)


def chunk_counts(docs: DataFrame, stride: int) -> DataFrame:
    """(source, n_chunks), counted from text lengths alone."""
    return docs.groupBy("source").agg(F.sum(F.ceil(F.length("text") / stride)).alias("n_chunks"))


def tfidf(frequencies: DataFrame, counts: DataFrame) -> DataFrame:
    """score = df * ln((n + 1) / (df + 1)). counts has a row per source; it is counted first, so that terms are not dealt out by source where sources are few."""
    score = F.col("df") * F.ln((F.col("n_chunks") + 1) / (F.col("df") + 1))
    return frequencies.join(counted(counts, "chunk-counts"), "source").withColumn("score", score)


def top_terms(scores: DataFrame, n: int | None) -> DataFrame:
    """The n best terms of each source with their rank, ties by term; Spark limits each group before the shuffle. None: all of them."""
    order = Window.partitionBy("source").orderBy(F.round("score", 9).desc(), "term")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def strengths(scores: DataFrame, normalize: str = "pooled") -> DataFrame:
    """scores with strength: the score over the largest one, of all sources or of its own, within 0 and 1; 0 if that is not positive."""
    if normalize not in ("pooled", "per_source"):
        raise ValueError(f"normalize: {normalize}")
    if normalize == "pooled":
        scores = written(scores, "scores")  # read twice
        rows = scores.withColumn("largest", scores.agg(F.max("score")).scalar())
    else:  # the window of top_terms has dealt the rows by source already
        rows = scores.withColumn("largest", F.max("score").over(Window.partitionBy("source")))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / F.col("largest")))
    return rows.withColumn("strength", F.when(F.col("largest") > 0, share).otherwise(F.lit(0.0))).drop("largest")


def last_wins(rows: DataFrame, keys: str | list[str], latest_first: list[Column]) -> DataFrame:
    """One row per key, or per values of several: the latest."""
    order = Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*latest_first)
    return rows.withColumn("_last", F.row_number().over(order)).filter("_last = 1").drop("_last")


def survival(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, survivors): distinct terms whose strength reaches each threshold; of a term in two sources the last one counts. One pass, whatever the number of thresholds."""
    unique = last_wins(scored, "term", [F.col("source").desc()])
    counts = unique.agg(F.array(*(F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("strength") >= t).alias("survivors")) for t in thresholds)).alias("a"))
    return counts.select(F.explode("a").alias("r")).select("r.*")
