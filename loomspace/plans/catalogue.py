"""The catalogue of queries over the test tables; oracles.py has the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Placement, Scoring, Settings
from ..functions import hyperbolic as H
from ..functions import text as T
from ..operators import chunking, counting, enrichment, holding, neighbors, placement, scoring, sharding
from ..sources import models, store
from ..sources.shared import counted, fresh_path, remove, written
from . import pipeline
from .oracles import ORACLES

SETTINGS = Settings()
DIMENSION = 64
#: The row of `embeddings` that stands for a question, and the strength of each row: fixed rules of these queries.
QUESTION = 0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def _cut(spark, sf_dir):
    return chunking.chunks(_docs(spark, sf_dir))


def chunks(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = chunking.numbered(docs, chunking.chunks(docs))
    return rows.select("source", "chunk_no", "doc_id", F.length("text").alias("n_chars"), "source_line", F.md5("text").alias("text_md5"))


def chunk_counts(spark, sf_dir):
    return scoring.chunk_counts(_docs(spark, sf_dir), SETTINGS.ingest.stride)


def tokens(spark, sf_dir):
    words = _cut(spark, sf_dir).select("source", F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("source", "token").agg(F.count("*").alias("n"))


def ngrams(spark, sf_dir):
    terms = scoring.chunk_terms(_cut(spark, sf_dir))
    return terms.groupBy("source", "doc_id", "start").agg(F.count("*").alias("n_terms"), F.sum(F.length("term")).alias("n_term_chars"))


def _frequencies(spark, sf_dir, least=None):
    return counting.term_frequencies(_cut(spark, sf_dir), Scoring(min_occurrences=least) if least else None)


def term_df(spark, sf_dir):
    return _frequencies(spark, sf_dir).select("source", "term", "df")


def _scores(spark, sf_dir, least=None):
    return scoring.tfidf(_frequencies(spark, sf_dir, least), chunk_counts(spark, sf_dir))


def tfidf_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("source", "term", "df", F.round("score", 6).alias("score"))


def top_terms_per_source(spark, sf_dir):
    return scoring.top_terms(_scores(spark, sf_dir), 100).select("source", "rank", "term", "df", F.round("score", 6).alias("score"))


def top_terms_small(spark, sf_dir):
    """The same with a floor of 2 chunks, for very small tables."""
    return scoring.top_terms(_scores(spark, sf_dir, 2), 100).select("source", "rank", "term", "df", F.round("score", 6).alias("score"))


def term_chunk_lists(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    top = scoring.top_terms(_scores(spark, sf_dir), 100).select("source", "term")
    lists = holding.chunk_lists(chunking.chunks(docs), chunking.chunk_offsets(docs), top, SETTINGS.scoring.max_n, SETTINGS.ingest.stride)
    return lists.select("source", "term", "chunk_nos", "first_line")


def _strengths(spark, sf_dir, normalize="pooled"):
    return scoring.strengths(scoring.top_terms(_scores(spark, sf_dir), 100), normalize)


def strengths(spark, sf_dir):
    return _strengths(spark, sf_dir).select("source", "term", F.round("strength", 6).alias("strength"))


def strengths_per_source(spark, sf_dir):
    return _strengths(spark, sf_dir, "per_source").select("source", "term", F.round("strength", 6).alias("strength"))


def survival_counts(spark, sf_dir):
    return scoring.survival(_strengths(spark, sf_dir).withColumn("strength", F.round("strength", 9)))


def last_wins_dedupe(spark, sf_dir):
    return scoring.last_wins(_strengths(spark, sf_dir), "term", [F.col("source").desc()]).select("term", "source", F.round("strength", 6).alias("strength"))


def _points(spark, sf_dir):
    """Rows of `embeddings` as concepts in order of vec_id, their strength by a fixed rule."""
    strength = (F.pmod(F.col("vec_id") * 37, F.lit(100)) + 1) / 100.0
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.concat(F.lit("t"), F.col("vec_id")).alias("term"), strength.alias("strength"), F.col("embedding").cast("array<double>").alias("v"), "label")


def placed_filter(spark, sf_dir):
    kept = placement.eligible(_points(spark, sf_dir), Placement(strength_threshold=0.5))
    return kept.select(F.col("id").alias("vec_id"), "strength")


def max_concepts_topk(spark, sf_dir):
    kept = placement.eligible(_points(spark, sf_dir), Placement(max_concepts=100))
    return kept.select(F.col("id").alias("vec_id"), "strength")


def pair_distances(spark, sf_dir):
    found = neighbors.distance_summary(_points(spark, sf_dir).select("id", "v"))
    return found.select("n_pairs", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


def _knn(spark, sf_dir):
    return neighbors.knn(_points(spark, sf_dir).select("id", "v"))


def knn(spark, sf_dir):
    return _knn(spark, sf_dir).select(F.col("id").alias("vec_id"), "rank", F.col("neighbor").alias("neighbor_id"), F.round("distance", 6).alias("distance"))


def _geometry(spark, sf_dir):
    points = _points(spark, sf_dir).select("id", "v")
    return neighbors.neighborhood_geometry(points, neighbors.knn(points))


def gromov_delta(spark, sf_dir):
    return _geometry(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round("gromov_delta", 6).alias("gromov_delta"))


def eigen_signature(spark, sf_dir):
    found = _geometry(spark, sf_dir)
    return found.select(F.col("id").alias("vec_id"), F.col("class").alias("geometry"), *(F.round(c, 6).alias(c) for c in ("eigenvalue_ratio", "first_dominance", "neg_eigenvalue_fraction")))


def eigen_power_sums(spark, sf_dir):
    """Sums of the first three powers of each neighbourhood's eigenvalues: the traces of the first three powers of its matrix."""
    powers = lambda k: F.aggregate(F.transform("eigenvalues", lambda x: F.pow(x, F.lit(k))), F.lit(0.0), lambda a, x: a + x)
    return _geometry(spark, sf_dir).select(F.col("id").alias("vec_id"), *(F.round(powers(k), 6).alias(f"p{k}") for k in (1, 2, 3)))


def mds_trace(spark, sf_dir):
    return _geometry(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round("trace", 6).alias("trace"))


def _rounded(array: str, name: str):
    return [F.round(F.col(array)[k], 6).alias(f"{name}{k}") for k in range(3)]


def directions(spark, sf_dir):
    rows = _points(spark, sf_dir).withColumn("d", H.direction(F.col("v"), H.projections(DIMENSION, 42)))
    return rows.select(F.col("id").alias("vec_id"), *_rounded("d", "d"))


def spherical_angle(spark, sf_dir):
    return _points(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(H.angle(F.col("v"), H.projections(DIMENSION, 42)), 6).alias("theta"))


def flat_position(spark, sf_dir):
    return _points(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(H.flat(F.col("v"), H.projections(DIMENSION, 42)), 6).alias("flat_pos"))


def _spots(spark, sf_dir):
    """Positions by strength alone, without the penalty of ambiguous neighbourhoods, so that SQL can follow all of it cheaply."""
    rows = _points(spark, sf_dir)
    return rows.withColumn("pos", H.scaled(H.radius(F.col("strength"), F.lit(0.0)), H.direction(F.col("v"), H.projections(DIMENSION, 42))))


def positions(spark, sf_dir):
    found = placement.positions(_points(spark, sf_dir).select("id", "ord", "strength", "v"), SETTINGS.placement, DIMENSION)
    return found.select(F.col("id").alias("vec_id"), *_rounded("pos", "p"))


def poincare_to_origin(spark, sf_dir):
    zero = F.array(*(F.lit(0.0) for _ in range(3)))
    return _spots(spark, sf_dir).select(F.col("id").alias("vec_id"), F.round(H.poincare_distance(F.col("pos"), zero), 6).alias("distance"))


def _anchor():
    return F.array(F.lit(0.7), F.lit(0.1), F.lit(0.0))


def mobius_local(spark, sf_dir):
    rows = _spots(spark, sf_dir).withColumn("q", H.to_origin(_anchor(), F.col("pos")))
    return rows.select(F.col("id").alias("vec_id"), *_rounded("q", "q"))


def isometry_check(spark, sf_dir):
    rows = _spots(spark, sf_dir)
    other = F.array(F.lit(0.3), F.lit(-0.2), F.lit(0.1))
    before, after = H.poincare_distance(F.col("pos"), other), H.poincare_distance(H.to_origin(_anchor(), F.col("pos")), H.to_origin(_anchor(), other))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.abs(before - after) < 1e-8).alias("n_equal"))


def _registry(spark, sf_dir):
    return sharding.find_anchors(_spots(spark, sf_dir).select("ord", "pos"), SETTINGS.placement.shard_radius)


def _anchor_rows(registry, spark):
    return registry.frame(spark).select("shard_no", "shard_id", "ord", *(F.round(F.col("anchor")[k], 6).alias(f"a{k}") for k in range(3)))


def leader_anchors(spark, sf_dir):
    return _anchor_rows(_registry(spark, sf_dir), spark)


def _assigned(spark, sf_dir):
    return sharding.assign(_spots(spark, sf_dir), _registry(spark, sf_dir), SETTINGS.placement.shard_radius)


def shard_assignments(spark, sf_dir):
    found = _assigned(spark, sf_dir)
    return found.select(F.col("id").alias("vec_id"), "shard_id", "is_new", F.round("distance", 6).alias("distance"), *_rounded("local_pos", "q"))


def shard_sizes(spark, sf_dir):
    return _assigned(spark, sf_dir).groupBy("shard_id").agg(F.count("*").alias("n_concepts"))


def registry_resume(spark, sf_dir):
    """Anchors after the first and the second half of the concepts went through one after the other, the registry stored in between; the same as all at once."""
    rows = _spots(spark, sf_dir).select("ord", "pos")
    half = rows.count() // 2
    path = fresh_path(spark, "registry")
    first = sharding.find_anchors(rows.filter(F.col("ord") < half), SETTINGS.placement.shard_radius)
    store.write_registry(spark, first, path, SETTINGS.placement.projection_seed, DIMENSION)
    saved, _, _ = store.read_registry(spark, path)
    remove(spark, path)
    return _anchor_rows(sharding.find_anchors(rows.filter(F.col("ord") >= half), SETTINGS.placement.shard_radius, saved), spark).drop("ord")


def _question(spark, sf_dir):
    v = list(_points(spark, sf_dir).filter(F.col("id") == QUESTION).first().v)
    return pipeline.query_position(v, SETTINGS.placement.projection_seed)


def nearest_shards(spark, sf_dir):
    found = pipeline.nearest_shards(spark, _registry(spark, sf_dir), _question(spark, sf_dir))
    return found.select("shard_no", "shard_id", F.round("distance", 6).alias("distance"))


#: Stores that queries of this session have made, by application and folder of the tables: the first of them stores, the others only read.
_STORES: dict[tuple[str, str], str] = {}


def _stored(spark, sf_dir):
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _STORES:
        path = fresh_path(spark, "concepts")
        registry = _registry(spark, sf_dir)
        rows = sharding.assign(_spots(spark, sf_dir), registry, SETTINGS.placement.shard_radius)
        concepts = rows.withColumnRenamed("term", "raw_term").withColumn("label", F.lit("")).withColumn("description", F.repeat(F.concat(F.lit("row "), F.col("id")), 20))
        store.write_concepts(concepts, f"{path}/concepts")
        store.write_registry(spark, registry, f"{path}/registry", SETTINGS.placement.projection_seed, DIMENSION)
        _STORES[known] = path
    return _STORES[known]


def shard_roundtrip(spark, sf_dir):
    rows = store.read_shards(spark, f"{_stored(spark, sf_dir)}/concepts")
    return rows.select("shard_id", "raw_term", F.round("strength", 6).alias("strength"), *_rounded("local_pos", "q"))


def _found(rows):
    return rows.select("raw_term", "shard_id", F.round("distance", 6).alias("distance"))


def retrieve_global(spark, sf_dir):
    return _found(pipeline.retrieve(spark, _stored(spark, sf_dir), _question(spark, sf_dir)))


def retrieve_local_raw(spark, sf_dir):
    return _found(pipeline.retrieve(spark, _stored(spark, sf_dir), _question(spark, sf_dir), frame="local_raw"))


def retrieve_exact(spark, sf_dir):
    return _found(pipeline.retrieve_exact(spark, _stored(spark, sf_dir), _question(spark, sf_dir), SETTINGS.placement.shard_radius))


def retrieve_display(spark, sf_dir):
    found = pipeline.display(pipeline.retrieve(spark, _stored(spark, sf_dir), _question(spark, sf_dir)))
    return found.select("raw_term", "description", F.round("distance", 6).alias("distance"))


def rag_prompt(spark, sf_dir):
    found = pipeline.retrieve(spark, _stored(spark, sf_dir), _question(spark, sf_dir))
    return pipeline.answer_prompt(found, "What is near?")


def _strong(spark, sf_dir):
    return written(_strengths(spark, sf_dir, "per_source").select("source", "term", "strength"), "strong-terms")


def _signalling(strong):
    return strong.filter(F.col("strength") > SETTINGS.enrichment.signal_threshold)


def chunk_signal(spark, sf_dir):
    found = enrichment.chunk_signal(_cut(spark, sf_dir), _signalling(_strong(spark, sf_dir)))
    return found.select("source", "doc_id", "start", F.round("signal", 6).alias("signal"))


def top_chunks(spark, sf_dir):
    strong = _strong(spark, sf_dir)
    found = enrichment.term_chunks(_cut(spark, sf_dir), _signalling(strong), strong, SETTINGS.scoring.max_n, SETTINGS.enrichment.max_chunks)
    return found.select("source", "term", "rank", "doc_id", "start", F.round("signal", 6).alias("signal"))


def summary_prompt(spark, sf_dir):
    found = pipeline.summary_prompts(_docs(spark, sf_dir), _strong(spark, sf_dir), SETTINGS)
    return found.select("source", "term", F.md5("prompt").alias("prompt_md5"))


def name_prompts(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(enrichment.name_prompt(F.col("text"))).alias("prompt_md5"))


def enriched_terms(spark, sf_dir):
    """Descriptions and names of all kept terms by the offline generator: the first line of the first excerpt, its first three words."""
    strong = _strong(spark, sf_dir)
    found = pipeline.enriched(strong.withColumnRenamed("term", "raw_term"), _docs(spark, sf_dir), strong, SETTINGS, models.Extract(), models.Extract())
    return found.select("source", "raw_term", F.md5("description").alias("description_md5"), "label")


def custom_ngrams(spark, sf_dir):
    """Terms of up to five words instead of three, counted per chunk."""
    terms = scoring.chunk_terms(_cut(spark, sf_dir), 5)
    return terms.groupBy("source", "doc_id", "start").agg(F.count("*").alias("n_terms"), F.sum(F.length("term")).alias("n_term_chars"))


def source_order(spark, sf_dir):
    """The order in which kept terms are routed if the list of sources runs from the last name to the first."""
    docs = _docs(spark, sf_dir)
    last_first = docs.select("source").distinct().withColumn("source_ord", F.row_number().over(Window.orderBy(F.col("source").desc())) - 1)
    sources = pipeline.source_numbers(docs.join(last_first, "source"))
    top = scoring.top_terms(_scores(spark, sf_dir), 100)
    return pipeline.routing_order(top, sources).select("source", "term", "ord")


def validate_names(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.valid_name(F.col("text"), F.concat(F.lit("term "), F.col("turn"))).alias("label"))


def embedding_join(spark, sf_dir):
    """Terms of the first source, by rank, joined to vectors; ranks beyond the vectors have none and go."""
    terms = scoring.top_terms(_scores(spark, sf_dir), 100).select("source", "term", F.concat(F.lit("t"), F.col("rank") * 5 + 200).alias("key"))
    vectors = _points(spark, sf_dir).select(F.col("term").alias("key"), "label")
    return terms.join(vectors, "key").groupBy("source", "label").agg(F.count("*").alias("n_terms"))


def strength_left_join(spark, sf_dir):
    """All terms of 10 chunks or more with the strength of the 100 best of their source, 0 for others."""
    found = written(_frequencies(spark, sf_dir), "frequencies")
    scores = scoring.tfidf(found, chunk_counts(spark, sf_dir))
    top = counted(scoring.strengths(scoring.top_terms(scores, 100)).select("source", "term", "strength"), "strengths")
    rows = found.select("source", "term").join(top, ["source", "term"], "left")
    return rows.select("source", "term", F.round(F.coalesce("strength", F.lit(0.0)), 6).alias("strength"))


def hashed_embeddings(spark, sf_dir):
    rows = top_terms_per_source(spark, sf_dir).select("term").distinct().withColumn("v", models.hashed_embedding(F.col("term"), 4))
    return rows.select("term", *(F.round(F.col("v")[k], 6).alias(f"v{k}") for k in range(4)))


def build_and_query(spark, sf_dir):
    """A whole build over `documents` with the offline models, and what is nearest to one of its terms; rows only."""
    path = fresh_path(spark, "build")
    settings = Settings(output_dir=path)
    pipeline.build(_docs(spark, sf_dir), settings)
    term = store.read_shards(spark, f"{path}/concepts").orderBy(F.round("strength", 9).desc(), "raw_term").select("raw_term").limit(1).select("raw_term", models.hashed_embedding(F.col("raw_term")).alias("v")).first()
    found = pipeline.retrieve(spark, path, pipeline.query_position(list(term.v), settings.placement.projection_seed))
    return found.select("raw_term", "source", "shard_id", "label", F.round("distance", 6).alias("distance"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        chunks, chunk_counts, tokens, ngrams, term_df, tfidf_scores, top_terms_per_source, top_terms_small, term_chunk_lists, strengths, strengths_per_source, survival_counts, last_wins_dedupe,
        placed_filter, max_concepts_topk, pair_distances, knn, gromov_delta, eigen_signature, eigen_power_sums, mds_trace, directions, spherical_angle, flat_position, positions, poincare_to_origin, mobius_local,
        isometry_check, leader_anchors, shard_assignments, shard_sizes, registry_resume, nearest_shards, shard_roundtrip, retrieve_global, retrieve_local_raw, retrieve_exact, retrieve_display, rag_prompt,
        chunk_signal, top_chunks, summary_prompt, name_prompts, enriched_terms, custom_ngrams, source_order, validate_names, embedding_join, strength_left_join, hashed_embeddings, build_and_query,
    )
}

__all__ = ["ORACLES", "QUERIES"]
