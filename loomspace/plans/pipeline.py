"""A build from documents to stored concepts, its dry run, and answers from what is stored."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import hyperbolic as H
from ..functions import text as T
from ..operators import chunking, counting, enrichment, holding, placement, scoring, sharding
from ..sources import models, store
from ..sources.shared import counted, scratch, written


def scored_terms(docs: DataFrame, settings: Settings) -> DataFrame:
    """(source, term, df, score, first_line, rank, strength) of the best terms of each source."""
    cut = chunking.chunks(docs, settings.ingest)
    scores = scoring.tfidf(counting.term_frequencies(cut, settings.scoring), scoring.chunk_counts(docs, settings.ingest.stride))
    best = written(scoring.strengths(scoring.top_terms(scores, settings.max_concepts_per_source), settings.normalize), "best-terms")
    return holding.first_lines(cut, best, settings.scoring.max_n)


def dry_run(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """How many terms each strength threshold would leave; no models are called and nothing is stored."""
    return scoring.survival(scored_terms(docs, settings or Settings()))


def source_numbers(docs: DataFrame) -> DataFrame:
    """(source, source_no): the place of each source in the routing order. That is source_ord where docs have it, as read_texts gives it, else the order of names."""
    if "source_ord" in docs.columns:
        return docs.groupBy("source").agg(F.min("source_ord").cast("bigint").alias("source_no"))
    # only the sources are numbered in one place, not their rows
    return docs.select("source").distinct().withColumn("source_no", F.row_number().over(Window.orderBy("source")).cast("bigint"))


def routing_order(terms: DataFrame, sources: DataFrame) -> DataFrame:
    """terms with ord, by source, then score, then term: within a source the rank says it. sources: as source_numbers gives them."""
    return terms.join(sources, "source").withColumn("ord", F.col("source_no") * F.lit(1 << 32) + F.col("rank")).drop("source_no")


def placed_terms(terms: DataFrame, embedded: DataFrame, settings: Settings, dimension: int, registry: sharding.Registry | None = None, sources: DataFrame | None = None) -> tuple[DataFrame, sharding.Registry]:
    """terms joined to (term, v), placed and routed. Terms without a vector are left out. sources: their order, by name if not given.

    Terms with vectors, and positions, are stored in the shared folder: routing reads positions once per round, and nothing before them is computed again.
    """
    numbered = routing_order(terms.join(embedded, "term"), source_numbers(terms) if sources is None else sources)
    numbered = written(numbered.withColumn("id", F.xxhash64("source", "term")), "placed-terms")
    spots = placement.positions(numbered.select("id", "ord", "strength", "v"), settings.placement, dimension)
    spots = written(spots.select("id", "ord", "pos", "gromov_delta", "class", "eigenvalue_ratio", "first_dominance", "neg_eigenvalue_fraction"), "positions")
    found = sharding.find_anchors(spots, settings.placement.shard_radius, registry)
    routed = sharding.assign(spots, found, settings.placement.shard_radius)
    return routed.join(numbered.drop("ord", "v"), "id").withColumnRenamed("term", "raw_term").withColumnRenamed("first_line", "source_line"), found


def enriched(concepts: DataFrame, docs: DataFrame, terms: DataFrame, settings: Settings, summarize: Callable[[str], str], name: Callable[[str], str]) -> DataFrame:
    """concepts with description and label: a sentence from the chunks of most signal in the concept's own source, and a validated name."""
    prompts = summary_prompts(docs, terms, settings)
    described = models.mapped(prompts, "prompt", summarize, "raw", "string").select("source", F.col("term").alias("raw_term"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("description"))
    asked = described.withColumn("ask", enrichment.name_prompt(F.col("description")))
    labelled = models.mapped(asked, "ask", name, "proposed", "string").withColumn("label", T.valid_name(F.col("proposed"), F.col("raw_term"))).drop("ask", "proposed")
    return concepts.join(labelled, ["source", "raw_term"], "left").fillna("", ["description", "label"])


def summary_prompts(docs: DataFrame, terms: DataFrame, settings: Settings) -> DataFrame:
    """(source, term, prompt) from the chunks of most signal. Only the documents of these are cut again for their texts."""
    cut = chunking.chunks(docs, settings.ingest)
    kept = terms.select("source", "term", "strength")
    strong = kept.filter(F.col("strength") > settings.enrichment.signal_threshold)
    best = written(enrichment.term_chunks(cut, strong, kept, settings.scoring.max_n, settings.enrichment.max_chunks), "best-chunks")
    chosen = docs.join(counted(best.select("source", "doc_id").distinct(), "best-documents"), ["source", "doc_id"], "left_semi")
    again = chunking.chunks(chosen, settings.ingest)
    context = enrichment.joined(best.join(again.select("source", "doc_id", "start", "text"), ["source", "doc_id", "start"]), ["source", "term"], ["rank"], "text", "\n---\n", "context")
    return context.select("source", "term", enrichment.summary_prompt(F.col("term"), F.col("context")).alias("prompt"))


def build(
    docs: DataFrame, settings: Settings | None = None, embedded: DataFrame | Callable[[DataFrame], DataFrame] | None = None, dimension: int | None = None,
    summarize: Callable[[str], str] | None = None, name: Callable[[str], str] | None = None, report: Callable[[str, float, int | None], None] | None = None,
) -> sharding.Registry:
    """Scores, places, enriches and stores.

    embedded: (term, v), or what makes it of the distinct terms (term), by default the offline hashing embedder with 64 dimensions; dimension: taken from the
    vectors if not given. summarize and name default to the extractive stand-in. report hears of each stage when it ends: name, seconds, rows if they are known.
    Each stage is stored once, in the shared folder, and removed at the end.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    clock = [time.monotonic()]

    def done(stage: str, rows: DataFrame | None = None) -> None:
        n = rows.count() if rows is not None and report else None
        clock.append(time.monotonic())
        if report:
            report(stage, clock[-1] - clock[-2], n)

    with scratch(spark):
        terms = written(scored_terms(docs, s), "scored-terms")
        done("chunks, terms and scores", terms)
        if embedded is None:
            dimension = dimension or 64
            embedded = lambda rows: rows.select("term", models.hashed_embedding(F.col("term"), dimension).alias("v"))
        if callable(embedded):
            embedded = written(embedded(terms.select("term").distinct()), "vectors")
            done("embeddings", embedded)
        if dimension is None:
            first = embedded.select(F.size("v").alias("n")).first()
            dimension = first.n if first else 64
        concepts, registry = placed_terms(terms, embedded, s, dimension, sources=source_numbers(docs))
        done("placement and routing")
        full = enriched(concepts, docs, terms, s, summarize or models.Extract(), name or models.Extract())
        store.write_concepts(full, f"{s.output_dir}/concepts")
        store.write_registry(spark, registry, f"{s.output_dir}/registry", s.placement.projection_seed, dimension)
        done("enrichment and storage")
    return registry


def query_position(v: list[float], seed: int) -> list[float]:
    """Half the unit direction of a query's vector: a query has no strength."""
    raw = [sum(a * b for a, b in zip(v, w, strict=True)) for w in H.projections(len(v), seed)[:3]]
    norm = math.sqrt(sum(x * x for x in raw))
    unit = [1.0, 0.0, 0.0] if norm < 1e-10 else [x / norm for x in raw]
    return [0.5 * x for x in unit]


def nearest_shards(spark: SparkSession, registry: sharding.Registry, position: list[float], k: int = 6) -> DataFrame:
    """(shard_no, shard_id, distance) of the k nearest anchors, ties by number; all if there are fewer."""
    at = F.array(*(F.lit(float(x)) for x in position))
    return registry.frame(spark).select("shard_no", "shard_id", "anchor", H.poincare_distance(F.col("anchor"), at).alias("distance")).orderBy("distance", "shard_no").limit(k)


def retrieve(spark: SparkSession, path: str, position: list[float], shards: int = 6, concepts: int = 5, frame: str = "global") -> DataFrame:
    """The nearest concepts among those of the nearest shards: raw_term, label, description, distance.

    frame: 'global' compares in one frame, 'local_raw' compares stored local positions with the query's global one, for parity only. Only the
    folders of the nearest shards are read. Coordinates of another kind than hyperbolic have no distance here and are left out.
    """
    registry = store.read_registry(spark, f"{path}/registry")[0]
    ids = [r.shard_id for r in nearest_shards(spark, registry, position, shards).collect()]
    rows = store.read_shards(spark, f"{path}/concepts", ids).filter("kind = 'hyperbolic'")
    at = F.array(*(F.lit(float(x)) for x in position))
    where = {"global": F.col("pos"), "local_raw": F.col("local_pos")}[frame]
    return rows.withColumn("distance", H.poincare_distance(where, at)).orderBy("distance", "raw_term").limit(concepts)


def retrieve_exact(spark: SparkSession, path: str, position: list[float], radius: float, concepts: int = 5) -> DataFrame:
    """The nearest concepts of all: shards are read in order of distance until, by the triangle inequality, no other can hold a nearer one."""
    registry = store.read_registry(spark, f"{path}/registry")[0]
    ranked = nearest_shards(spark, registry, position, len(registry.numbers)).collect()
    best, taken, step = None, [], 6
    while len(taken) < len(ranked):
        taken = [r.shard_id for r in ranked[: len(taken) + step]]
        best = retrieve(spark, path, position, len(taken), concepts)
        found = best.collect()
        if len(taken) == len(ranked) or (len(found) == concepts and ranked[len(taken)].distance - radius > found[-1].distance):
            break
        step *= 2
    return best


def display(found: DataFrame) -> DataFrame:
    """What is shown of retrieved concepts: descriptions are cut to 100 characters, which prompts are not."""
    return found.select("distance", "raw_term", "label", F.substring("description", 1, 100).alias("description"))


def answer_prompt(found: DataFrame, question: str) -> DataFrame:
    """One row `prompt` from retrieved concepts in order of distance; facts use the whole descriptions."""
    line = F.concat(F.lit("- "), F.col("raw_term"), F.lit(": "), F.col("description"))
    listed = F.sort_array(F.collect_list(F.struct("distance", "raw_term", line.alias("line"))))
    facts = found.agg(F.array_join(F.transform(listed, lambda r: r["line"]), "\n").alias("facts"))
    return facts.select(enrichment.answer_prompt(F.lit(question), F.col("facts")).alias("prompt"))
