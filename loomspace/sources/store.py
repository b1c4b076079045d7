"""Stored concepts, one Parquet partition per shard, and the registry; an export of shards as TOML."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import last_wins
from ..operators.sharding import Registry
from .shared import exists


#: Rows of one file of a shard: a larger shard has several.
FILE_ROWS = 1_000_000


def write_concepts(concepts: DataFrame, path: str, dedupe: bool = True) -> None:
    """Concepts by shard, without embeddings; of equal terms in a shard the one of the largest ord stays if dedupe. What was there before is replaced.

    Rows are rebalanced by shard: small shards share tasks, and a shard with a large part of all rows is split into several tasks and files.
    kind names the geometry of the coordinates, hyperbolic unless the rows say otherwise.
    """
    rows = concepts.drop("v", "embedding")
    if "kind" not in rows.columns:
        rows = rows.withColumn("kind", F.lit("hyperbolic"))
    if dedupe:
        rows = last_wins(rows, ["shard_id", "raw_term"], [F.col("ord").desc()])
    rows.hint("rebalance", "shard_id").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard_id").parquet(path)


def read_shards(spark: SparkSession, path: str, shard_ids: list[str] | None = None) -> DataFrame:
    """All shards, or those with these ids: only their own folders are listed and read. Ids that are not there are skipped."""
    if shard_ids is None:
        return spark.read.parquet(path)
    there = [at for at in dict.fromkeys(f"{path}/shard_id={i}" for i in shard_ids) if exists(spark, at)]
    return spark.read.option("basePath", path).parquet(*there) if there else spark.read.parquet(path).filter("false")


def write_registry(spark: SparkSession, registry: Registry, path: str, seed: int, dimension: int) -> None:
    row = {"numbers": registry.numbers, "positions": [list(p) for p in registry.positions], "orders": registry.orders, "next_id": registry.next_id, "projection_seed": seed, "embedding_dim": dimension}
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_registry(spark: SparkSession, path: str) -> tuple[Registry, int, int]:
    """The registry with its projection seed and dimension; queries have to use the same."""
    row = json.loads(spark.read.text(path).first().value)
    return Registry(row["numbers"], [tuple(p) for p in row["positions"]], row["orders"], row["next_id"]), row["projection_seed"], row["embedding_dim"]


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def shard_toml(shard_id: str, concepts: list[dict]) -> str:
    """One shard as TOML: concepts by raw term, hyperbolic coordinates, no embeddings; a missing line is left out."""
    lines = [f"shard_id = {_quoted(shard_id)}", ""]
    for c in sorted(concepts, key=lambda c: c["raw_term"]):
        lines += [f"[concepts.{_quoted(c['raw_term'])}]", *(f"{k} = {_quoted(c[k] or '')}" for k in ("raw_term", "label", "description")), f"strength = {float(c['strength'])!r}", f"source_path = {_quoted(c['source'])}"]
        if c.get("source_line") is not None:
            lines.append(f"source_line = {int(c['source_line'])}")
        lines += ["", f"[concepts.{_quoted(c['raw_term'])}.coordinate.Hyperbolic]", f"position = {[float(x) for x in c['local_pos']]!r}", ""]
        lines += [f"[concepts.{_quoted(c['raw_term'])}.confidence]", *(f"{k} = {float(c[k])!r}" for k in ("gromov_delta", "eigenvalue_ratio", "first_dominance", "neg_eigenvalue_fraction")), ""]
    return "\n".join(lines)


def toml_shards(concepts: DataFrame) -> DataFrame:
    """(shard_id, toml) per shard that has concepts; a shard's rows meet in one task, as a file of it has to."""

    def made(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard_id": [key[0]], "toml": [shard_toml(key[0], rows.to_dict("records"))]})

    columns = ["shard_id", "raw_term", "label", "description", "strength", "source", "source_line", "local_pos", "gromov_delta", "eigenvalue_ratio", "first_dominance", "neg_eigenvalue_fraction"]
    return concepts.select(*columns).groupBy("shard_id").applyInPandas(made, "shard_id string, toml string")
