"""Connected components of a graph of any size, by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """What stays the same once the steps change nothing any more."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u bigint, v bigint) edges to (node, root), root being the least node that can be reached; nodes without edges are not in it.

    Per round every neighbour list is used through its minimum only, so a node with very many edges is pre-aggregated.
    Rounds grow with the logarithm of the longest chain; each is cut off as a written table, which replaces the one before.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = fresh_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = stored(_tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    before = _mark(now)
    while before[0]:
        last = path
        now, path = stored(_tidy(_small_star(_tidy(_large_star(now)))))
        remove(spark, last)
        after = _mark(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    found = written(roots, "components")
    remove(spark, path)
    return found
