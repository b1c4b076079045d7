"""Routing of placed concepts as they arrive: each micro-batch goes on from the stored registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sharding
from ..sources import store


def route_stream(placed: DataFrame, path: str, checkpoint: str, radius: float = 0.9, seed: int = 42, dimension: int = 64) -> StreamingQuery:
    """A stream of (ord, pos, ...) to Parquet under path/concepts, partitioned by shard; path/registry holds the anchors so far.

    A batch that is run again after a failure overwrites its own rows, and starts from the registry as it was before that batch, so its result is the same.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        kept = rows.persist()
        try:
            before = f"{path}/registry/{number - 1}"
            registry = store.read_registry(spark, before)[0] if number else sharding.Registry()
            found = sharding.find_anchors(kept, radius, registry)
            routed = sharding.assign(kept, found, radius)
            routed.write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/concepts/batch={number}")
            store.write_registry(spark, found, f"{path}/registry/{number}", seed, dimension)
        finally:
            kept.unpersist()

    return placed.withColumn("ord", F.col("ord").cast("bigint")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
