"""Greedy leader clustering in hyperbolic distance, in rounds.

In order, a concept joins its nearest anchor if that is within the radius, else becomes an anchor. An anchor is therefore
whoever no earlier anchor covers. Each round takes the first BATCH concepts that the anchors so far leave uncovered (a distributed
filter and a top-k) and runs the sequential rule on these alone; nothing before the last of them can change any more.

Anchors are broadcast: positions have norm 0.95 at most and anchors are more than the radius apart, so however many concepts there
are, the volume of the ball bounds the anchors (about 15,000 at radius 0.9).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hyperbolic as H

BATCH = 4096


@dataclass
class Registry:
    """Anchors in order of birth: number, position, order of the concept that made it (-1: the origin). next_id numbers the next shard."""

    numbers: list[int] = field(default_factory=lambda: [0])
    positions: list[tuple[float, float, float]] = field(default_factory=lambda: [(0.0, 0.0, 0.0)])
    orders: list[int] = field(default_factory=lambda: [-1])
    next_id: int = 1

    def add(self, position: tuple[float, float, float], order: int) -> int:
        self.numbers.append(self.next_id)
        self.positions.append(tuple(position))
        self.orders.append(order)
        self.next_id += 1
        return self.next_id - 1

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, f"shard-{n}", list(p), o) for n, p, o in zip(self.numbers, self.positions, self.orders, strict=True)]
        return spark.createDataFrame(rows, "shard_no int, shard_id string, anchor array<double>, ord bigint")


def distances(anchors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Poincare distances, points by anchors."""
    gap = ((points[:, None, :] - anchors[None, :, :]) ** 2).sum(axis=2)
    below = (1 - (anchors**2).sum(axis=1))[None, :] * (1 - (points**2).sum(axis=1))[:, None]
    return np.arccosh(np.maximum(1.0, 1 + 2 * gap / below))


def _near(points: pd.DataFrame, anchors: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest anchor that was there when the point came: index (first on ties) and distance."""
    where, how_far = [], []
    xs, born = np.array(points["pos"].tolist(), float), points["ord"].to_numpy()
    for k in range(0, len(xs), 512):
        d = distances(anchors, xs[k : k + 512])
        d[orders[None, :] > born[k : k + 512, None]] = np.inf
        best = d.argmin(axis=1)
        where.append(best)
        how_far.append(d[np.arange(len(best)), best])
    return np.concatenate(where), np.concatenate(how_far)


def find_anchors(placed: DataFrame, radius: float, registry: Registry | None = None, batch: int = BATCH) -> Registry:
    """(ord, pos) to the registry after all concepts were routed in order of ord; a given registry goes on from where it stood."""
    registry = registry or Registry()
    registry.orders = [-1] * len(registry.orders)  # anchors of an earlier run are there for everyone
    context = placed.sparkSession.sparkContext

    while True:
        held = context.broadcast((np.array(registry.positions), np.array(registry.orders)))

        def uncovered(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    yield part[_near(part, *held.value)[1] > radius]

        first = placed.select("ord", "pos").mapInPandas(uncovered, "ord bigint, pos array<double>").orderBy("ord").limit(batch).collect()
        held.unpersist()
        points = np.array([row.pos for row in first], float).reshape(-1, 3)
        open_ = np.ones(len(points), bool)  # not covered by an anchor of this batch
        for k, row in enumerate(first):
            if open_[k]:
                registry.add(tuple(row.pos), row.ord)
                open_[k:] &= distances(points[k : k + 1], points[k:])[:, 0] > radius
        if len(first) < batch:
            return registry


def assign(placed: DataFrame, registry: Registry, radius: float) -> DataFrame:
    """placed with shard_no, shard_id, distance, is_new and local_pos, the position in the shard's frame. Nearest means nearest among the anchors of then."""
    held = placed.sparkSession.sparkContext.broadcast((np.array(registry.positions), np.array(registry.orders), np.array(registry.numbers)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, orders, numbers = held.value
        for part in parts:
            if len(part):
                at, d = _near(part, anchors, orders)
                yield pd.DataFrame({"ord": part["ord"], "shard_no": numbers[at], "anchor": list(anchors[at]), "distance": d, "is_new": orders[at] == part["ord"].to_numpy()})

    found = placed.select("ord", "pos").mapInPandas(run, "ord bigint, shard_no int, anchor array<double>, distance double, is_new boolean")
    both = placed.join(found, "ord")
    return both.withColumn("shard_id", F.concat(F.lit("shard-"), F.col("shard_no"))).withColumn("local_pos", H.to_origin(F.col("anchor"), F.col("pos")))
