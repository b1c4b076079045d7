"""Positions of concepts in the Poincare ball."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Placement
from ..functions import hyperbolic as H
from .neighbors import knn, neighborhood_geometry


def eligible(terms: DataFrame, settings: Placement) -> DataFrame:
    """Terms whose strength reaches the threshold; of these the max_concepts strongest, ties by ord."""
    kept = terms.filter(F.col("strength") >= settings.strength_threshold)
    return kept if settings.max_concepts is None else kept.orderBy(F.col("strength").desc(), "ord").limit(settings.max_concepts)


def positions(terms: DataFrame, settings: Placement, dimension: int) -> DataFrame:
    """(id, ord, strength, v) to the same with delta, the neighbourhood's signature, and pos, the global position."""
    vectors = H.projections(dimension, settings.projection_seed)
    kept = eligible(terms, settings)
    points = kept.select("id", "v")
    shape = neighborhood_geometry(points, knn(points, settings.k_neighbors))
    return kept.join(shape, "id").withColumn("pos", H.scaled(H.radius(F.col("strength"), F.col("gromov_delta")), H.direction(F.col("v"), vectors)))
