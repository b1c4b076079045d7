"""The Poincare ball as Column expressions over arrays of doubles, unrolled so that they stay in generated code."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column | list[float], n: int) -> Column:
    """Sum of products from left to right."""
    at = (lambda k: F.lit(b[k])) if isinstance(b, list) else (lambda k: b[k])
    total = a[0] * at(0)
    for k in range(1, n):
        total = total + a[k] * at(k)
    return total


def squared(a: Column, b: Column, n: int) -> Column:
    total = (a[0] - b[0]) * (a[0] - b[0])
    for k in range(1, n):
        total = total + (a[k] - b[k]) * (a[k] - b[k])
    return total


def euclidean(a: Column, b: Column, n: int) -> Column:
    return F.sqrt(squared(a, b, n))


def poincare_distance(u: Column, v: Column, n: int = 3) -> Column:
    """acosh(max(1, 1 + 2 |u - v|^2 / ((1 - |u|^2)(1 - |v|^2))))."""
    ratio = 2 * squared(u, v, n) / ((1 - dot(u, u, n)) * (1 - dot(v, v, n)))
    return F.acosh(F.greatest(F.lit(1.0), 1 + ratio))


def mobius_add(a: Column, b: Column, n: int = 3) -> Column:
    ab, aa, bb = dot(a, b, n), dot(a, a, n), dot(b, b, n)
    below = 1 + 2 * ab + aa * bb
    return F.array(*(((1 + 2 * ab + bb) * a[k] + (1 - aa) * b[k]) / below for k in range(n)))


def to_origin(origin: Column, x: Column, n: int = 3) -> Column:
    """x in the frame in which `origin` is the centre: (-origin) + x by Moebius addition."""
    return mobius_add(F.array(*(-origin[k] for k in range(n))), x, n)


def projections(dimension: int, seed: int) -> list[list[float]]:
    """Six fixed Gaussian vectors: three for direction, two for the angle, one for the line. The same on every machine."""
    draw = random.Random(seed).gauss
    return [[draw(0.0, 1.0) for _ in range(dimension)] for _ in range(6)]


def direction(embedding: Column, vectors: list[list[float]]) -> Column:
    """Unit vector of the three projections; the first axis where their norm is below 1e-10."""
    raw = F.array(*(dot(embedding, v, len(v)) for v in vectors[:3]))
    return F.transform(F.array(raw), lambda r: _unit(r))[0]


def _unit(r: Column) -> Column:
    norm = F.sqrt(dot(r, r, 3))
    return F.when(norm < 1e-10, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(r[0] / norm, r[1] / norm, r[2] / norm))


def angle(embedding: Column, vectors: list[list[float]]) -> Column:
    return F.atan2(dot(embedding, vectors[3], len(vectors[3])), dot(embedding, vectors[4], len(vectors[4])))


def flat(embedding: Column, vectors: list[list[float]]) -> Column:
    return dot(embedding, vectors[5], len(vectors[5]))


def radius(strength: Column, delta: Column) -> Column:
    """min(0.95, 1 - 0.9 strength, and 0.1 more for an ambiguous neighbourhood)."""
    return F.least(F.lit(0.95), 1 - F.lit(0.9) * strength + F.when(delta >= 0.15, F.lit(0.1)).otherwise(F.lit(0.0)))


def scaled(by: Column, v: Column) -> Column:
    return F.array(*(v[k] * by for k in range(3)))
