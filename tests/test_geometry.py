import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspace.functions import hyperbolic as H
from loomspace.operators import neighbors, sharding


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vec(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def distance(spark, a, b):
    return value(spark, H.poincare_distance(vec(*a), vec(*b), len(a)))


def test_distance(spark):
    assert distance(spark, (0, 0), (0, 0)) == 0
    assert distance(spark, (0.3, 0.1), (0.5, 0.4)) == pytest.approx(distance(spark, (0.5, 0.4), (0.3, 0.1)))
    assert distance(spark, (0.8, 0), (0.9, 0)) > 3 * distance(spark, (0.1, 0), (0.2, 0))


def test_isometry_and_formula(spark):
    o, u, v = (0.7, 0.1, 0.0), (0.75, 0.12, 0.05), (0.6, 0.3, 0.1)
    moved = [value(spark, H.to_origin(vec(*o), vec(*x))) for x in (u, v)]
    assert distance(spark, *moved) == pytest.approx(distance(spark, u, v), abs=1e-8)
    assert value(spark, H.to_origin(vec(*o), vec(*o))) == pytest.approx([0, 0, 0], abs=1e-12)
    assert np.linalg.norm(moved[0]) < 0.2
    x, y = (0.3, 0.1, 0.2), (0.5, 0.4, -0.1)
    assert distance(spark, x, y) == pytest.approx(2 * math.atanh(np.linalg.norm(value(spark, H.to_origin(vec(*x), vec(*y))))))


def test_direction(spark):
    vectors = H.projections(4, 42)
    assert vectors == H.projections(4, 42) != H.projections(4, 43)
    assert np.linalg.norm(value(spark, H.direction(vec(1, 2, 3, 4), vectors))) == pytest.approx(1)
    assert value(spark, H.direction(vec(0, 0, 0, 0), vectors)) == [1, 0, 0]


def test_radius(spark):
    at = lambda s, d: value(spark, H.radius(F.lit(s), F.lit(d)))
    assert at(0.9, 0.0) < at(0.5, 0.0) < at(0.0001, 0.0) == 0.95
    assert at(0.5, 0.15) == pytest.approx(at(0.5, 0.149) + 0.1)


def signature(d):
    return neighbors.signatures(neighbors.eigenvalues(d[None])).iloc[0]


def test_signature_classes():
    flat = np.abs(np.subtract.outer(np.arange(6.0), np.arange(6.0)))
    assert signature(flat)["class"] == "flat"
    assert signature(np.zeros((4, 4))).tolist() == ["flat", 0.0, 0.0, 0.0]
    square = np.array([[0, 1, math.sqrt(2), 1], [1, 0, 1, math.sqrt(2)], [math.sqrt(2), 1, 0, 1], [1, math.sqrt(2), 1, 0]])
    assert signature(square)["class"] == "spherical"
    star = np.full((7, 7), 2.0) - 2 * np.eye(7)
    star[0, 1:] = star[1:, 0] = 0.4  # no Euclidean points have these distances
    assert signature(star)["neg_eigenvalue_fraction"] > 0
    both = neighbors.eigenvalues(np.stack((star, 2 * star)))
    assert both[1] == pytest.approx(4 * both[0])


def test_gromov():
    delta = lambda d: neighbors.gromov_deltas(d[None])[0]
    assert delta(np.zeros((3, 3))) == 0
    line = np.abs(np.subtract.outer(np.arange(5.0), np.arange(5.0)))
    assert delta(line) == 0
    cycle = np.array([[0, 1, 2, 1], [1, 0, 1, 2], [2, 1, 0, 1], [1, 2, 1, 0]], float)
    assert delta(cycle) == 1


def points(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(rows)], "ord long, pos array<double>")


def test_routing(spark):
    placed = points(spark, [(0.1, 0, 0), (0.92, 0, 0), (0.93, 0.01, 0), (-0.92, 0, 0), (-0.90, 0.02, 0), (0, 0.92, 0)])
    registry = sharding.find_anchors(placed, 0.9)
    found = {r.ord: r for r in sharding.assign(placed, registry, 0.9).collect()}
    assert [found[k].shard_id for k in range(6)] == ["shard-0", "shard-1", "shard-1", "shard-2", "shard-2", "shard-3"]
    assert found[1].local_pos == pytest.approx([0, 0, 0]) and found[1].is_new and not found[2].is_new
    assert registry.next_id == 4
    more = sharding.find_anchors(points(spark, [(0, -0.92, 0)]), 0.9, registry)
    assert more.numbers == [0, 1, 2, 3, 4]


def greedy(rows, radius):
    anchors, out = [np.zeros(3)], []
    for p in rows:
        d = [sharding.distances(a[None], p[None])[0, 0] for a in anchors]
        if min(d) <= radius:
            out.append(int(np.argmin(d)))
        else:
            anchors.append(p)
            out.append(len(anchors) - 1)
    return out


@pytest.mark.parametrize("batch", [3, 4096])
def test_routing_is_the_sequential_rule(spark, batch):
    r = np.random.default_rng(4)
    rows = r.normal(size=(150, 3))
    rows = rows / np.linalg.norm(rows, axis=1)[:, None] * r.uniform(0, 0.95, (150, 1))
    placed = points(spark, rows.tolist()).repartition(5)
    registry = sharding.find_anchors(placed, 0.9, batch=batch)
    found = {x.ord: x.shard_no for x in sharding.assign(placed, registry, 0.9).collect()}
    assert [found[k] for k in range(150)] == greedy(rows, 0.9)


@pytest.mark.parametrize("block", [7, 1024])
def test_knn(spark, block):
    rows = np.random.default_rng(1).normal(size=(40, 3))
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(rows)], "id long, v array<double>")
    found = {(x.id, x["rank"]): x.neighbor for x in neighbors.knn(df, 3, block).collect()}
    d = np.linalg.norm(rows[:, None] - rows[None], axis=2) + np.diag([np.inf] * 40)
    assert all(found[i, k + 1] == int(np.argsort(d[i])[k]) for i in range(40) for k in range(3))
    summary = neighbors.distance_summary(df, block).first()
    pairs = d[np.triu_indices(40, 1)]
    assert summary.n_pairs == len(pairs) and summary.mean_distance == pytest.approx(pairs.mean()) and summary.largest_distance == pytest.approx(pairs.max())
    few = df.filter("id < 2")
    assert neighbors.knn(few, 5, block).count() == 2


def test_knn_measures_again_what_rounding_leaves_open(spark):
    rng = np.random.default_rng(5)
    x = 1e7 + np.round(rng.normal(size=(90, 6)), 2)
    x[40:50] = x[39]
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    wanted = {i: sorted((d[i, j], j) for j in range(90) if j != i)[:4] for i in range(90)}
    for block in (16, 1024):
        found = {}
        for r in neighbors.knn(df, 4, block).collect():
            found.setdefault(r.id, []).append((r["rank"], r.distance, r.neighbor))
        assert {i: [(dist, j) for _, dist, j in sorted(v)] for i, v in found.items()} == wanted


def test_knn_of_values_without_finite_norms(spark):
    df = spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e200, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 2.0]), (5, [float("nan"), 1.0])], "id long, v array<double>")
    assert {(r.id, r.neighbor, r.distance) for r in neighbors.knn(df, 2, 8).collect()} == {(1, 2, 1.0), (2, 1, 1.0), (3, 4, 2.0), (4, 3, 2.0)}


def test_vectors_are_dealt_out_in_proportion_to_their_number(spark, monkeypatch):
    """F6, F11 to F15, F22: blocks grow with the table, so a vector meets SPREAD blocks, not more with every block of rows; sums, least and largest are those of all pairs."""
    monkeypatch.setattr(neighbors, "LEAST", 8)
    monkeypatch.setattr(neighbors, "SLICE", 64)
    monkeypatch.setattr(neighbors, "OPEN", 50)
    rng = np.random.default_rng(8)
    for n in (5, 130, 300):
        x = rng.normal(size=(n, 4))
        x[n // 2 :: 3] = x[0]
        df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, v array<double>")
        assert neighbors._packed(df, None)[1] <= neighbors.SPREAD
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        wanted = {(i, r + 1, j, d[i, j]) for i in range(n) for r, j in enumerate(sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:3])}
        assert {(r.id, r["rank"], r.neighbor, r.distance) for r in neighbors.knn(df, 3).collect()} == wanted
        found, pairs = neighbors.distance_summary(df).first(), d[np.triu_indices(n, 1)]
        assert (found.n_pairs, found.least_distance, found.largest_distance) == (len(pairs), pairs.min(), pairs.max())
        assert found.mean_distance == pytest.approx(pairs.mean(), rel=1e-9)


def test_limits_are_reached_by_k_values():
    x = np.random.default_rng(2).normal(size=(20, 1000))
    for k in (1, 5, 16, 17):
        limit = neighbors._limits(x, k)
        assert (np.sort(x, axis=1)[:, k - 1] <= limit).all() and ((x <= limit[:, None]).sum(axis=1) < 4 * k + 5).all()
