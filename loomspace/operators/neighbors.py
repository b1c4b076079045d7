"""Exact nearest neighbours in blocks, and the geometry of each neighbourhood.

Vectors are packed into SPREAD blocks, or more where blocks would pass LARGEST rows, and pairs of blocks meet, each pair once, as a group of its own, so a task sees two blocks, never a
table, and vectors are dealt out as often as there are blocks: in proportion to their number up to SPREAD * LARGEST of them. Each pair of blocks keeps the k best per row of either before
anything is shuffled. All pairs are compared, by matrix products of a slice of one block with the other; distances are then taken from the differences themselves, of all
pairs that rounding could have put on the wrong side. The result is exact, and the work is quadratic in the number of vectors, which the term caps of a build bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import written

#: Blocks of a table, and the least and the most rows of one.
SPREAD, LEAST, LARGEST = 16, 1024, 32_768
#: Pairs that a matrix product compares at once: they stay in a core's cache.
SLICE = 1 << 19
#: Pairs that are measured again at once, where many vectors are equal.
OPEN = 1 << 20


def _packed(points: DataFrame, block: int | None) -> tuple[DataFrame, int]:
    """(b, ids, v, n): the ids and vectors of each block as bytes, stored, as each block meets all others."""
    count = points.count()
    n = max(1, -(-count // (block or min(LARGEST, max(LEAST, -(-count // SPREAD))))))

    def pack(table: pa.Table) -> pa.Table:
        ids, v = table.column("id").combine_chunks(), table.column("v").combine_chunks()
        if len(pc.unique(pc.list_value_length(v))) > 1 or v.flatten().null_count or ids.null_count:
            raise ValueError("ids and vectors must not be null, and all vectors need one length")
        packed = [np.asarray(ids, np.int64).tobytes()], [np.asarray(v.flatten(), np.float64).tobytes()]
        return pa.table({"b": table.column("b").slice(0, 1), "ids": pa.array(packed[0], pa.binary()), "v": pa.array(packed[1], pa.binary()), "n": pa.array([len(ids)], pa.int32())})

    rows = points.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"), F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    # as many partitions as asked for: these rows are small beside the work on them
    return written(rows.repartition(n, "b").groupBy("b").applyInArrow(pack, "b int, ids binary, v binary, n int"), "blocks"), n


def _met(points: DataFrame, block: int | None, run: Callable[[bool, tuple, tuple], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What run(same, left, right) makes of each pair of blocks a <= b; either is (ids, vectors)."""
    packed, n = _packed(points, block)
    left = packed.withColumn("a", F.col("b")).withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(n - 1)))).select("a", "b", F.lit(0).alias("side"), "ids", "v", "n")
    right = packed.filter("b > 0").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select("a", "b", F.lit(1).alias("side"), "ids", "v", "n")
    rows = left.union(right)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def meet(table: pa.Table) -> pa.Table:
        sides = sorted(table.to_pylist(), key=lambda r: r["side"])
        if sides[0]["a"] < sides[0]["b"] and len(sides) < 2:  # a block without rows
            return arrow.empty_table()
        blocks = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["v"], np.float64).reshape(r["n"], -1)) for r in sides]
        found = list(run(len(sides) == 1, blocks[0], blocks[-1]))
        return pa.Table.from_pandas(pd.concat(found), arrow, preserve_index=False) if found else arrow.empty_table()

    pairs = n * (n + 1) // 2
    return rows.repartition(min(pairs, 1000), "a", "b").groupBy("a", "b").applyInArrow(meet, schema)


def _slices(x: np.ndarray, y: np.ndarray) -> Iterator[slice]:
    step = max(1, SLICE // max(1, len(y)))
    for k in range(0, len(x), step):
        yield slice(k, k + step)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    for k in range(0, len(x), 64):
        out[k : k + 64] = np.sqrt(((x[k : k + 64, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    return out


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a matrix product, and a bound of how far rounding may have moved them. Norms that overflow go without the product."""
    with np.errstate(over="ignore", invalid="ignore"):
        p, q = (x * x).sum(axis=1), (y * y).sum(axis=1)
        if not np.isfinite(p).all() or not np.isfinite(q).all():
            return _distances(x, y), 0.0
        slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * float(p.max() + q.max())
        out = x @ y.T
        out *= -2
        out += p[:, None]
        out += q
        return out, slack


def _best(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, same: bool) -> Iterator[pd.DataFrame]:
    """The k nearest others of each id, ties by id: all pairs within twice the slack of the k-th are measured again. Only the same block has the same ids."""
    kept, n = [], 0
    for some in _slices(x, y):
        squares, slack = _squares(x[some], y)
        if same:
            squares[ids[some, None] == others[None, :]] = np.inf
        if not slack:
            squares[np.isnan(squares)] = np.inf
        i, j = np.nonzero(squares <= (_limits(squares, k) + 2 * slack)[:, None])
        fits = np.isfinite(squares[i, j])
        kept.append((i[fits] + some.start, j[fits]))
        n += len(i)
        if n >= OPEN:
            yield _nearest(ids, x, others, y, kept, k)
            kept, n = [], 0
    if kept:
        yield _nearest(ids, x, others, y, kept, k)


def _nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    i, j = (np.concatenate(part) for part in zip(*pairs, strict=True))
    d = _measured(x, y, i, j)
    order = np.lexsort((others[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    found = pd.DataFrame({"id": ids[i[first]], "neighbor": others[j[first]], "distance": d[first]})
    return found[np.isfinite(found["distance"])]


def _limits(values: np.ndarray, k: int, groups: int = 64) -> np.ndarray:
    """For each row a value that at least k of its values reach from below: the k-th of all, or, for long rows, the k-th of the least values of groups."""
    rows, n = values.shape
    if n >= 8 * groups and k <= groups // 4:
        width = n // groups
        values = values[:, : groups * width].reshape(rows, groups, width).min(axis=2)
    nth = min(k, values.shape[1]) - 1
    return np.partition(values, nth, axis=1)[:, nth]


def _measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of x[i] and y[j], from their differences."""
    d = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        d[part] = np.sqrt(((x[i[part]] - y[j[part]]) ** 2).sum(axis=1))
    return d


def knn(points: DataFrame, k: int = 5, block: int | None = None) -> DataFrame:
    """(id, v) to (id, neighbor, distance, rank): the k nearest others by Euclidean distance, ties by id."""

    def run(same: bool, left: tuple, right: tuple) -> Iterator[pd.DataFrame]:
        yield from _best(*left, *right, k, same)
        if not same:
            yield from _best(*right, *left, k, same)

    found = _met(points, block, run, "id bigint, neighbor bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


#: A pair is measured again if its square is within so many times the slack of 0: the others' roots are off by less than 1e-7 of themselves.
_CLOSE = 1e7


def _summed(x: np.ndarray, y: np.ndarray, wanted: np.ndarray | None) -> tuple[int, float, float, float]:
    """Number, sum, least and largest of the distances of x and y, of those wanted. Close pairs, and those that may be least or largest, are measured by their differences."""
    squares, slack = _squares(x, y)
    if not slack:  # these are distances already
        d = squares if wanted is None else squares[wanted]
        return (d.size, d.sum(), d.min(), d.max()) if d.size else (0, 0.0, 0.0, 0.0)
    n = squares.size if wanted is None else int(wanted.sum())
    if not n:
        return 0, 0.0, 0.0, 0.0
    if wanted is None:
        low, high = squares.min(), squares.max()
    else:
        low, high = squares.min(initial=np.inf, where=wanted), squares.max(initial=-np.inf, where=wanted)
    open_ = (squares <= max(_CLOSE * slack, low + 2 * slack)) | (squares >= high - 2 * slack)
    if wanted is not None:
        open_ &= wanted
    i, j = np.nonzero(open_)
    d = _measured(x, y, i, j)
    squares[i, j] = 0
    if wanted is not None:
        squares[~wanted] = 0
    return n, np.sqrt(squares, out=squares).sum() + d.sum(), d.min(), d.max()


def distance_summary(points: DataFrame, block: int | None = None) -> DataFrame:
    """One row over all pairs of different points: n_pairs, mean, least, largest distance. Each pair of blocks sends one row."""

    def run(same: bool, left: tuple, right: tuple) -> Iterator[pd.DataFrame]:
        (ids, x), (others, y) = left, right
        parts = [_summed(x[some], y, ids[some, None] < others[None, :] if same else None) for some in _slices(x, y)]
        n, total, low, high = zip(*[p for p in parts if p[0]] or [(0, 0.0, 0.0, 0.0)], strict=True)
        if sum(n):
            yield pd.DataFrame({"n": [sum(n)], "total": [sum(total)], "low": [np.min(low)], "high": [np.max(high)]})

    sums = _met(points, block, run, "n bigint, total double, low double, high double")
    return sums.agg(F.sum("n").alias("n_pairs"), (F.sum("total") / F.sum("n")).alias("mean_distance"), F.min("low").alias("least_distance"), F.max("high").alias("largest_distance"))


@cache
def _quadruples(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 4))).T


def gromov_deltas(d: np.ndarray) -> np.ndarray:
    """Of each of a stack of distance matrices: the largest half difference of the two largest of the three pair sums, over all quadruples; 0 for less than 4 points."""
    n = d.shape[1]
    if n < 4:
        return np.zeros(len(d))
    i, j, k, m = _quadruples(n)
    sums = np.sort(np.stack((d[:, i, j] + d[:, k, m], d[:, i, k] + d[:, j, m], d[:, i, m] + d[:, j, k])), axis=0)
    return ((sums[2] - sums[1]) / 2).max(axis=1)


def eigenvalues(d: np.ndarray) -> np.ndarray:
    """Of each of a stack of distance matrices: the eigenvalues, largest first, of the double-centred squared distances."""
    n = d.shape[1]
    centre = np.eye(n) - 1.0 / n
    gram = -0.5 * centre @ (d * d) @ centre
    return np.linalg.eigvalsh((gram + gram.transpose(0, 2, 1)) / 2)[:, ::-1]


def signatures(values: np.ndarray) -> pd.DataFrame:
    """Of each row of eigenvalues: class, eigenvalue_ratio (second to first), first_dominance (share of the first), neg_eigenvalue_fraction (share of clearly negative ones)."""
    n = values.shape[1]
    mass = np.abs(values).sum(axis=1)
    none = mass < 1e-10
    share = values / np.where(none, 1, mass)[:, None]
    first = share[:, 0]
    ratio = share[:, 1] / (first + 1e-10) if n > 1 else np.zeros(len(values))
    negative = (values < -0.05 * np.abs(values[:, :1])).sum(axis=1)
    kind = np.select([none, ratio > 0.6, negative > n // 3, first > 0.7], ["flat", "spherical", "hyperbolic", "flat"], "hyperbolic")
    found = {"eigenvalue_ratio": ratio, "first_dominance": first, "neg_eigenvalue_fraction": negative / n}
    return pd.DataFrame({"class": kind, **{k: np.where(none, 0.0, v) for k, v in found.items()}})


def neighborhood_geometry(points: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(id, gromov_delta, class, eigenvalue_ratio, first_dominance, neg_eigenvalue_fraction, trace, eigenvalues) per point; a neighbourhood is a point and its neighbours.

    A group is one neighbourhood, k + 1 vectors at most; those of a batch that have the same size are computed at once.
    """
    own = points.select("id", F.lit(0).alias("rank"), "v")
    others = neighbors.join(points.select(F.col("id").alias("neighbor"), "v"), "neighbor").select("id", "rank", "v")
    groups = own.union(others).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("around"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for n, some in part.groupby(part["around"].map(len)):
                x = np.array([[r["v"] for r in around] for around in some["around"]], float)
                d = np.sqrt(((x[:, :, None, :] - x[:, None, :, :]) ** 2).sum(axis=3))
                values = eigenvalues(d)
                found = {"id": some["id"].to_numpy(), "gromov_delta": gromov_deltas(d), **signatures(values), "trace": (d * d).sum(axis=(1, 2)) / (2 * n)}
                yield pd.DataFrame(found).assign(eigenvalues=list(values))

    return groups.mapInPandas(run, "id bigint, gromov_delta double, class string, eigenvalue_ratio double, first_dominance double, neg_eigenvalue_fraction double, trace double, eigenvalues array<double>")
