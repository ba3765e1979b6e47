"""Approximate nearest neighbours by largest inner product, in a few stable projections.

Vectors get one more component that makes them all equally long, and queries are scaled to
that length; then the largest inner product is the least distance d. A Gaussian (2-stable)
projection to DIMENSIONS turns d^2 into d^2 times a chi-square variable of as many degrees of
freedom. So a projected distance says how likely a nearer vector is still to come: once all
vectors within projected distance t are verified, and the chi-square distribution at
t^2 / d_k^2, for the distance d_k of the k-th best so far, is at least CONFIDENCE, a query is
done; each vector nearer than d_k was met with that probability.

A kd-tree over projected vectors, fitted on a bounded sample (SAMPLE), deals all vectors to
cells; cells of more than BLOCK rows are split further by hash, so no task holds an unbounded
group. Every query first searches the cell it falls into; its k-th distance then bounds which
other cells the test can't rule out, and these are searched, too. Inside a block the buckets of
a smaller kd-tree that the test can't rule out are verified for many queries at once, by matrix
products. How many vectors the test leaves depends on how much nearer than others the nearest are:
on vectors without such contrast most of them, for each query.

Every vector is indexed. Defined results: vectors that are null, empty, zero or hold null or
non-finite components take no part; nor do rows without vec_id. Of several rows with one
vec_id the least vector counts. Vectors of different dimension are no candidates for each
other. Ties go to the smaller vec_id. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspan.llm.common import stored

NEIGHBOURS = 20
DIMENSIONS = 8
CONFIDENCE = 0.98
SAMPLE = 16_384
SAMPLE_PER_CELL = 16
CELL_ROWS = 4_096
BLOCK = 8_192
BUCKET = 64
#: Queries that go through a block together: 8 bytes for each and each of its rows, a few times.
TOGETHER = 128


def chi_square(x: float, degrees: int) -> float:
    """Distribution function, for an even number of degrees."""
    term = total = math.exp(-x / 2)
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


def projection(dim: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim + 1, dimensions))


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a component that makes them as long as the longest."""
    rest = np.maximum(longest ** 2 - (x * x).sum(axis=1), 0)
    return np.column_stack([x, np.sqrt(rest)])


def scaled(q: np.ndarray, longest: float) -> np.ndarray:
    """Queries of that length, with a zero component."""
    return np.column_stack([q * (longest / np.sqrt((q * q).sum(axis=1)))[:, None],
                            np.zeros(len(q))])


# ---- kd-trees -------------------------------------------------------------------------------


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the leaves: halved at the median of the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        held = todo.pop()
        if len(held) <= size:
            out.append(held)
            continue
        axis = np.ptp(points[held], axis=0).argmax()
        order = np.argsort(points[held, axis], kind="stable")
        todo += [held[order[:len(held) // 2]], held[order[len(held) // 2:]]]
    return out


@dataclass
class Cells:
    """The regions of a kd-tree's leaves: boxes that cover all space."""

    low: np.ndarray
    high: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for cell in range(len(self.low)):
            inside = ((points >= self.low[cell]) & (points < self.high[cell])).all(axis=1)
            out[inside] = cell
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared, from each point to each cell."""
        out = np.empty((len(points), len(self.low)))
        for cell in range(len(self.low)):
            gap = np.maximum(self.low[cell] - points, 0) + np.maximum(
                points - self.high[cell], 0)
            out[:, cell] = (gap * gap).sum(axis=1)
        return out


def fit_cells(sample: np.ndarray, count: int) -> Cells:
    dims = sample.shape[1]
    out, todo = [], [(sample, np.full(dims, -np.inf), np.full(dims, np.inf), count)]
    while todo:
        held, low, high, parts = todo.pop()
        axis = np.ptp(held, axis=0).argmax() if len(held) > 1 else 0
        cut = np.median(held[:, axis]) if len(held) > 1 else 0.0
        near = held[:, axis] < cut if len(held) > 1 else np.zeros(len(held), bool)
        if parts <= 1 or not near.any():
            out.append((low, high))
            continue
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = cut
        todo += [(held[near], low, left_high, parts // 2),
                 (held[~near], right_low, high, parts - parts // 2)]
    return Cells(np.array([x[0] for x in out]), np.array([x[1] for x in out]))


def first_bound(scores: np.ndarray, k: int, length: float, longest: float) -> float:
    """Squared distance of the k-th best score, to the scaled query."""
    if len(scores) < k:
        return math.inf
    worst = 2 * longest ** 2 - 2 * longest * np.partition(scores, -k)[-k] / length
    return max(worst, 0.0) * (1 + 1e-9) + 1e-12


def search_block(ids: np.ndarray, x: np.ndarray, y: np.ndarray, queries: pd.DataFrame,
                 k: int, stop: float, longest: float) -> pd.DataFrame:
    """The best of a block for each query (query_id, vector, projected, bound).

    Queries with the same nearest bucket go through the buckets together, TOGETHER at once: matrix
    products tell the projected distances and rough scores of all rows of the buckets that the
    test leaves to any of them. Queries without a bound get one from their nearest buckets.
    """
    if not len(queries) or not len(ids):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64),
                             "score": np.zeros(0)})
    parts = leaves(y, BUCKET)
    low = np.array([y[p].min(axis=0) for p in parts])
    high = np.array([y[p].max(axis=0) for p in parts])
    asked = queries["query_id"].to_numpy(np.int64)
    q = np.array(queries["vector"].tolist(), np.float64)
    projected = np.array(queries["projected"].tolist(), np.float64)
    bound, length = queries["bound"].to_numpy(np.float64).copy(), np.sqrt((q * q).sum(axis=1))

    def far(p: np.ndarray) -> np.ndarray:
        gap = np.maximum(low - p[:, None], 0) + np.maximum(p[:, None] - high, 0)
        return (gap * gap).sum(axis=2)

    nearest_part = np.zeros(len(asked), np.int64)
    some = max(4, -(-(k + 1) // (BUCKET // 2)))
    for begin in range(0, len(asked), TOGETHER):
        away = far(projected[begin:begin + TOGETHER])
        nearest_part[begin:begin + TOGETHER] = away.argmin(axis=1)
        for i in begin + np.flatnonzero(np.isinf(bound[begin:begin + TOGETHER])):
            rows = np.concatenate([parts[c] for c in np.argsort(
                away[i - begin], kind="stable")[:some]])
            bound[i] = first_bound(x[rows[ids[rows] != asked[i]]] @ q[i], k, length[i], longest)

    out = []
    order = np.argsort(nearest_part, kind="stable")
    for begin in range(0, len(order), TOGETHER):
        at = order[begin:begin + TOGETHER]
        limit = (stop * bound[at])[:, None]
        left = np.flatnonzero((far(projected[at]) <= limit).any(axis=0))
        if not len(left):
            continue
        rows = np.concatenate([parts[c] for c in left])
        p, points = projected[at], y[rows]
        away = (p * p).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (p @ points.T)
        fits = (away <= limit + 1e-9 * longest ** 2) & (ids[rows] != asked[at][:, None])
        # The rough scores sort out what can't be among the best; the rest is summed row by
        # row, which gives equal vectors equal scores.
        rough = np.where(fits, q[at] @ x[rows].T, -np.inf)
        if len(rows) > k:
            least = np.partition(rough, -k, axis=1)[:, -k]
            fits &= rough >= (least - 1e-9 * (np.abs(least) + longest * length[at]))[:, None]
        for i, kept in zip(at, fits):
            found = rows[kept]
            score, name = (x[found] * q[i]).sum(axis=1), ids[found]
            top = np.lexsort((name, -score))[:k]
            out.append((np.full(len(top), asked[i]), name[top], score[top]))
    joined = [np.concatenate(x) for x in zip(*out)] if out else [
        np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), joined)))


# ---- the operator ---------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("vector", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))
                    & ~F.isnan(v)) & F.exists("vector", lambda v: v != 0)
    return (vectors.select("vec_id", x.alias("vector")).where("vec_id is not null")
            .where(fine).groupBy("vec_id").agg(F.min("vector").alias("vector")))


def _objects(rows: np.ndarray) -> pd.Series:
    return pd.Series(list(rows), dtype=object)


def _found(df: DataFrame, other: DataFrame, dim: int, k: int, stop: float,
           longest: float) -> DataFrame:
    """Searches the blocks of df (cell, block, ...) for the queries of other (same keys)."""
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        x = np.array(points["vector"].tolist(), np.float64).reshape(-1, dim)
        y = np.array(points["projected"].tolist(), np.float64).reshape(len(points), -1)
        return search_block(points["vec_id"].to_numpy(np.int64), x, y, queries, k, stop, longest)

    return df.groupBy("cell", "block").cogroup(other.groupBy("cell", "block")).applyInPandas(
        run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(points: DataFrame, is_query: Column, dim: int, longest: float, count: int, k: int,
            dimensions: int, confidence: float) -> DataFrame:
    matrix, stop = projection(dim, dimensions), quantile(confidence, dimensions)
    share = min(1.0, SAMPLE / count)
    picked = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
                          < int(share * (1 << 40))).toPandas()
    sample = np.array(picked["vector"].tolist(), np.float64).reshape(-1, dim)
    cells = fit_cells(lengthened(sample, longest) @ matrix, max(1, min(
        count // CELL_ROWS, len(sample) // SAMPLE_PER_CELL)))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["vector"].tolist(), np.float64).reshape(-1, dim)
            y = lengthened(x, longest) @ matrix
            yield frame.reset_index(drop=True).assign(projected=_objects(y), cell=cells.of(y))

    indexed = stored(points.mapInPandas(
        index, "vec_id long, vector array<double>, projected array<double>, cell long"),
        "neighbour_index")
    sizes = {r.cell: r["count"] for r in indexed.groupBy("cell").count().collect()}
    blocks = np.ones(len(cells.low), np.int64)
    for cell, rows in sizes.items():
        blocks[cell] = math.ceil(rows / BLOCK)
    per_cell = F.array(*[F.lit(int(b)) for b in blocks])
    dealt = indexed.withColumn("block", F.pmod(
        F.xxhash64("vec_id"), F.get(per_cell, F.col("cell"))).cast("int"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries for their own cell, if they have no bound, or else for all others that
        the test leaves."""
        for frame in frames:
            q = np.array(frame["vector"].tolist(), np.float64).reshape(-1, dim)
            p = scaled(q, longest) @ matrix
            home, bound = cells.of(p), frame["bound"].to_numpy(np.float64)
            first = frame["first"].to_numpy(bool)
            wanted = (cells.distances(p) <= stop * bound[:, None]) & ~first[:, None]
            wanted[np.arange(len(q)), home] = first
            row, cell = np.nonzero(wanted)
            copies = blocks[cell]
            row, cell = np.repeat(row, copies), np.repeat(cell, copies)
            block = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pd.DataFrame({
                "cell": cell, "block": block.astype(np.int32),
                "query_id": frame["query_id"].to_numpy()[row], "vector": _objects(q[row]),
                "projected": _objects(p[row]), "bound": bound[row]})

    schema = ("cell long, block int, query_id long, vector array<double>, "
              "projected array<double>, bound double")
    queries = indexed.where(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    at_home = queries.withColumns({"bound": F.lit(float("inf")), "first": F.lit(True)})
    home = stored(_best(_found(dealt, at_home.mapInPandas(ask, schema), dim, k, stop, longest),
                        k).select("query_id", "vec_id", "score", "rank"), "neighbours_home")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    worst = home.where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
    bound = F.greatest(F.lit(0.0), 2 * longest ** 2 - 2 * longest * F.col("worst") / length)
    bounded = queries.join(worst, "query_id", "left").select(
        "query_id", "vector", F.coalesce(bound * (1 + 1e-9) + 1e-12, F.lit(float("inf")))
        .alias("bound"), F.lit(False).alias("first"))
    away = _found(dealt, bounded.mapInPandas(ask, schema), dim, k, stop, longest)
    return _best(home.select("query_id", "vec_id", "score").unionByName(away), k)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS,
            dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest found."""
    if k < 1 or dimensions < 2 or dimensions % 2 or not 0 < confidence < 1:
        raise ValueError("k must be positive, dimensions even, confidence between 0 and 1")
    points = stored(usable(vectors), "neighbour_vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    out = None
    # One index for each dimension of vectors; a table has one, as a rule.
    for kind in points.groupBy(F.size("vector").alias("dim")).agg(
            F.max(square).alias("square"), F.count("*").alias("n")).collect():
        part = _search(points.where(F.size("vector") == kind.dim), is_query, kind.dim,
                       math.sqrt(kind.square) * (1 + 1e-12), kind.n, k, dimensions, confidence)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = points.select(F.col("vec_id").alias("query_id"), "vec_id",
                            F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """The contract's queries: every row whose vec_id is divisible by 20."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
