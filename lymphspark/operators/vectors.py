"""Distances between all rows of two vector sets, in blocks.

Rows are cut into blocks of bounded size; each pair of blocks is one task, which computes its distances with one matrix
product and gives only what is asked for (nearest rows, sums by cluster, ...), so that no pair is written unless pairs are
the result. ``vectors`` frames have ``id`` (long), ``v`` (array of double) and, where a kernel needs it, ``label``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lymphspark.session import ship_package

#: Rows of a block.
BLOCK = 2048
#: Targets, and numbers in them, that are broadcast at most.
SMALL, SMALL_VALUES = 4096, 2_000_000
METRICS = ("euclidean", "cosine")


def distances(a: np.ndarray, b: np.ndarray, metric: str, same: bool = False) -> np.ndarray:
    """Distances of all rows of a to all of b. Cosine of a zero vector is 1; the diagonal is 0 only if ``same``.

    Empty input gives an empty matrix; a single vector counts as one row.
    """
    metric = metric.lower()
    if metric not in METRICS:
        raise ValueError(f"unknown distance {metric}")
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    if not a.size or not b.size:
        return np.zeros((len(a) if a.size else 0, len(b) if b.size else 0))
    if metric == "euclidean":
        out = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))
    else:
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        out = np.ones_like(norms)
        np.divide(a @ b.T, norms, out=out, where=norms > 0)
        out = np.where(norms > 0, 1 - out, 1.0)
    if same:
        np.fill_diagonal(out, 0.0)
    return out



def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 0))


def over_blocks(a: DataFrame, b: DataFrame | None, kernel: Callable, schema: str, metric: str, digits: int | None = 9, block: int = BLOCK) -> DataFrame:
    """Runs ``kernel(rows of a, rows of b, distances, same)`` over every pair of blocks. Without b, a is held against itself:
    each pair of different blocks comes once (``same`` false) and each block with itself (``same`` true, diagonal 0).

    Distances are rounded to ``digits``, so that ties are the same however they were computed.
    """
    ship_package(a.sparkSession)
    alone = b is None
    n_a = max(1, ceil(a.count() / block))
    n_b = n_a if alone else max(1, ceil(b.count() / block))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n).cast("long"))
    span = lambda lo, hi: F.explode(F.sequence(lo, hi))
    zero = F.lit(0).cast("long")
    left = a.withColumn("i", own(n_a)).withColumn("side", F.lit(0))
    left = left.withColumn("j", span(F.col("i") if alone else zero, F.lit(n_b - 1).cast("long")))
    right = (a if alone else b).withColumn("j", own(n_b)).withColumn("side", F.lit(1))
    right = right.withColumn("i", span(zero, F.col("j") if alone else F.lit(n_a - 1).cast("long")))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (rows[rows.side == k].sort_values("id", ignore_index=True) for k in (0, 1))
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in names})
        same = bool(alone and x.i.iloc[0] == x.j.iloc[0])
        d = distances(_stack(x.v), _stack(y.v), metric, same)
        return kernel(x, y, d if digits is None else np.round(d, digits), same)

    return left.unionByName(right, allowMissingColumns=True).groupBy("i", "j").applyInPandas(run, schema)


def pairs(vectors: DataFrame, metric: str) -> DataFrame:
    """``i``, ``j`` (i < j), ``d`` of all pairs: for when the pairs themselves are the result."""
    def kernel(x, y, d, same):
        r, c = np.nonzero(np.triu(np.ones_like(d), 1)) if same else np.nonzero(np.ones_like(d))
        p, q = x.id.to_numpy()[r], y.id.to_numpy()[c]
        return pd.DataFrame({"i": np.minimum(p, q), "j": np.maximum(p, q), "d": d[r, c]})

    return over_blocks(vectors, None, kernel, "i long, j long, d double", metric, digits=None)


def nearest(queries: DataFrame, targets: DataFrame, metric: str, n: int) -> DataFrame:
    """``id``, ``rk`` (from 1), ``target``, ``d``: the n nearest targets of every query, ties to the lower target.

    Up to SMALL targets are sent to where the queries are. Of more, each pair of blocks gives at most n candidates per query.
    """
    few = targets.select("id", "v").limit(SMALL + 1).toPandas()
    if len(few) <= SMALL and sum(map(len, few.v)) <= SMALL_VALUES:
        return _nearest_of_few(queries, few.sort_values("id", ignore_index=True), metric, n)

    def kernel(x, y, d, same):
        k = min(n, d.shape[1])
        order = np.lexsort((np.broadcast_to(y.id.to_numpy(), d.shape), d), axis=1)[:, :k]
        return pd.DataFrame({"id": np.repeat(x.id.to_numpy(), k), "target": y.id.to_numpy()[order].ravel(), "d": np.take_along_axis(d, order, 1).ravel()})

    found = over_blocks(queries, targets, kernel, "id long, target long, d double", metric)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "target"))
    return found.withColumn("rk", rank).filter(F.col("rk") <= n).select("id", F.col("rk").cast("long").alias("rk"), "target", "d")


def _nearest_of_few(queries: DataFrame, few: pd.DataFrame, metric: str, n: int) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast((few.id.to_numpy(), _stack(few.v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = shared.value
        for whole in batches if len(ids) else ():
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                own = np.stack([np.asarray(v) for v in batch.column(1).to_pylist()]).astype(np.float64)
                d = np.round(distances(own, known, metric), 9)
                k = min(n, d.shape[1])
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(d)), k))), pa.array(np.tile(np.arange(1, k + 1), len(d))), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], names=["id", "rk", "target", "d"])

    return queries.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, rk long, target long, d double")


def suppress(vectors: DataFrame, metric: str, threshold: float) -> DataFrame:
    """The rows that survive suppression: those without a later row (by id) nearer than the threshold.

    Every later row counts, also one that is itself suppressed; of a chain only the last survives.
    """
    def kernel(x, y, d, same):
        near = d < threshold
        p, q = x.id.to_numpy(), y.id.to_numpy()
        gone = p[(near & (p[:, None] < q[None, :])).any(1)]
        other = np.zeros(0, np.int64) if same else q[(near & (p[:, None] > q[None, :])).any(0)]
        return pd.DataFrame({"id": np.concatenate([gone, other])})

    gone = over_blocks(vectors, None, kernel, "id long", metric).distinct()
    return vectors.join(gone, "id", "left_anti")
