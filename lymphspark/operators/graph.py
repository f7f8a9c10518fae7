"""Minimum spanning forests, their pruning, and component numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lymphspark.operators.vectors import distances, over_blocks
from lymphspark.session import Stage

#: Nodes of a spanning forest: labels and tree edges of so many fit the driver; the pairs never come there.
MAX_NODES = 200_000
PRUNING = ("threshold", "average")


def spanning_forest(vectors: DataFrame, metric: str, block: int = 2048) -> DataFrame:
    """``u`` < ``v``, ``w``: the minimum spanning forest over all pairs at a distance above 0, ties by (w, u, v).

    In each round every tree takes its shortest link to another tree; distances are computed in blocks, of which only each
    tree's best link is given. Coincident rows are not linked with each other, but may be through others.
    """
    spark = vectors.sparkSession
    ids = [r.id for r in vectors.select("id").limit(MAX_NODES + 1).collect()]
    if len(ids) > MAX_NODES:
        raise ValueError(f"over {MAX_NODES} nodes")
    tree = {i: i for i in ids}
    edges: dict[tuple[int, int], float] = {}

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    def kernel(x, y, d, same):
        out = []
        for p, q, m in ((x, y, d), (y, x, d.T)):
            far = np.where((p.tree.to_numpy()[:, None] == q.tree.to_numpy()[None, :]) | (m <= 0), np.inf, m)
            low, high = np.minimum.outer(p.id.to_numpy(), q.id.to_numpy()), np.maximum.outer(p.id.to_numpy(), q.id.to_numpy())
            # The least (w, u, v) of each row without sorting it.
            w = far.min(axis=1)
            u = np.where(far == w[:, None], low, np.iinfo(np.int64).max).min(axis=1)
            v = np.where((far == w[:, None]) & (low == u[:, None]), high, np.iinfo(np.int64).max).min(axis=1)
            out.append(pd.DataFrame({"tree": p.tree.to_numpy(), "w": w, "u": u, "v": v}))
        rows = pd.concat(out)
        return rows[np.isfinite(rows.w)].sort_values(["w", "u", "v"]).groupby("tree", as_index=False).first()[["tree", "w", "u", "v"]]

    while len(ids) > 1:
        labels = spark.createDataFrame(pd.DataFrame({"id": ids, "tree": [root(i) for i in ids]}))
        found = over_blocks(vectors.select("id", "v").join(labels, "id"), None, kernel, "tree long, w double, u long, v long", metric, block=block)
        best = found.groupBy("tree").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("e.*").collect()
        grown = False
        for e in sorted(best, key=lambda e: (e.w, e.u, e.v)):
            a, b = root(e.u), root(e.v)
            if a != b:
                tree[max(a, b)] = min(a, b)
                edges[e.u, e.v] = e.w
                grown = True
        if not grown:
            break
    return spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u long, v long, w double")


def prune(edges: DataFrame, kind: str, threshold: float = 0.105, k: float = 0.0, least: int = 1) -> DataFrame:
    """The edges that are cut, all decided on the whole tree.

    W_u are the weights of the other edges at u. Edges with fewer than ``least`` others at either end stay, so leaves do.
    ``average``: w above mean + k * deviation (of the population) of the others at both ends. ``threshold``: the mean of the
    others above the threshold at both ends, whatever w is.
    """
    if kind not in PRUNING:
        raise ValueError(f"unknown pruning {kind}")
    ends = edges.select(F.col("u").alias("node"), "u", "v", "w").unionByName(edges.select(F.col("v").alias("node"), "u", "v", "w"))
    # Sums over a node less the edge's own part: no edge is paired with another.
    at = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    joined = edges.join(at.toDF("u", "nu", "su", "qu"), "u").join(at.toDF("v", "nv", "sv", "qv"), "v")

    def others(side: str):
        n = F.col(f"n{side}") - 1
        mean = F.try_divide(F.col(f"s{side}") - F.col("w"), n)
        square = F.try_divide(F.col(f"q{side}") - F.col("w") * F.col("w"), n)
        return n, mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))

    (n1, m1, d1), (n2, m2, d2) = others("u"), others("v")
    enough = (n1 >= max(least, 1)) & (n2 >= max(least, 1))
    if kind == "average":
        return joined.filter(enough & (F.col("w") > m1 + F.lit(k) * d1) & (F.col("w") > m2 + F.lit(k) * d2)).select("u", "v", "w")
    return joined.filter(enough & (m1 > threshold) & (m2 > threshold)).select("u", "v", "w")


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the least node of the component), by spreading least labels and jumping pointers."""
    stage = Stage(nodes.sparkSession, "components")
    both = stage.write(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = stage.write(nodes.select("node", F.col("node").alias("root")), "labels")
    for _ in range(most_rounds):
        seen = both.join(label.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        low = label.join(seen.withColumnRenamed("u", "node"), "node", "left").select("node", "root", F.least("root", "r").alias("low"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = stage.write(low.join(jump, "low").select("node", F.col("root").alias("old"), F.least("low", "next").alias("root")), "labels")
        stage.drop(label)
        label = new
        if not label.filter("old <> root").take(1):
            return label.select("node", "root")
    raise RuntimeError("the components did not settle")


def component_labels(nodes: DataFrame, edges: DataFrame, distinct_singletons: bool = False) -> DataFrame:
    """``node``, ``label``: the number of components of several nodes whose least node is below that of the own component.

    So a single node shares the number of the next component of several. ``distinct_singletons`` counts every component.
    """
    roots = components(nodes, edges)
    size = roots.groupBy("root").agg(F.count("*").alias("n"))
    counted = F.when(F.col("n") > 1, 1).otherwise(1 if distinct_singletons else 0)
    before = Window.orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    # One row per component; the numbering is over components, not over nodes.
    numbered = size.select("root", F.coalesce(F.sum(counted).over(before), F.lit(0)).cast("long").alias("label"))
    return roots.join(numbered, "root").select("node", "label")


#: Rows whose full distance matrix the driver holds for agglomeration.
MAX_AGGLOMERATED = 5_000


def agglomerate(vectors: DataFrame, metric: str, threshold: float, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Average-linkage clusters, merged while the nearest two are below the threshold; only along ``links`` (u, v) if given.

    Returns ``id``, ``cluster`` (the least id in it) and the merges: ``step``, ``a``, ``b``, ``d``, ``size``. Ties go to the
    lower ids. The method needs all distances at once, so more than MAX_AGGLOMERATED rows are refused.
    """
    rows = vectors.select("id", "v").limit(MAX_AGGLOMERATED + 1).toPandas().sort_values("id")
    if len(rows) > MAX_AGGLOMERATED:
        raise ValueError(f"over {MAX_AGGLOMERATED} rows")
    spark, ids = vectors.sparkSession, rows.id.to_numpy()
    n = len(ids)
    if not n:
        return spark.createDataFrame([], "id long, cluster long"), spark.createDataFrame([], "step long, a long, b long, d double, size long")
    stacked = np.stack(rows.v.to_numpy())
    mean = np.round(distances(stacked, stacked, metric, same=True), 9)
    joined = np.ones((n, n), bool)
    if links is not None:
        place = {int(i): k for k, i in enumerate(ids)}
        joined[:] = False
        for e in links.select("u", "v").collect():
            joined[place[e.u], place[e.v]] = joined[place[e.v], place[e.u]] = True
    np.fill_diagonal(joined, False)
    size, own, merges = np.ones(n), np.arange(n), []
    while True:
        open_ = np.where(np.triu(joined, 1), mean, np.inf)
        k = int(open_.argmin())
        a, b = divmod(k, n)
        if not open_[a, b] < threshold:
            break
        merges.append((len(merges), int(ids[a]), int(ids[b]), float(open_[a, b]), int(size[a] + size[b])))
        mean[a] = mean[:, a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        joined[a] |= joined[b]
        joined[:, a] = joined[a]
        joined[b] = joined[:, b] = False
        joined[a, a] = False
        own[own == b] = a
    clusters = spark.createDataFrame([(int(i), int(ids[c])) for i, c in zip(ids, own)], "id long, cluster long")
    return clusters, spark.createDataFrame(merges, "step long, a long, b long, d double, size long")
