"""Measures of cluster quality.

Internal measures come from distances in blocks: a pair of blocks gives sums by cluster, never its pairs. External measures
come from the contingency table of two labellings. Rounding is left to the caller.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lymphspark.functions.numbers import dot, euclidean, norm
from lymphspark.operators.vectors import over_blocks

#: Contingency cells that are read at the driver for the expected information; more are refused.
MAX_CELLS = 1_000_000


def _once(vectors: DataFrame) -> DataFrame:
    """Rows of one cluster with equal vectors as one of weight ``w``, so that copies are never paired."""
    return vectors.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").cast("long").alias("w"))


def _between_copies(x: pd.DataFrame, metric: str) -> np.ndarray:
    """The distance of each row from another with its vector: 0, by cosine 1 if the vector is zero."""
    return np.array([float(metric.lower() == "cosine" and not np.any(v)) for v in x.v])


def cluster_links(vectors: DataFrame, metric: str) -> DataFrame:
    """``ci``, ``cj``, ``n``, ``sum_d``, ``min_d``, ``max_d`` over all pairs of rows of two clusters, both orders, own rows
    with themselves included."""
    def kernel(x, y, d, same):
        lx, cx = np.unique(x.label.to_numpy(), return_inverse=True)
        ly, cy = np.unique(y.label.to_numpy(), return_inverse=True)
        w = x.w.to_numpy().astype(float)
        one_x, one_y = np.eye(len(lx))[cx] * w[:, None], np.eye(len(ly))[cy] * y.w.to_numpy()[:, None]
        total = one_x.T @ d @ one_y
        n = np.outer(one_x.sum(0), one_y.sum(0))
        low, high = np.empty_like(total), np.empty_like(total)
        for i in range(len(lx)):
            part = d[cx == i]
            for j in range(len(ly)):
                cell = part[:, cy == j]
                low[i, j], high[i, j] = cell.min(), cell.max()
        if same:
            apart = _between_copies(x, metric)
            np.add.at(total, (cx, cx), w * (w - 1) * apart)
            np.maximum.at(high, (cx, cx), np.where(w > 1, apart, 0))
        i, j = (k.ravel() for k in np.meshgrid(np.arange(len(lx)), np.arange(len(ly)), indexing="ij"))
        out = pd.DataFrame({"ci": lx[i], "cj": ly[j], "n": n.ravel().astype(np.int64), "sum_d": total.ravel(), "min_d": low.ravel(), "max_d": high.ravel()})
        return out if same else pd.concat([out, out.rename(columns={"ci": "cj", "cj": "ci"})])

    kind = vectors.schema["label"].dataType.simpleString()
    found = over_blocks(_once(vectors), None, kernel, f"ci {kind}, cj {kind}, n long, sum_d double, min_d double, max_d double", metric)
    return found.groupBy("ci", "cj").agg(F.sum("n").alias("n"), F.sum("sum_d").alias("sum_d"), F.min("min_d").alias("min_d"), F.max("max_d").alias("max_d"))


def diameters(links: DataFrame) -> DataFrame:
    return links.filter("ci = cj").select(F.col("ci").alias("cluster"), F.col("max_d").alias("diam"))


def linkage(links: DataFrame) -> DataFrame:
    """``ci`` < ``cj``, ``avg_d``, ``min_d``."""
    return links.filter("ci < cj").select("ci", "cj", (F.col("sum_d") / F.col("n")).alias("avg_d"), "min_d")


def dunn(links: DataFrame, single: bool = False) -> DataFrame:
    """One row ``value``: the least linkage over the greatest diameter. A diameter of 0 gives 0; one cluster, for which there
    is no linkage, gives the greatest double over the diameter."""
    link = linkage(links).agg(F.min("min_d" if single else "avg_d").alias("link"))
    wide = diameters(links).agg(F.max("diam").alias("diam"))
    return link.crossJoin(wide).select(F.when(F.col("diam") == 0, 0.0).otherwise(F.coalesce("link", F.lit(1.7976931348623157e308)) / F.col("diam")).alias("value"))


def davies_bouldin(links: DataFrame, single: bool = False) -> DataFrame:
    """One row ``value``: the mean over clusters of the greatest (diam_i + diam_j) / link; a link of 0 gives 0. One cluster: null."""
    d = diameters(links)
    both = links.filter("ci <> cj").withColumn("link", F.col("min_d") if single else F.col("sum_d") / F.col("n"))
    joined = both.join(d.toDF("ci", "di"), "ci").join(d.toDF("cj", "dj"), "cj")
    term = F.when(F.col("link") == 0, 0.0).otherwise((F.col("di") + F.col("dj")) / F.col("link"))
    return joined.groupBy("ci").agg(F.max(term).alias("m")).agg(F.avg("m").alias("value"))


def silhouette(vectors: DataFrame, metric: str) -> DataFrame:
    """One row ``value``: the mean of (b - a) / max(a, b); single rows of a cluster have 0. Fewer than two clusters: null."""
    def kernel(x, y, d, same):
        def side(p, q, m):
            labels, code = np.unique(q.label.to_numpy(), return_inverse=True)
            one = np.eye(len(labels))[code] * q.w.to_numpy()[:, None]
            total = m @ one
            if same:
                total[np.arange(len(p)), code] += (p.w.to_numpy() - 1) * _between_copies(p, metric)
            return pd.DataFrame({"id": np.repeat(p.id.to_numpy(), len(labels)), "w": np.repeat(p.w.to_numpy(), len(labels)), "own": np.repeat(p.label.to_numpy(), len(labels)), "other": np.tile(labels, len(p)), "sum_d": total.ravel(), "n": np.tile(one.sum(0), len(p)).astype(np.int64)})

        return side(x, y, d) if same else pd.concat([side(x, y, d), side(y, x, d.T)])

    kind = vectors.schema["label"].dataType.simpleString()
    found = over_blocks(_once(vectors), None, kernel, f"id long, w long, own {kind}, other {kind}, sum_d double, n long", metric)
    per = found.groupBy("id", "w", "own", "other").agg(F.sum("sum_d").alias("s"), F.sum("n").alias("n"))
    a = F.max(F.when(F.col("own") == F.col("other"), F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1))))
    b = F.min(F.when(F.col("own") != F.col("other"), F.col("s") / F.col("n")))
    row = per.groupBy("id", "w", "own").agg(a.alias("a"), b.alias("b"))
    width = F.when(F.col("a").isNull() & F.col("b").isNotNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.when(F.col("b").isNotNull(), 0.0)))
    return row.withColumn("width", width).agg(F.try_divide(F.sum(F.col("width") * F.col("w")), F.sum(F.when(F.col("width").isNotNull(), F.col("w")))).alias("value"))


def centroids(vectors: DataFrame) -> DataFrame:
    """``label`` and ``c``, the mean vector. Sums by dimension are partial before they are shuffled."""
    per = vectors.select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    return per.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("c"))


def _distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "euclidean":
        return euclidean(a, b)
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def davies_bouldin_centroid(vectors: DataFrame, metric: str, guarded: bool = False) -> DataFrame:
    """One row ``value``: with the mean distance to the centroid as spread, and centroid distances. ``guarded``: a centroid
    distance of 0 gives 0, and so do spreads that are all 0. Clusters are few, so their pairs are made."""
    c = centroids(vectors)
    spread = vectors.join(c, "label").groupBy("label").agg(F.avg(_distance(F.col("v"), F.col("c"), metric)).alias("s"))
    own = c.join(spread, "label")
    two = own.toDF("li", "ci", "si").crossJoin(own.toDF("lj", "cj", "sj")).filter("li <> lj")
    d = _distance(F.col("ci"), F.col("cj"), metric)
    term = F.try_divide(F.col("si") + F.col("sj"), d)
    if guarded:
        term = F.coalesce(term, F.lit(0.0))
    return two.groupBy("li").agg(F.max(term).alias("m")).agg(F.avg("m").alias("value"))


# external measures


def contingency(df: DataFrame, true: Column, pred: Column) -> DataFrame:
    return df.select(true.alias("t"), pred.alias("p")).groupBy("t", "p").agg(F.count("*").alias("cnt"))


def confusion_matrix(df: DataFrame, true: Column, pred: Column) -> DataFrame:
    """``t``, ``p``, ``cnt`` over all labels that either has, with zeros."""
    cells = contingency(df, true, pred)
    labels = cells.select(F.col("t").alias("l")).unionByName(cells.select(F.col("p").alias("l"))).distinct()
    square = labels.select(F.col("l").alias("t")).crossJoin(labels.select(F.col("l").alias("p")))
    return square.join(cells, ["t", "p"], "left").fillna(0, ["cnt"])


def entropies(cells: DataFrame) -> DataFrame:
    """One row: mutual information ``mi`` and the entropies ``ht`` and ``hp``, natural logarithms."""
    by = lambda c: F.sum("cnt").over(Window.partitionBy(c))
    total = F.broadcast(cells.agg(F.sum("cnt").alias("n")))
    w = cells.withColumn("nt", by("t")).withColumn("np", by("p")).crossJoin(total)
    x, n = F.col("cnt"), F.col("n")
    return w.agg(
        F.sum(x / n * F.log(x * n / (F.col("nt") * F.col("np")))).alias("mi"),
        F.sum(-x / n * F.log(F.col("nt") / n)).alias("ht"),
        F.sum(-x / n * F.log(F.col("np") / n)).alias("hp"),
        F.count_distinct("t").alias("kt"), F.count_distinct("p").alias("kp"),
    )


def nmi(cells: DataFrame, average: str) -> DataFrame:
    """One row ``value``: mutual information over the arithmetic or geometric mean or the maximum of the entropies. Two
    labellings of one cluster each give 1; no information gives 0."""
    mean = {"arithmetic": (F.col("ht") + F.col("hp")) / 2, "geometric": F.sqrt(F.col("ht") * F.col("hp")), "max": F.greatest("ht", "hp")}[average]
    value = F.when((F.col("kt") <= 1) & (F.col("kp") <= 1), 1.0).when(F.abs("mi") < 1e-15, 0.0).otherwise(F.coalesce(F.try_divide(F.col("mi"), mean), F.lit(0.0)))
    return entropies(cells).select(value.alias("value"))


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """ln(x!) by Stirling's series, eight steps further on."""
    x = np.asarray(x, float)
    y = x + 9
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + k) for k in range(1, 9))


def ami(cells: DataFrame) -> float:
    """Adjusted mutual information: the expectation under the hypergeometric model is summed at the driver, from the margins."""
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"the contingency table has over {MAX_CELLS} cells")
    t, p = {}, {}
    for r in rows:
        t[r.t] = t.get(r.t, 0) + r.cnt
        p[r.p] = p.get(r.p, 0) + r.cnt
    n = sum(t.values())
    if len(t) <= 1 and len(p) <= 1:
        return 1.0
    mi = sum(r.cnt / n * log(r.cnt * n / (t[r.t] * p[r.p])) for r in rows)
    expected = 0.0
    margins = [np.unique(np.array(list(m.values()), float), return_counts=True) for m in (t, p)]
    for a, times_a in zip(*margins[0]):
        for b, times_b in zip(*margins[1]):
            k = np.arange(max(1, a + b - n), min(a, b) + 1)
            chance = np.exp(_log_factorial(np.array([a, b, n - a, n - b, n])) @ [1, 1, 1, 1, -1] - _log_factorial(k) - _log_factorial(a - k) - _log_factorial(b - k) - _log_factorial(n - a - b + k))
            expected += times_a * times_b * float((k / n * np.log(n * k / (a * b)) * chance).sum())
    entropy = lambda m: -sum(x / n * log(x / n) for x in m.values())
    bottom = (entropy(t) + entropy(p)) / 2 - expected
    bottom = min(bottom, -2.2e-16) if bottom < 0 else max(bottom, 2.2e-16)
    return float((mi - expected) / bottom)


def map_predictions(df: DataFrame, vector: Column, true: Column, pred: Column) -> DataFrame:
    """``pred`` and ``mapped``: the true label that most rows have whose vector equals that of a member of the cluster.

    Every pair of a row and a member with equal vectors is one vote, ties go to the smaller label. The votes are products of
    two counts per vector, so that copies are never paired.
    """
    rows = df.select(vector.alias("v"), true.alias("t"), pred.alias("pred"))
    truths = rows.groupBy("v", "t").agg(F.count("*").alias("nt"))
    members = rows.groupBy("v", "pred").agg(F.count("*").alias("np"))
    votes = members.join(truths, "v").groupBy("pred", "t").agg(F.sum(F.col("nt") * F.col("np")).alias("votes"))
    best = F.row_number().over(Window.partitionBy("pred").orderBy(F.desc("votes"), "t"))
    return votes.withColumn("r", best).filter("r = 1").select("pred", F.col("t").alias("mapped"))


def accuracy(df: DataFrame, vector: Column, true: Column, pred: Column) -> DataFrame:
    """One row ``value``: the share of rows whose mapped prediction is their true label."""
    mapping = map_predictions(df, vector, true, pred)
    joined = df.select(true.alias("t"), pred.alias("pred")).join(mapping, "pred", "left")
    return joined.agg(F.avg(F.coalesce((F.col("mapped") == F.col("t")).cast("int"), F.lit(0))).alias("value"))
