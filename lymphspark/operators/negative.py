"""Negative selection: detectors that match no row of class 1, made by crossing rows of both classes with noise.

A row that a detector matches is of class 0, all others of class 1. A match is a cosine similarity, rounded half-even to two
digits, above the threshold.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphspark.functions.numbers import hash_normal, hash_uniform
from lymphspark.operators.vectors import over_blocks

#: A batch of candidates has up to so many times the detectors wanted; after so many batches without a detector fitting fails.
GROWTH, BARREN = 64, 100
#: Rows are ordered by seeded keys within so many ranges of these.
RANGES = 4096


@dataclass(frozen=True)
class NegativeParams:
    number_of_detectors: int = 100
    fit_threshold: float = 0.85
    predict_threshold: float = 0.0
    crossover_points: float = 0.15
    seed: int = 777

    def __post_init__(self):
        if not 0 < self.fit_threshold <= 1 or not 0 <= self.predict_threshold <= 1 or self.crossover_points <= 0:
            raise ValueError("thresholds lie in (0, 1]; crossover points are positive")

    def cuts(self, dims: int) -> int:
        return max(1, floor(self.crossover_points * dims) if self.crossover_points <= 1 else int(self.crossover_points))


def _parents(vectors: DataFrame, label: int, each: DataFrame, kind: str, seed: int) -> DataFrame:
    """``id`` of ``each`` with ``v``, the row of a class at a seeded place of all its rows, ordered by seeded keys and id."""
    u = hash_uniform(seed, F.lit("pool"), "id")
    keyed = vectors.filter(F.col("label") == label).select(F.col("id").alias("row"), "v", u.alias("u"), F.floor(u * RANGES).alias("range"))
    counts = keyed.groupBy("range").agg(F.count("*").alias("n"))
    # One row per range.
    ends = counts.select("range", "n", F.sum("n").over(Window.orderBy("range")).alias("end"), F.sum("n").over(Window.partitionBy()).alias("total"))
    drawn = each.select("id", hash_uniform(seed, F.lit(kind), "id").alias("x")).join(F.broadcast(ends), F.floor(F.col("x") * F.col("total")).between(F.col("end") - F.col("n"), F.col("end") - 1))
    drawn = drawn.select("id", "range", (F.floor(F.col("x") * F.col("total")) - F.col("end") + F.col("n")).alias("at"))
    near = keyed.join(drawn.select("range").distinct(), "range", "left_semi")
    ranked = near.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("u", "row")) - 1)
    return drawn.join(ranked, ["range", "at"]).select("id", F.col("v").alias(f"v{kind}"))


def candidates(vectors: DataFrame, first: int, count: int, dims: int, p: NegativeParams) -> DataFrame:
    """``id``, ``v`` of candidates first .. first + count - 1: segments of two noisy parents in turn, cut at seeded points.

    ``vectors`` has ``id``, ``v`` and ``label`` 0 or 1.
    """
    spark: SparkSession = vectors.sparkSession
    each = spark.range(first, first + count)
    spots = each.select("id", F.explode(F.sequence(F.lit(1), F.lit(dims))).alias("cut")).withColumn("u", hash_uniform(p.seed, F.lit("cut"), "id", "cut"))
    chosen = spots.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("u", "cut"))).filter(F.col("r") <= p.cuts(dims))
    cuts = chosen.groupBy("id").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    both = each.join(cuts, "id").join(_parents(vectors, 0, each, "a", p.seed), "id").join(_parents(vectors, 1, each, "b", p.seed), "id")
    noisy = lambda k: F.transform(F.col(f"v{k}"), lambda x, i: x + hash_normal(p.seed, F.lit(k), F.col("id"), i))
    zipped = F.arrays_zip(noisy("a").alias("a"), noisy("b").alias("b"))
    crossed = F.transform(zipped, lambda z, i: F.when(F.size(F.filter("cuts", lambda c: c <= i)) % 2 == 0, z["a"]).otherwise(z["b"]))
    return both.select("id", crossed.alias("v"))


def matched(rows: DataFrame, detectors: DataFrame, threshold: float) -> DataFrame:
    """Ids of the rows that some detector matches. Blocks of rows meet blocks of detectors; only the matched ids come out."""
    def kernel(x, y, d, same):
        near = (np.rint((1 - d) * 100) / 100 > threshold).any(1)
        return pd.DataFrame({"id": x.id.to_numpy()[near]})

    return over_blocks(rows, detectors, kernel, "id long", "cosine").distinct()


def filter_detectors(found: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """The candidates that match no row of class 1."""
    return found.join(matched(found, own, threshold), "id", "left_anti")


class NegativeSelection:
    def __init__(self, p: NegativeParams = NegativeParams()):
        self.p, self.detectors = p, None

    def fit(self, vectors: DataFrame, most_batches: int | None = None) -> NegativeSelection:
        """Candidates come in batches until there are detectors enough; the first by number are kept, whatever the batches.

        Fewer than wanted are an error: with ``most_batches``, if given, or after BARREN batches in a row without any.
        """
        p, own = self.p, vectors.filter("label = 1").select("id", "v")
        head = vectors.select(F.size("v").alias("f")).head()
        if head is None:
            raise ValueError("there are no rows to fit on")
        if p.number_of_detectors and len({r.label for r in vectors.filter("label in (0, 1)").select("label").distinct().collect()}) < 2:
            raise ValueError("both classes need rows")
        kept: list[pd.DataFrame] = []
        first = batches = barren = 0
        while True:
            count = p.number_of_detectors * min(1 << batches, GROWTH)
            kept.append(filter_detectors(candidates(vectors, first, count, head.f, p), own, p.fit_threshold).toPandas())
            first, batches, barren = first + count, batches + 1, 0 if len(kept[-1]) else barren + 1
            found = sum(map(len, kept))
            if found >= p.number_of_detectors:
                break
            if batches == most_batches or barren == BARREN:
                raise RuntimeError(f"{found} of {p.number_of_detectors} detectors after {first} candidates")
        rows = pd.concat(kept).sort_values("id").head(p.number_of_detectors)
        self.detectors = vectors.sparkSession.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(rows.id, rows.v)], "id long, v array<double>")
        return self

    def save(self, folder: str) -> None:
        """The detectors and parameters as a folder of tables."""
        self.detectors.write.mode("overwrite").parquet(f"{folder}/detectors")
        text = json.dumps(asdict(self.p))
        self.detectors.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/params")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> NegativeSelection:
        model = cls(NegativeParams(**json.loads(spark.read.text(f"{folder}/params").head()[0])))
        model.detectors = spark.read.parquet(f"{folder}/detectors")
        return model

    def predict(self, vectors: DataFrame) -> DataFrame:
        """``id``, ``pred``: 0 if a detector matches, else 1."""
        threshold = self.p.predict_threshold or self.p.fit_threshold
        hit = matched(vectors.select("id", "v"), self.detectors, threshold).withColumn("hit", F.lit(0).cast("long"))
        return vectors.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(1).cast("long")).alias("pred"))
