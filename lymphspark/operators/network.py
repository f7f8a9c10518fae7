"""The immune network: antibodies are cloned, mutated towards antigens, selected and suppressed until they stand for the data.

The single steps are relational and reproducible in any engine, as their random numbers are hashes of keys. ``ImmuneNetwork``
runs the whole loop with the steps of one antigen as one array kernel, in one stage per iteration.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphspark.functions.numbers import euclidean, hash_uniform, norm, round_half_even
from lymphspark.functions.numbers import dot as _dot
from lymphspark.operators import graph
from lymphspark.operators.vectors import distances, nearest, pairs, suppress
from lymphspark.session import Stage

#: Antibodies that are broadcast to every task; more mean that the suppression threshold is too small for the data.
MAX_ANTIBODIES = 50_000
#: Antigens are ordered by seeded numbers within so many ranges of these.
RANGES = 4096


def _distance(a, b, metric: str):
    if metric == "euclidean":
        return F.round(euclidean(a, b), 9)
    return F.round(F.lit(1.0) - F.coalesce(F.try_divide(_dot(a, b), norm(a) * norm(b)), F.lit(0.0)), 9)


def random_antibodies(spark: SparkSession, count: int, dims: int, seed: int, iteration: int) -> DataFrame:
    """``id``, ``v``: vectors of uniform numbers in [0, 1), from keys."""
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: hash_uniform(seed, iteration, F.col("id"), k))
    return spark.range(count).select("id", v.alias("v"))


# The steps, one by one


def clone_counts(antigens: DataFrame, antibodies: DataFrame, metric: str, n: int, multiplier: float) -> DataFrame:
    """``ag``, ``ab``, ``d``, ``clones`` of the n antibodies nearest to each antigen: m - d * m, half-even, at least 0."""
    near = nearest(antigens, antibodies, metric, n)
    count = F.greatest(round_half_even(F.lit(multiplier) - F.col("d") * F.lit(multiplier)), F.lit(0.0)).cast("long")
    return near.select(F.col("id").alias("ag"), F.col("target").alias("ab"), "d", count.alias("clones"))


def positions(antigens: DataFrame, seed: int, iteration: int) -> DataFrame:
    """Adds ``pos``, from 0, in a seeded order of all antigens: a place within its range, after those of the ranges before."""
    u = hash_uniform(seed, iteration, "id")
    keyed = antigens.withColumn("_u", u).withColumn("_range", F.floor(u * RANGES))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row per range.
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_u", "id")) - 1
    return keyed.withColumn("_at", place).join(F.broadcast(before), "_range").withColumn("pos", F.col("_at") + F.col("_before")).drop("_u", "_range", "_at", "_before")


def rates(antigens: DataFrame, seed: int, iteration: int, rate: float, decay: float = 0.9) -> DataFrame:
    """``id``, ``rate``: the rate falls by ``decay`` with each position of a seeded order."""
    return positions(antigens.select("id"), seed, iteration).select("id", (F.lit(rate) * F.pow(F.lit(decay), F.col("pos"))).alias("rate"))


def mutate(counts: DataFrame, antigens: DataFrame, antibodies: DataFrame, rate: DataFrame, metric: str, seed: int, iteration: int) -> DataFrame:
    """``ag``, ``ab``, ``clone``, ``v``, ``d``: clones moved towards their antigen by u * d * rate per element, u from keys."""
    clones = counts.filter("clones > 0").withColumn("clone", F.explode(F.sequence(F.lit(1).cast("long"), "clones")))
    with_v = clones.join(antibodies.select(F.col("id").alias("ab"), F.col("v").alias("b")), "ab").join(antigens.select(F.col("id").alias("ag"), F.col("v").alias("a")), "ag")
    with_v = with_v.join(rate.select(F.col("id").alias("ag"), "rate"), "ag", "left").fillna(0.0, ["rate"])
    prefix = F.concat_ws("|", F.lit(f"{seed}|{iteration}"), "ag", "ab", "clone")
    moved = F.transform(F.arrays_zip("a", "b", F.sequence(F.lit(0), F.size("a") - 1).alias("k")), lambda z: z["b"] + hash_uniform(prefix, z["k"]) * F.col("d") * F.col("rate") * (z["a"] - z["b"]))
    return with_v.withColumn("v", moved).select("ag", "ab", "clone", "v", _distance(F.col("v"), F.col("a"), metric).alias("d"))


def reselect(clones: DataFrame, share: float) -> DataFrame:
    """The nearest ceil(share * n) clones of each antigen, with their rank ``rk``."""
    per = Window.partitionBy("ag")
    ranked = clones.withColumn("rk", F.row_number().over(per.orderBy("d", "ab", "clone")).cast("long")).withColumn("n", F.count("*").over(per))
    return ranked.filter(F.col("rk") <= F.ceil(F.lit(share) * F.col("n"))).drop("n")


def prune(memory: DataFrame, threshold: float) -> DataFrame:
    return memory.filter(F.col("d") <= threshold)


def suppress_within(memory: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Per antigen, the clones without a later one (by rank) nearer than the threshold."""
    later = memory.select(F.col("ag").alias("g"), F.col("rk").alias("r"), F.col("v").alias("o"))
    gone = (F.col("ag") == F.col("g")) & (F.col("rk") < F.col("r")) & (_distance(F.col("v"), F.col("o"), metric) < threshold)
    return memory.join(later, gone, "left_anti")


def iteration_stats(memory: DataFrame) -> DataFrame:
    """``antigens`` with memory, ``memory`` rows and ``avg_best``, the mean of each antigen's nearest clone (0 if none)."""
    best = memory.groupBy("ag").agg(F.min("d").alias("best"), F.count("*").alias("n"))
    return best.agg(F.count("*").alias("antigens"), F.coalesce(F.sum("n"), F.lit(0)).alias("memory"), F.coalesce(F.avg("best"), F.lit(0.0)).alias("avg_best"))


# The whole network


@dataclass(frozen=True)
class FitParams:
    number_of_antibodies: int
    no_best_cells_taken_each_selection: int
    clone_multiplier: float
    pruning_threshold: float
    percent_clones_reselected: float
    suppression_threshold: float = 0.001
    hypermutation_rate: float = 4.0
    max_iter: int = 100
    stop_threshold: float = 0.01
    decay: float = 0.9
    record_antibody_history: bool = False

    def __post_init__(self):
        if self.number_of_antibodies < 1 or self.no_best_cells_taken_each_selection < 1 or self.clone_multiplier <= 0:
            raise ValueError("antibodies, cells taken and the multiplier must be positive")
        if not 0 < self.percent_clones_reselected <= 1:
            raise ValueError("percent_clones_reselected lies in (0, 1]")


@dataclass(frozen=True)
class PredictParams:
    mst_pruning_threshold: float = 0.105
    mst_pruning_type: str = "threshold"
    k: float = 0.0
    minimum_no_edges: int = 1


def mature(antigen: np.ndarray, rate: float, population: np.ndarray, p: FitParams, metric: str, random: np.random.Generator, d: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Memory clones of one antigen, nearest first, and the best distance before suppression (-1 if none is left). ``d``, if
    known, are its rounded distances from the population."""
    d = np.round(distances(antigen, population, metric)[0], 9) if d is None else d
    n = min(p.no_best_cells_taken_each_selection, len(d))
    # The n nearest, ties to the lower: those below the n-th distance, then the first at it.
    bound = np.partition(d, n - 1)[n - 1]
    near = np.concatenate([np.flatnonzero(d < bound), np.flatnonzero(d == bound)])[:n]
    near = near[np.argsort(d[near], kind="stable")]
    count = np.maximum(np.rint(p.clone_multiplier - d[near] * p.clone_multiplier), 0).astype(int)
    clones, parent_d = np.repeat(population[near], count, axis=0), np.repeat(d[near], count)
    if not len(clones):
        return clones, -1.0
    if rate:
        clones = clones + random.random(clones.shape) * (parent_d * rate)[:, None] * (antigen - clones)
    d = np.round(distances(antigen, clones, metric)[0], 9)
    chosen = np.argsort(d, kind="stable")[: int(np.ceil(p.percent_clones_reselected * len(clones)))]
    chosen = chosen[d[chosen] <= p.pruning_threshold]
    if not len(chosen):
        return clones[:0], -1.0
    best, memory = float(d[chosen].min()), clones[chosen]
    apart = np.round(distances(memory, memory, metric, same=True), 9)
    return memory[~(np.triu(apart < p.suppression_threshold, 1)).any(1)], best


@dataclass
class ImmuneNetwork:
    """``fit`` on vectors (``id``, ``v``) in [0, 1.1], then ``predict``. The result is the same on any partitioning."""

    spark: SparkSession
    seed: int = 777
    distance_method: str = "euclidean"
    population: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    history: list[tuple[int, int, float]] = field(default_factory=list)
    #: The antibodies after each iteration, if the parameters ask for them.
    antibody_history: list[np.ndarray] = field(default_factory=list)
    edges_deleted: DataFrame | None = None
    params: FitParams | None = None

    def __post_init__(self):
        self.distance_method = self.distance_method.lower()
        if self.distance_method not in ("euclidean", "cosine"):
            raise ValueError(f"unknown distance {self.distance_method}")

    def fit(self, vectors: DataFrame, p: FitParams) -> ImmuneNetwork:
        self.params, self.history, self.antibody_history = p, [], []
        stage = Stage(self.spark, "network")
        range_ = vectors.agg(F.count("*").alias("n"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"), F.min(F.size("v")).alias("f"), F.max(F.size("v")).alias("g")).head()
        if not range_.n:
            return self
        if range_.lo < 0 or range_.hi > 1.1 or range_.f != range_.g:
            raise ValueError("vectors must have one length and values in [0, 1.1]")
        memory, rate, average = np.zeros((0, range_.f)), p.hypermutation_rate, 1.0
        for iteration in range(1, p.max_iter + 1):
            if average <= p.stop_threshold:
                break
            fresh = np.random.Generator(np.random.Philox(key=[self.seed, iteration])).random((p.number_of_antibodies, range_.f))
            memory, average = self._iterate(vectors, np.concatenate([memory, fresh]), rate, iteration, stage)
            rate *= p.decay ** float(range_.n)
            self.history.append((iteration, len(memory), average))
            if p.record_antibody_history:
                self.antibody_history.append(memory)
        self.population = memory
        return self

    def _iterate(self, vectors: DataFrame, population: np.ndarray, rate: float, iteration: int, stage: Stage) -> tuple[np.ndarray, float]:
        p, metric, seed = self.params, self.distance_method, self.seed
        shared = self.spark.sparkContext.broadcast(population)
        u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{iteration}"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint")
        placed = positions(vectors.select("id", "v"), seed, iteration).select("id", "v", u.alias("u"), (F.lit(rate) * F.pow(F.lit(p.decay), F.col("pos"))).alias("rate"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            antibodies = shared.value
            for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
                ag, order, best, rows = [], [], [], []
                ids, _, at_, rate_ = (c.to_pylist() for c in batch.columns)
                antigens = pc.list_flatten(batch.column(1)).to_numpy().reshape(len(ids), -1)
                for i, v, at, r, d in zip(ids, antigens, at_, rate_, np.round(distances(antigens, antibodies, metric), 9)):
                    random = np.random.Generator(np.random.Philox(key=[seed, (iteration << 40) ^ (i & 0xFFFFFFFFFF)]))
                    kept, least = mature(v, r, antibodies, p, metric, random, d)
                    ag += [i] * len(kept)
                    order += [(at << 15) + k for k in range(len(kept))]
                    best += [least] * len(kept)
                    rows += kept.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ag, pa.int64()), pa.array(order, pa.int64()), pa.array(best, pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["ag", "id", "best", "v"])

        memory = stage.write(placed.select("id", "v", "u", "rate").mapInArrow(run, "ag long, id long, best double, v array<double>"), "memory")
        average = memory.groupBy("ag").agg(F.first("best").alias("b")).agg(F.coalesce(F.avg("b"), F.lit(0.0))).head()[0]
        kept = suppress(memory.select("id", "v"), metric, p.suppression_threshold).limit(MAX_ANTIBODIES + 1).toPandas()
        if len(kept) > MAX_ANTIBODIES:
            raise ValueError(f"over {MAX_ANTIBODIES} antibodies survive; raise the suppression threshold")
        stage.drop(memory)
        kept = kept.sort_values("id")
        return (np.stack(kept.v.to_numpy()) if len(kept) else np.zeros((0, population.shape[1]))), float(average)

    def antibodies(self) -> DataFrame:
        frame = pd.DataFrame({"id": range(len(self.population)), "v": [r.tolist() for r in self.population]})
        return self.spark.createDataFrame(frame, "id long, v array<double>")

    def antibody_distances(self) -> DataFrame:
        """``i``, ``j`` (i < j), ``d`` of all pairs of antibodies."""
        return pairs(self.antibodies(), self.distance_method)

    def recorded(self) -> DataFrame:
        """``iter``, ``id``, ``v`` of the antibodies after each iteration."""
        rows = [(k, i, r.tolist()) for k, m in enumerate(self.antibody_history, 1) for i, r in enumerate(m)]
        return self.spark.createDataFrame(rows, "iter int, id long, v array<double>")

    def labels(self, p: PredictParams) -> DataFrame:
        """``node``, ``label`` of every antibody: components of the spanning forest after pruning."""
        a = self.antibodies()
        edges = graph.spanning_forest(a, self.distance_method)
        self.edges_deleted = graph.prune(edges, p.mst_pruning_type, p.mst_pruning_threshold, p.k, p.minimum_no_edges)
        return graph.component_labels(a.select(F.col("id").alias("node")), edges.join(self.edges_deleted.select("u", "v"), ["u", "v"], "left_anti"))

    def predict(self, vectors: DataFrame, p: PredictParams = PredictParams()) -> DataFrame:
        """``id``, ``cluster``: the label of the nearest antibody, ties to the lower; -1 for all if no antibody is left."""
        if not len(self.population):
            return vectors.select("id", F.lit(-1).cast("long").alias("cluster"))
        near = nearest(vectors.select("id", "v"), self.antibodies(), self.distance_method, 1)
        return near.join(F.broadcast(self.labels(p)), F.col("target") == F.col("node")).select("id", F.col("label").alias("cluster"))

    def save(self, folder: str) -> None:
        """The model as a folder of tables: antibodies, history and parameters."""
        self.antibodies().write.mode("overwrite").parquet(f"{folder}/antibodies")
        self.spark.createDataFrame(self.history or [(0, 0, 0.0)], "iter int, n_antibodies int, avg_d double").write.mode("overwrite").parquet(f"{folder}/history")
        text = json.dumps({"seed": self.seed, "distance_method": self.distance_method, "fit": asdict(self.params) if self.params else None})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/params")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ImmuneNetwork:
        told = json.loads(spark.read.text(f"{folder}/params").head()[0])
        net = cls(spark, told["seed"], told["distance_method"])
        net.params = FitParams(**told["fit"]) if told["fit"] else None
        rows = spark.read.parquet(f"{folder}/antibodies").limit(MAX_ANTIBODIES).toPandas().sort_values("id")
        net.population = np.stack(rows.v.to_numpy()) if len(rows) else net.population
        net.history = [tuple(r) for r in spark.read.parquet(f"{folder}/history").collect()]
        return net
