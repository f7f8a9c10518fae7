"""Frequency tables, shares, exact stratified samples, rescaling and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lymphspark.functions.numbers import hash_uniform, round_half_even
from lymphspark.operators.quota import take_quotas


def value_counts(df: DataFrame, label: Column) -> DataFrame:
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("cnt"))


def percent_distribution(df: DataFrame, label: Column) -> DataFrame:
    """Counts and their share of all rows in percent, rounded half-even to two digits. The total comes from the counts."""
    counts = value_counts(df, label)
    total = F.broadcast(counts.agg(F.sum("cnt").alias("total")))
    return counts.crossJoin(total).select("label", "cnt", round_half_even(F.col("cnt") / F.col("total") * 100, 2).alias("pct"))


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name`` and ``nulls``, in one pass over the table."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("column_name", "nulls"))


def stratified_sample(df: DataFrame, id_col: str, label: str, fraction: float, seed: int) -> DataFrame:
    """round_half_even(fraction * n) rows of each label, by a seeded key. Null labels are a stratum of their own."""
    quota = df.groupBy(label).agg(round_half_even(F.count("*") * F.lit(fraction)).cast("long").alias("quota"))
    return take_quotas(df, [label], hash_uniform(seed, id_col), [id_col], quota)


def top_k_semijoin(df: DataFrame, label: str, k: int) -> DataFrame:
    """Rows of the k most frequent labels, ties by label."""
    top = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(k)
    return df.join(F.broadcast(top), label, "left_semi")


def to_long(df: DataFrame, id_col: str, vector: Column) -> DataFrame:
    """``id``, ``dim`` (from 0), ``value``."""
    return df.select(id_col, F.posexplode(vector.cast("array<double>")).alias("dim", "value"))


def column_ranges(df: DataFrame, vector: str) -> DataFrame:
    """One row: the least (``lo``) and the greatest (``hi``) value of every dimension, as arrays. Its size is the dimension."""
    long = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "value"))
    per = long.groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "lo", "hi")))
    return per.agg(ordered.alias("s")).select(F.transform("s", lambda x: x["lo"]).alias("lo"), F.transform("s", lambda x: x["hi"]).alias("hi"))


def min_max(df: DataFrame, vector: str) -> DataFrame:
    """The vector column rescaled to [0, 1] per dimension; a constant dimension becomes 0. The ranges (one row) are broadcast."""
    ranged = df.crossJoin(F.broadcast(column_ranges(df, vector)))
    zipped = F.arrays_zip(F.col(vector).cast("array<double>").alias("v"), F.col("lo"), F.col("hi"))
    scaled = F.transform(zipped, lambda z: F.coalesce(F.try_divide(z["v"] - z["lo"], z["hi"] - z["lo"]), F.lit(0.0)))
    return ranged.withColumn(vector, scaled).drop("lo", "hi")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
