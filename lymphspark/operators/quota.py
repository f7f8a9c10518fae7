"""Exact quotas by random key: of each cell, the given number of rows with the smallest keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of the random key: a cell of n rows is ordered only within one bin, of about n / BINS rows.
BINS = 4096


def random_key(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from the seed and the record's own values: the same on any partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) * F.lit(2.0**-53)


def take_quotas(rows: DataFrame, cells: list[str], key: Column, ties: list[str], quotas: DataFrame) -> DataFrame:
    """The rows drawn: ``quota`` of each cell (all of a smaller cell) by the smallest keys, which lie in [0, 1).

    ``quotas`` has one row per cell with ``quota``. Cells without a quota give nothing; null is a cell value like others.
    A cell may hold any share of all rows: counts by key bin are added up before they are shuffled, whole bins are taken or
    left without ordering, and only the bin in which the quota ends is ordered.
    """
    here = [f"_cell{k}" for k in range(len(cells))]
    coded = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(h) for c, h in zip(cells, here)]
    keyed = rows.select("*", *coded, key.alias("_key")).withColumn("_bin", F.floor(F.col("_key") * BINS))
    wanted = quotas.select(*coded, F.col("quota").alias("_quota"))
    counts = keyed.groupBy(*here, "_bin").agg(F.count("*").alias("_n")).join(wanted, here)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*here).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("_before", before).filter(F.col("_before") < F.col("_quota"))
    cut = ends.groupBy(*here).agg(F.max("_bin").alias("_last"), F.max_by("_before", "_bin").alias("_upto"), F.first("_quota").alias("_quota"))
    near = keyed.join(cut, here).filter(F.col("_bin") <= F.col("_last"))
    order = Window.partitionBy(*here).orderBy("_key", *ties)
    within = near.filter("_bin = _last").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("_quota") - F.col("_upto"))
    return near.filter("_bin < _last").select(*rows.columns).unionByName(within.select(*rows.columns))
