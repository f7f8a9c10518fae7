"""Occurrences of every distinct term and the number of records that have it.

Pairs of term and record are sorted over range partitions (an external sort: it spills), and each partition is scanned in
runs. The record belongs to the sort key, so a term of any frequency spreads over as many partitions as its pairs need;
the few runs that partitions share are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lymphspark.session import Stage, ship_package


def term_pairs(df: DataFrame, id_col: str, terms: Column, field_name: str) -> DataFrame:
    """(field_name, term, record, n) with n the occurrences in the record: added up before anything is shuffled.

    ``terms`` is an array column. Rows without terms or without an id give nothing; rows that share an id are one record to
    count_terms(), and records apart to what only adds up pairs.
    """
    ship_package(df.sparkSession)
    each = df.select(F.col(id_col).alias("record"), terms.alias("ts")).filter(F.col("record").isNotNull())
    return each.mapInArrow(_count_within, f"field_name string, term string, record {df.schema[id_col].dataType.simpleString()}, n long").withColumn("field_name", F.lit(field_name))


def _count_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        words = pc.list_flatten(lists)
        rows = pc.list_parent_indices(lists).to_numpy()
        if not len(rows):
            continue
        codes = words.dictionary_encode()
        pair = rows * len(codes.dictionary) + codes.indices.to_numpy()
        order = np.argsort(pair)
        new = _run_starts(pair[order])
        size = np.diff(np.append(new, len(rows)))
        at = pa.array(order[new])
        record = batch.column(0).take(pa.array(rows[order[new]]))
        for lo in range(0, len(new), 65536):
            part = slice(lo, lo + 65536)
            n = len(new[part])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), words.take(at[part]), record[part], pa.array(size[part], pa.int64())], names=["field_name", "term", "record", "n"])


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs sorted by term, field and record: for each run of a term its occurrences and its distinct records.

    A record's pairs all lie in one partition, as the record belongs to the range key; only its last record is kept between
    batches.
    """
    names = ["field_name", "term", "occurrences", "n_rows"]
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        field, term, record = (batch.column(k).dictionary_encode() for k in range(3))
        codes = [c.indices.to_numpy(zero_copy_only=False) for c in (field, term, record)]
        runs = _run_starts(codes[0], codes[1])
        fresh = np.zeros(batch.num_rows, dtype=np.int64)
        fresh[_run_starts(*codes)] = 1
        first = tuple(batch.column(k)[0].as_py() for k in range(3))
        if first == last:
            fresh[0] = 0
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(3))
        n = batch.column(3).to_numpy()
        at = pa.array(runs)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.add.reduceat(n, runs), pa.int64()), pa.array(np.add.reduceat(fresh, runs), pa.int64())], names=names)


def count_terms(pairs: DataFrame) -> DataFrame:
    """``field_name``, ``term``, ``occurrences``, ``n_rows`` of every distinct term, from pairs as term_pairs() gives them.

    Pairs that repeat a term and record add to the occurrences and count one record. An empty table gives an empty result.
    The term comes first in the order, as rows are sorted by the first bytes of that column before they are compared. The pairs are staged first, as the bounds of the ranges are sampled in a pass of their own, which would make them twice.
    """
    staged = Stage(pairs.sparkSession, "counts").write(pairs.select("field_name", "term", "record", "n"), "pairs")
    ranged = staged.repartitionByRange("term", "field_name", "record").sortWithinPartitions("term", "field_name", "record")
    runs = ranged.mapInArrow(scan_runs, "field_name string, term string, occurrences long, n_rows long")
    return runs.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_rows").alias("n_rows"))


def mark_terms(counts: DataFrame, totals: DataFrame, rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """Adds ``mark``: ``rare`` for terms in fewer than ``rare_below`` rows, ``common`` for those in more than the share
    ``common_above`` of all rows of the table (rows with null text count), else null. A term that is both is rare.
    ``totals`` has one row per field: ``field_name``, ``all_rows``.
    """
    mark = F.when(F.col("n_rows") < rare_below, "rare").when(F.col("n_rows") > F.lit(common_above) * F.col("all_rows"), "common")
    return counts.join(F.broadcast(totals), "field_name").withColumn("mark", mark).drop("all_rows")
