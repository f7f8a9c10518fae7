"""Scores a stream of vectors with a fitted network: no state, so no watermark is needed. An extension of the batch API."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lymphspark.operators.network import ImmuneNetwork, PredictParams
from lymphspark.operators.vectors import distances


def score_stream(stream: DataFrame, network: ImmuneNetwork, p: PredictParams = PredictParams()) -> DataFrame:
    """``id``, ``cluster`` for every row of a stream (or batch) with ``id`` and ``v``: the label of the nearest antibody.

    The antibodies, whose number is bounded, are broadcast; rows are scored one Arrow batch at a time.
    """
    if not len(network.population):
        return stream.select("id", F.lit(-1).cast("long").alias("cluster"))
    labels = dict(network.labels(p).collect())
    shared = network.spark.sparkContext.broadcast((network.population, np.array([labels[k] for k in range(len(network.population))])))
    metric = network.distance_method

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        antibodies, label = shared.value
        for batch in batches:
            if batch.num_rows:
                d = np.round(distances(np.array(batch.column(1).to_pylist()), antibodies, metric), 9)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label[d.argmin(1)])], names=["id", "cluster"])

    return stream.select("id", "v").mapInArrow(run, "id long, cluster long")
