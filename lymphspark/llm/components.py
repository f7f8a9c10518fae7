"""Connected components of a graph of any size, by alternating star contraction on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lymphspark.llm.numeric import forest
from lymphspark.session import Stage

_EDGE = "a long, b long"
#: Links of one partition that are contracted together before anything is shuffled.
LOCAL = 1 << 20


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace links by as few that connect the same nodes, over up to LOCAL of them."""
    held_a, held_b, size = [], [], 0

    def emit() -> pa.RecordBatch:
        nodes, roots = forest(np.concatenate(held_a), np.concatenate(held_b))
        own = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], names=["a", "b"])

    for batch in batches:
        held_a.append(batch.column(0).to_numpy())
        held_b.append(batch.column(1).to_numpy())
        size += batch.num_rows
        if size >= LOCAL:
            yield emit()
            held_a, held_b, size = [], [], 0
    if size:
        yield emit()


def connected_components(links: DataFrame, stage: Stage, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of a link between two different nodes.

    ``links`` has ``a`` and ``b`` (long). Repeated links, both directions and loops are fine; an empty table gives an empty
    result. A hub may have any number of links: groups are only ever reduced to their minimum, never gathered.
    """
    edges = stage.write(links.select("a", "b").filter("a <> b").mapInArrow(contract, _EDGE), "links")
    for _ in range(most_rounds):
        # Large star: every neighbour that is greater than a node gets linked to the node's least neighbour.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its lesser neighbours get linked to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = stage.write(small.mapInArrow(contract, _EDGE), "links")
        # Done when every link leads to a root: no end is the start of another link, and no start has two ends.
        open_ends = new.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        done = not open_ends.filter("lo <> hi").take(1) and not new.join(new.select(F.col("a").alias("b")), "b", "left_semi").take(1)
        stage.drop(edges)
        edges = new
        if done:
            break
    else:
        raise RuntimeError("the components did not settle")
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    return own.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
