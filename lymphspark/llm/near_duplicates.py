"""Records that share most of their content, in spite of small edits, insertions and reordering.

The sets are the distinct word runs of the texts. Tiles of postings in order of size are compared on hashed bitmaps, whose
bit counts bound the overlap from above; what remains is intersected exactly on sorted arrays (see ``similarity``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lymphspark.llm.components import connected_components
from lymphspark.llm.similarity import TILE, Similarity, SimilarSets, compare, exact_pairs, whole_groups

#: Copies of a class that one task pairs with others; classes with more that are broadcast.
COPIES, MANY = 1024, 100_000
PAIR = "node_a long, node_b long, overlap int, total int"


def tile_arrays(table: pa.Table):
    """Group number, own block, whether only pairs across blocks count, sizes, and elements with their rows."""
    table = table.combine_chunks()
    comp, i, j = (table.column(c).to_numpy() for c in ("comp", "tile_i", "tile_j"))
    new = np.ones(len(comp), bool)
    new[1:] = (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    lists = table.column("elements").combine_chunks()
    rows, h = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy().view(np.uint64)
    return np.cumsum(new), table.column("block").to_numpy(), i != j, table.column("n").to_numpy().astype(np.int64), rows, h


def pair_work(s: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            node = table.column("node").to_numpy()
            group, block, cross, n, rows, h = tile_arrays(table)
            for a, b, overlap in exact_pairs(group, block, cross, n, rows, h, s):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(overlap, pa.int32()), pa.array(n[a] + n[b] - overlap, pa.int32())], names=["node_a", "node_b", "overlap", "total"])

    return run


class NearDuplicates:
    """``texts`` has ``field`` (int), ``row_id`` (long, unique in its field) and ``text``; other columns aren't looked at.

    Texts with fewer words than a run (null, empty and blank ones too) have no pairs. Rows with equal sets of runs are copies
    with similarity 1. An empty table gives empty results. Texts of any length are taken whole.
    """

    def __init__(self, texts: DataFrame, run: int = 5, num: int = 4, den: int = 5, tile: int = TILE):
        self.s = Similarity(num, den, run, other=r"[^\pL\pN]+")
        self.sets = SimilarSets(texts, self.s, "near", tile)
        self.members = self.sets.sets.filter("n > 0").select("field", "node", "row_id")

    def class_pairs(self) -> DataFrame:
        """Pairs of classes of equal sets: ``node_a``, ``node_b``, ``overlap``, ``total`` (elements that either has)."""
        return compare(self.sets.blocked(), pair_work(self.s), PAIR)

    def row_pairs(self) -> DataFrame:
        """``field``, ``row_a``, ``row_b``, ``similarity`` of all pairs of rows, row_a before row_b. A class of r copies has
        r * (r - 1) / 2 pairs of its own, so this form is as large as the result is stated; class_pairs() is not.

        The members of a class with many copies are cut into salts, so that no task gets all of them on both sides."""
        salts = self._salts()
        member = self._salted(self.members, salts).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts")))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
        side = lambda node, row: member.select(F.col("node").alias(node), "salt", F.col("row_id").alias(row))
        spread = lambda pairs, node: self._salted(pairs, salts, node).withColumn("salt", every).drop("salts")
        across = spread(self.class_pairs(), "node_a").join(member.select("field", F.col("node").alias("node_a"), "salt", F.col("row_id").alias("x")), ["node_a", "salt"]).drop("salt")
        across = spread(across, "node_b").join(side("node_b", "y"), ["node_b", "salt"])
        several = self.sets.classes.filter("copies > 1").select("node")
        own = member.join(several, "node")
        within = own.select("field", "node", "salt", F.col("row_id").alias("x")).join(own.withColumn("salt", every).select("node", "salt", F.col("row_id").alias("y")), ["node", "salt"]).filter("x < y")
        pairs = across.select("field", "x", "y", (F.col("overlap") / F.col("total")).alias("similarity")).unionByName(within.select("field", "x", "y", F.lit(1.0).alias("similarity")))
        return pairs.select("field", F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"), "similarity")

    def _salts(self) -> DataFrame | None:
        """``node`` and ``salts`` of classes with more than COPIES rows; none if there are none. Broadcast only up to MANY."""
        found = self.sets.stage.write(self.sets.classes.filter(F.col("copies") > COPIES).select("node", F.ceil(F.col("copies") / COPIES).alias("salts")), "salts")
        n = found.limit(MANY + 1).count()
        return None if not n else F.broadcast(found) if n <= MANY else found

    @staticmethod
    def _salted(rows: DataFrame, salts: DataFrame | None, node: str = "node") -> DataFrame:
        if salts is None:
            return rows.withColumn("salts", F.lit(1).cast("long"))
        return rows.join(salts.withColumnRenamed("node", node), node, "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))

    def groups(self) -> DataFrame:
        """One row per row with words enough: ``field``, ``row_id``, ``group_row_id`` (least row of its group), ``n_links``
        (other texts' classes that it is similar to) and ``copies`` (rows with the same set, itself too)."""
        pairs = self.sets.stage.write(self.class_pairs(), "pairs")
        comps = connected_components(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), self.sets.stage)
        links = pairs.select(F.explode(F.array("node_a", "node_b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        classes = self.sets.classes.select("node", "first_row", "copies").join(comps, "node", "left").join(links, "node", "left")
        classes = classes.withColumn("root", F.coalesce("root", "node")).fillna(0, ["n_links"])
        least = classes.groupBy("root").agg(F.min("first_row").alias("group_row_id"))
        return self.members.join(classes.join(least, "root"), "node").select("field", "row_id", "group_row_id", "n_links", "copies")
