"""Clusters of mutually similar records by Markov clustering of the similarity graph.

Flow is expanded (the column-stochastic matrix is squared), inflated (entries are raised to a power and columns made to add
up to one again) and pruned of small entries, until it settles; the rows that still have flow are the attractors, and a
cluster is what flows to one attractor. Flow never leaves a connected component, so components are clustered apart: those
of up to TILE sets in one task each, many at once as dense stacks; larger ones by squaring a distributed sparse matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lymphspark.llm.components import connected_components
from lymphspark.llm.near_duplicates import PAIR, pair_work, tile_arrays
from lymphspark.llm.numeric import forest, join, position_in_run, run_starts
from lymphspark.llm.similarity import TILE, Similarity, SimilarSets, compare, exact_pairs, whole_groups

INFLATION, PRUNE, ROUNDS = 2.0, 1e-4, 40
#: Columns of the distributed matrix that one task multiplies at a time are those whose numbers agree but for so many bits.
BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS
SALTS = 16
_NODE = "node long, group_row long, group_rows long, cluster_row long, cluster_rows long, flow double"


def markov_stack(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a stack of graphs (weights with loops, columns that are all zero being padding): the attractor of each column, and
    the flow that each row receives in two steps."""
    def stochastic(m: np.ndarray) -> np.ndarray:
        total = m.sum(axis=1, keepdims=True)
        return np.divide(m, total, out=np.zeros_like(m), where=total > 0)

    m = stochastic(weights)
    flow = (m @ m).sum(axis=2)
    for _ in range(ROUNDS):
        new = (m @ m) ** INFLATION
        new = stochastic(new)
        top = new.max(axis=1, keepdims=True)
        new[(new < PRUNE) & (new < top)] = 0
        new = stochastic(new)
        settled = np.abs(new - m).max() < 1e-8
        m = new
        if settled:
            break
    to = np.argmax(np.round(m, 9), axis=1)
    for _ in range(8):
        to = np.take_along_axis(to, to, axis=1)
    return to, flow


def cluster_groups(root: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attractor (as index) and flow of every node. ``root`` numbers the nodes' components, i-j are the links, w their weights.

    Flow to a set is in proportion to its copies, as copies are nodes that all have the same links.
    """
    n = len(root)
    order = np.lexsort((np.arange(n), root))
    starts = run_starts(root[order])
    sizes = np.diff(np.append(starts, n))
    place, number = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order], number[order] = position_in_run(starts, n), np.repeat(np.arange(len(starts)), sizes)
    attractor, flow = np.arange(n), copies.astype(float)
    room = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
    for k in np.unique(room[sizes > 1]):
        own = np.flatnonzero((room == k) & (sizes > 1))
        step = max(1, (1 << 21) // int(k * k))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            slot = np.full(len(starts), -1)
            slot[part] = np.arange(len(part))
            stack = np.zeros((len(part), k, k))
            nodes = np.flatnonzero(slot[number] >= 0)
            stack[slot[number[nodes]], place[nodes], place[nodes]] = copies[nodes]
            e = slot[number[i]] >= 0
            a, b, x = i[e], j[e], w[e]
            stack[slot[number[a]], place[a], place[b]] = x * copies[a]
            stack[slot[number[a]], place[b], place[a]] = x * copies[b]
            to, got = markov_stack(stack)
            attractor[nodes] = order[starts[number[nodes]] + to[slot[number[nodes]], place[nodes]]]
            flow[nodes] = got[slot[number[nodes]], place[nodes]]
    return attractor, flow


def _small_work(s: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            node, first, copies = (table.column(c).to_numpy() for c in ("node", "first_row", "copies"))
            group, block, cross, n, rows, h = tile_arrays(table)
            found = list(exact_pairs(group, block, cross, n, rows, h, s))
            i, j, o = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            root = np.arange(len(node))
            if len(i):
                inside, roots = forest(i, j)
                root[inside] = roots
            attractor, flow = cluster_groups(root, i, j, o / (n[i] + n[j] - o), copies)
            heads, cluster = np.unique(attractor, return_inverse=True)
            # Clusters between which an exact link runs make a group.
            group = join(np.arange(len(heads)), cluster[i], cluster[j])[cluster]
            least = np.full(len(heads), np.iinfo(np.int64).max)
            np.minimum.at(least, group, first)
            size = lambda label: np.bincount(label, copies)[label].astype(np.int64)
            out = [node, least[group], size(group), first[attractor], size(cluster)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*out, flow)], names=["node", "group_row", "group_rows", "cluster_row", "cluster_rows", "flow"])

    return run


class MarkovClusters:
    """``texts`` has ``field`` (int), ``row_id`` (long, unique in its field), ``text``; other columns aren't looked at.

    Two texts are similar if the distinct words that they share are at least num/den of those that either has. Texts without
    words (null, empty, blank) are in no cluster. Rows with equal words are always in one cluster. Ties of flow go to the
    lower row. An empty table gives empty results; texts of any length are taken whole.
    """

    similar = Similarity(3, 5, carried=True)

    def __init__(self, texts: DataFrame, num: int = 3, den: int = 5, tile: int = TILE):
        self.s = replace(self.similar, num=num, den=den)
        self.sets = SimilarSets(texts, self.s, "markov", tile)
        self.stage = self.sets.stage
        blocked = self.sets.blocked()
        small = compare(blocked.filter("blocks = 1"), _small_work(self.s), _NODE)
        large = self.stage.write(blocked.filter("blocks > 1"), "large")
        self.nodes = self.stage.write(small.unionByName(self._large(large)) if large.take(1) else small, "clustered")

    # Components that no single task may hold.

    def _large_links(self, large: DataFrame) -> DataFrame:
        """All links ``a``, ``b``, ``w``: the sets of a component are compared in tiles of block pairs."""
        found = compare(large, pair_work(self.s), PAIR)
        return found.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"), (F.col("overlap") / F.col("total")).alias("w"))

    def _large(self, large: DataFrame) -> DataFrame:
        links = self.stage.write(self._large_links(large), "links")
        comps = connected_components(links.select("a", "b"), self.stage)
        nodes = large.select("node", "first_row", "copies")
        nodes = self.stage.write(nodes.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        # A set on its own keeps its copies as flow, as in the stacks.
        linked = nodes.join(comps.select("node"), "node", "left_semi")
        to = self.stage.write(markov_distributed(links, linked, self.stage), "flow")
        rows = nodes.join(to, "node", "left")
        rows = self.stage.write(rows.withColumn("attractor", F.coalesce("attractor", "node")).withColumn("flow", F.coalesce("flow", F.col("copies").cast("double"))), "attracted")
        # Clusters between which an exact link runs make a group.
        end = lambda c: rows.select(F.col("node").alias(c), F.col("attractor").alias(f"{c}_to"))
        between = links.join(end("a"), "a").join(end("b"), "b").filter("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct()
        joined = connected_components(between, self.stage).toDF("attractor", "group")
        rows = rows.join(joined, "attractor", "left").withColumn("group", F.coalesce("group", "attractor"))
        groups = rows.groupBy("group").agg(F.min("first_row").alias("group_row"), F.sum("copies").alias("group_rows"))
        clusters = rows.groupBy("attractor").agg(F.sum("copies").alias("cluster_rows"))
        heads = nodes.select(F.col("node").alias("attractor"), F.col("first_row").alias("cluster_row"))
        return rows.join(groups, "group").join(clusters, "attractor").join(heads, "attractor").select("node", "group_row", "group_rows", "cluster_row", "cluster_rows", "flow")

    # Results.

    def rows(self) -> DataFrame:
        """One row per row with words: ``field``, ``row_id``; ``cluster_row`` and ``cluster_rows`` (attractor and size of its
        Markov cluster); ``group_row`` and ``group_rows`` (least row and size of the clusters that exact links join, directly or
        through others); ``flow``, the flow that the row's text receives."""
        own = self.sets.classes.select("node", "first_row", "copies").join(self.nodes, "node", "left")
        fill = lambda c, other: F.coalesce(c, F.col(other)).alias(c)
        known = own.select("node", fill("group_row", "first_row"), fill("group_rows", "copies"), fill("cluster_row", "first_row"), fill("cluster_rows", "copies"), F.coalesce("flow", F.col("copies").cast("double")).alias("flow"))
        return self.sets.sets.filter("n > 0").select("field", "row_id", "node").join(known, "node").drop("node")

    def typical(self, members: int = 3, least_rows: int = 3) -> DataFrame:
        """Of each Markov cluster of ``least_rows`` or more: its size, and the rows that most flow goes to."""
        found = self.rows().filter(F.col("cluster_rows") >= least_rows)
        order = [F.desc("flow"), F.asc("row_id")]
        salted = found.withColumn("salt", F.pmod("row_id", F.lit(SALTS)))
        first = salted.withColumn("r", F.row_number().over(Window.partitionBy("field", "cluster_row", "salt").orderBy(*order))).filter(F.col("r") <= members)
        return first.withColumn("rank", F.row_number().over(Window.partitionBy("field", "cluster_row").orderBy(*order))).filter(F.col("rank") <= members).select("field", "cluster_row", "cluster_rows", "rank", "row_id", "flow")


def _stochastic(m: DataFrame) -> DataFrame:
    return m.join(m.groupBy("j").agg(F.sum("v").alias("t")), "j").select("i", "j", (F.col("v") / F.col("t")).alias("v"))


def _pruned(m: DataFrame) -> DataFrame:
    """Columns made stochastic, small entries dropped but for the largest of a column, stochastic again."""
    totals = m.groupBy("j").agg(F.sum("v").alias("t"), F.max("v").alias("top"))
    return _stochastic(m.join(totals, "j").filter((F.col("v") >= F.col("top")) | (F.col("v") / F.col("t") >= PRUNE)).select("i", "j", (F.col("v") / F.col("t")).alias("v")))


def block_products(right: np.ndarray, k: np.ndarray, x: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, value) of the products of entries (i, k) and, where ``right``, (k, j), added up over the given k; x is i or j.

    Slices of the result with few products are added up from these, others multiplied as dense matrices.
    """
    left = ~right
    _, k = np.unique(k, return_inverse=True)
    (rows, i), (cols, j) = (np.unique(x[side], return_inverse=True) for side in (left, right))
    width = int(k.max(initial=-1)) + 1
    by_row, by_col = np.argsort(i, kind="stable"), np.argsort(j, kind="stable")
    i, ka, va = i[by_row], k[left][by_row], v[left][by_row]
    j, kb, vb = j[by_col], k[right][by_col], v[right][by_col]
    for lo in range(0, len(cols), 4 * BLOCK):
        own = slice(*np.searchsorted(j, (lo, lo + 4 * BLOCK)))
        order = np.argsort(kb[own], kind="stable")
        jj, kk, vv = j[own][order] - lo, kb[own][order], vb[own][order]
        count, wide = np.bincount(kk, minlength=width), min(4 * BLOCK, len(cols) - lo)
        first, dense = np.cumsum(count) - count, None
        for top in range(0, len(rows), BLOCK):
            part = slice(*np.searchsorted(i, (top, top + BLOCK)))
            ii, ki, vi, high = i[part] - top, ka[part], va[part], min(BLOCK, len(rows) - top)
            each = count[ki]
            if 4 * each.sum() < high * wide:
                at = np.repeat(first[ki], each) + position_in_run(np.cumsum(each) - each, int(each.sum()))
                place, inverse = np.unique(np.repeat(ii, each) * wide + jj[at], return_inverse=True)
                value = np.bincount(inverse, np.repeat(vi, each) * vv[at], len(place))
            else:
                if dense is None:
                    dense = np.zeros((width, wide))
                    dense[kk, jj] = vv
                a = np.zeros((high, width))
                a[ii, ki] = vi
                product = (a @ dense).reshape(-1)
                place = np.flatnonzero(product)
                value = product[place]
            if len(place):
                yield rows[top + place // wide], cols[lo + place % wide], value


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of the entries of every block, from rows sorted by block."""
    held: list[pa.RecordBatch] = []
    now = None

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.Table.from_batches(held)
            for found in block_products(*(table.column(c).to_numpy() for c in ("right", "k", "x", "v"))):
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["i", "j", "v"])
            held.clear()

    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = np.append(run_starts(block), len(block))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if block[lo] != now:
                yield from close()
                now = block[lo]
            held.append(batch.slice(lo, hi - lo))
    yield from close()


def _squared(m: DataFrame) -> DataFrame:
    """The matrix times itself: an entry goes to the block of its column and to that of its row, nowhere else."""
    entry = lambda right, k, x: F.struct(F.shiftright(k, BLOCK_BITS).alias("block"), F.lit(right).alias("right"), F.col(k).alias("k"), F.col(x).alias("x"), "v")
    sides = m.select(F.inline(F.array(entry(False, "j", "i"), entry(True, "i", "j"))))
    products = sides.repartition("block").sortWithinPartitions("block").mapInArrow(_squares, "i long, j long, v double")
    return products.groupBy("i", "j").agg(F.sum("v").alias("v"))


def markov_distributed(links: DataFrame, nodes: DataFrame, stage, rounds: int = ROUNDS) -> DataFrame:
    """``node``, ``attractor`` and ``flow`` by squaring a sparse matrix: entry (i, j) is the flow from j to i.

    ``links`` has ``a``, ``b``, ``w``, each link once; ``nodes`` has ``node``, ``copies``, and, where they are known, ``root`` of
    its component and ``first_row``, which orders ties. The same steps as markov_stack, with no other entries left out.
    """
    known = nodes.select("node", "copies", *[c if c in nodes.columns else F.lit(0).alias(c) for c in ("root", "first_row")])
    number = known.select("root").distinct().select("root", F.row_number().over(Window.orderBy("root")).cast("long").alias("number"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("first_row", "node")) - 1
    ids = stage.write(known.withColumn("place", place).join(number, "root").select("node", "copies", (F.shiftleft("number", 32) + F.col("place")).alias("id")), "ids")
    end = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"), F.col("copies").alias(f"{c}_copies"))
    ends = links.join(end("a"), "a").join(end("b"), "b")
    entry = lambda i, j: F.struct(F.col(f"{i}_id").alias("i"), F.col(f"{j}_id").alias("j"), (F.col("w") * F.col(f"{i}_copies")).alias("v"))
    loops = ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("copies").cast("double").alias("v"))
    m = stage.write(_stochastic(stage.write(ends.select(F.inline(F.array(entry("a", "b"), entry("b", "a")))).unionByName(loops), "weights")), "matrix")
    flow = None
    for _ in range(rounds):
        square = stage.write(_squared(m), "square")
        if flow is None:
            flow = stage.write(square.groupBy("i").agg(F.sum("v").alias("flow")), "flow")
        new = stage.write(_pruned(square.select("i", "j", F.pow("v", F.lit(INFLATION)).alias("v"))), "matrix")
        change = new.unionByName(m.select("i", "j", (-F.col("v")).alias("v"))).groupBy("i", "j").agg(F.abs(F.sum("v")).alias("d"))
        apart = change.agg(F.max("d")).head()[0] or 0.0
        stage.drop(square)
        stage.drop(m)
        m = new
        if apart < 1e-8:
            break
    to = stage.write(m.groupBy("j").agg(F.max_by("i", F.struct(F.round("v", 9), -F.col("i"))).alias("to")), "to")
    for _ in range(8):
        ahead = to.select(F.col("j").alias("to"), F.col("to").alias("next"))
        to = stage.write(to.select("j", "to").join(ahead, "to").select("j", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "to")
        if not to.filter("moved").take(1):
            break
    named = ids.select("node", F.col("id").alias("j")).join(to.select("j", "to"), "j").join(flow.withColumnRenamed("i", "j"), "j")
    return named.join(ids.select(F.col("node").alias("attractor"), F.col("id").alias("to")), "to").select("node", "attractor", "flow")
