import random
import re
import tracemalloc
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lymphspark.llm import similarity
from lymphspark.llm.components import connected_components
from lymphspark.llm.markov import MarkovClusters, block_products, cluster_groups, markov_distributed
from lymphspark.llm.near_duplicates import NearDuplicates
from lymphspark.llm.similarity import BUCKETS, Similarity, _poster, tiny, unpack
from lymphspark.session import Stage

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("b", "d", "g", "l", "n", "r", "s", "t", "v", "z")]


def made_texts(seed: int, bases: int, variants: int, length: int, edits: int, noise: int) -> list[tuple[int, int, str]]:
    """Groups of retold texts, and texts on their own, in two fields."""
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [rng.choice(WORDS) for _ in range(rng.randint(3, length))]
        for _ in range(rng.randint(1, variants)):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = [[rng.choice(WORDS)], [], [copy[k], rng.choice(WORDS)]][rng.randrange(3)] or [copy[k]]
            rows.append(" ".join(copy))
    rows += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, length))) for _ in range(noise)]
    rng.shuffle(rows)
    return [(k % 2, 100 + k, t) for k, t in enumerate(rows)]


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def word_groups(rows):
    sets = {(f, r): frozenset(re.findall(r"[^\W\d_]+", (t or "").lower())) for f, r, t in rows}
    keys = [k for k, s in sets.items() if s]
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if a[0] == b[0] and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    return components(links, keys)


SCHEMA = "field int, row_id long, text string"


@pytest.mark.parametrize(("seed", "tile"), [(1, 2048), (2, 2048), (3, 4), (4, 6)])
def test_groups_equal_brute_force(spark, seed, tile):
    rows = made_texts(seed, 25, 8, 24, 5, 60)
    got = MarkovClusters(spark.createDataFrame(rows, SCHEMA), tile=tile).rows().collect()
    want = word_groups(rows)
    assert {(r.field, r.row_id): r.group_row for r in got} == {k: v[1] for k, v in want.items()}
    sizes = defaultdict(int)
    for k, v in want.items():
        sizes[v] += 1
    assert all(r.group_rows == sizes[(r.field, r.group_row)] for r in got)
    # A Markov cluster lies within its group, and its head in itself.
    head = {(r.field, r.row_id): r.cluster_row for r in got}
    assert all(want[(r.field, r.cluster_row)] == want[(r.field, r.row_id)] and head[(r.field, r.cluster_row)] == r.cluster_row for r in got)


def test_tiny_sets(spark):
    """Sets of up to five words: those for which no neighbouring pair need be shared."""
    rng = random.Random(5)
    rows = [(0, k, " ".join(rng.sample("a b c d e f g".split(), rng.randint(1, 5)))) for k in range(150)]
    got = MarkovClusters(spark.createDataFrame(rows, SCHEMA)).rows().collect()
    assert {(r.field, r.row_id): r.group_row for r in got} == {k: v[1] for k, v in word_groups(rows).items()}
    assert tiny(Similarity(3, 5, paired=True)) == 5


@pytest.mark.parametrize("tile", [2048, 4])
def test_pairs_equal_brute_force(spark, tile):
    rows = made_texts(7, 25, 6, 30, 3, 40)
    rows += [(0, 9001, rows[0][2]), (0, 9002, rows[0][2])]
    near = NearDuplicates(spark.createDataFrame(rows, SCHEMA), run=3, num=1, den=2, tile=tile)
    sets = {}
    for f, r, t in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        sets[f, r] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    keys = [k for k in sets if sets[k]]
    want = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for i, a in enumerate(keys) for b in keys[:i] if a[0] == b[0] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    got = [tuple(r)[:3] for r in near.row_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {(r.field, r.row_id): r for r in near.groups().collect()}
    roots = components([((f, a), (f, b)) for f, a, b in want], keys)
    assert {k: r.group_row_id for k, r in groups.items()} == {k: v[1] for k, v in roots.items()}
    assert groups[0, 9001].copies >= 3 and groups[0, 9001].n_links == groups[0, 9002].n_links


def test_edge_cases(spark):
    long = " ".join(WORDS[k % 80] + WORDS[k // 80 % 80] for k in range(6000))
    rows = [(0, 1, None), (0, 2, ""), (0, 3, " \t\n "), (0, 4, "1234 !!"), (0, 5, long), (0, 6, long + " extra"), (0, None, long), (1, 7, long)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "row_id AS node", "row_id AS comp", "text AS elements")
    got = {(r.field, r.row_id): r.group_row for r in MarkovClusters(df).rows().collect()}
    assert got == {(0, 5): 5, (0, 6): 5, (1, 7): 7}
    pairs = NearDuplicates(df).row_pairs().collect()
    assert [tuple(p)[:3] for p in pairs] == [(0, 5, 6)]
    empty = spark.createDataFrame([], SCHEMA)
    assert MarkovClusters(empty).rows().collect() == [] and MarkovClusters(empty).typical().collect() == []
    assert NearDuplicates(empty).row_pairs().collect() == [] and NearDuplicates(empty).groups().collect() == []


def test_many_copies_of_one_text(spark):
    """One text holds most rows: copies are one node, and never paired with each other."""
    rows = [(0, k, "the river harbour reopened after a quiet strike") for k in range(4000)] + [(0, 5000, "the river harbour reopened after a long strike"), (0, 5001, "nothing like it")]
    m = MarkovClusters(spark.createDataFrame(rows, SCHEMA))
    got = m.rows().groupBy("group_row").count().collect()
    assert {r.group_row: r["count"] for r in got} == {0: 4001, 5001: 1}
    top = m.typical().collect()
    assert len(top) == 3 and top[0].cluster_rows == 4001


def test_groups_are_clusters_joined_by_links(spark):
    """Two dense groups with one link between them: two Markov clusters, one group, on both paths."""
    left, right = [WORDS[k : k + 20] for k in (0, 50)]
    rows = [(0, k, " ".join(left[:k] + left[k + 1 :])) for k in range(6)] + [(0, 10 + k, " ".join(right[:k] + right[k + 1 :])) for k in range(6)]
    rows += [(0, 20, " ".join(left + right[:12])), (0, 21, " ".join(left[:11] + right))]
    got = {}
    for tile in (2048, 4):
        got[tile] = {r.row_id: r for r in MarkovClusters(spark.createDataFrame(rows, SCHEMA), tile=tile).rows().collect()}
        want = word_groups(rows)
        assert {(0, k): r.group_row for k, r in got[tile].items()} == {k: v[1] for k, v in want.items()}
        assert all(r.group_row == min(x.row_id for x in got[tile].values() if x.group_row == r.group_row) for r in got[tile].values())
    assert {k: (r.cluster_row, r.cluster_rows, r.group_rows) for k, r in got[2048].items()} == {k: (r.cluster_row, r.cluster_rows, r.group_rows) for k, r in got[4].items()}


@pytest.mark.parametrize("tile", [2048, 64, 8])
def test_clusters_equal_one_matrix(spark, tile):
    """The whole graph as one dense matrix, copies as nodes of their own, squared and inflated until it settles."""
    rows = [r for r in made_texts(29, 12, 9, 16, 5, 20) if r[0] == 0]
    rows += [(0, 9000 + k, rows[3][2]) for k in range(3)]
    sets = [frozenset(re.findall(r"[^\W\d_]+", t.lower())) for _, _, t in rows]
    n = len(rows)
    m = np.array([[len(a & b) / len(a | b) if 5 * len(a & b) >= 3 * len(a | b) else 0.0 for b in sets] for a in sets])
    m /= m.sum(axis=0)
    # What a text receives: from every other text once, in proportion to its copies.
    first = [sets.index(s) == k for k, s in enumerate(sets)]
    flow = dict.fromkeys(sets, 0.0)
    for s, x in zip(sets, (m @ m)[:, first].sum(axis=1)):
        flow[s] += x
    for _ in range(60):
        m = (m @ m) ** 2
        m /= m.sum(axis=0)
        m[m < 1e-4 / 4] = 0  # an entry of a set with copies is spread over these
        m /= m.sum(axis=0)
    together = components([(i, j) for j in range(n) for i in np.flatnonzero(m[:, j] > 1e-6)], range(n))
    got = {r.row_id: r for r in MarkovClusters(spark.createDataFrame(rows, SCHEMA), tile=tile).rows().collect()}
    ours = [got[r[1]].cluster_row for r in rows]
    assert all((together[i] == together[j]) == (ours[i] == ours[j]) for i in range(n) for j in range(i))
    assert np.allclose([got[r[1]].flow for r in rows], [flow[s] for s in sets])


def test_pairs_of_a_much_copied_text(spark, monkeypatch):
    """Classes with more copies than a task pairs are salted, on either side of a link and within."""
    import lymphspark.llm.near_duplicates as near

    base = WORDS[:30]
    rows = [(0, k, " ".join(base)) for k in range(40)] + [(0, 100 + k, " ".join(base[:-1])) for k in range(25)] + [(0, 200, " ".join(base[1:]))]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = sorted(map(tuple, NearDuplicates(df, 3, 1, 2).row_pairs().collect()))
    monkeypatch.setattr(near, "COPIES", 8)
    assert sorted(map(tuple, NearDuplicates(df, 3, 1, 2).row_pairs().collect())) == plain and len(plain) == 66 * 65 // 2
    monkeypatch.setattr(near, "MANY", 0)
    assert sorted(map(tuple, NearDuplicates(df, 3, 1, 2).row_pairs().collect())) == plain


def test_markov_parts_two_cliques_with_a_bridge(spark):
    clique = [(a, b) for base in (0, 5) for a in range(base, base + 5) for b in range(base, a)]
    i, j = map(np.array, zip(*clique, (5, 4)))
    to, flow = cluster_groups(np.zeros(10, int), i, j, np.r_[np.full(20, 0.9), 0.61], np.ones(10, int))
    assert len(set(to[:5])) == len(set(to[5:])) == 1 and to[0] != to[9] and (flow > 0).all()
    stage = Stage(spark, "test")
    links = stage.write(spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(i, j, np.r_[np.full(20, 0.9), 0.61])], "a long, b long, w double"))
    nodes = spark.createDataFrame([(k, 1) for k in range(10)], "node long, copies long")
    far = {r.node: r for r in markov_distributed(links, nodes, stage).collect()}
    assert [far[k].attractor for k in range(10)] == to.tolist()
    assert np.allclose([far[k].flow for k in range(10)], flow)


def test_large_components_flow_as_small_ones_do(spark):
    """Near-copies in one component: the distributed matrix has to give what the dense stacks give, clusters and flow."""
    rng = random.Random(17)
    bases = [WORDS[k : k + 14] for k in (0, 9, 40)]
    rows = []
    for k in range(150):
        copy = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        rows.append((0, k, " ".join(copy)))
    df = spark.createDataFrame(rows, SCHEMA)
    small, large = ({r.row_id: r for r in MarkovClusters(df, tile=tile).rows().collect()} for tile in (2048, 16))
    assert max(r.group_rows for r in small.values()) > 40
    for c in ("group_row", "group_rows", "cluster_row", "cluster_rows"):
        assert {k: r[c] for k, r in large.items()} == {k: r[c] for k, r in small.items()}
    assert np.allclose([large[k].flow for k in sorted(small)], [small[k].flow for k in sorted(small)])


@pytest.mark.parametrize("density", [0.002, 0.5])
def test_block_products(density):
    rng = np.random.default_rng(3)
    a, b = (np.where(rng.random(shape) < density, rng.random(shape), 0) for shape in ((1500, 60), (60, 5000)))
    (i, ka), (kb, j) = np.nonzero(a), np.nonzero(b)
    got = np.zeros((1500, 5000))
    for x, y, v in block_products(np.repeat([False, True], [len(i), len(j)]), np.r_[ka, kb], np.r_[i, j], np.r_[a[i, ka], b[kb, j]]):
        got[x, y] += v
    assert np.allclose(got, a @ b)


def test_components_of_paths_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, k) for k in range(501, 900)] + [(1000, 1000), (2001, 2000), (2000, 2001)]
    random.Random(3).shuffle(links)
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long").repartition(4), Stage(spark, "test")).collect())
    assert got == {k: 0 for k in range(201)} | {k: 500 for k in range(500, 900)} | {2000: 2000, 2001: 2000}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Stage(spark, "test")).collect() == []


def test_least_row_of_equal_sets_is_posted():
    """Rows of several staged files in one batch: a class of copies is found by its least rid, wherever that row stands."""
    elements = [[1, 2, 3, 4, 5, 6], [11, 12, 13, 14, 15, 16]] * 2
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.array([9, 2, 3, 8]), pa.array([70, 71] * 2), pa.array([6] * 4, pa.int32()), pa.array(elements, pa.list_(pa.int64()))], names=["field", "rid", "node", "n", "elements"])
    run = _poster(Similarity(3, 5, paired=True), SimpleNamespace(value=np.zeros(BUCKETS, np.int64)), {0: 1}, {0: 2})
    posted = {r for out in run(iter([batch])) for blob in out.column(1) for r in unpack(blob.as_py())[1].tolist()}
    assert posted == {3, 2}


def test_pairs_compared_grow_less_than_with_the_square(monkeypatch):
    """p4: four times the texts of one vocabulary have sixteen times the pairs, most of which are never compared."""

    def compared(rows: int) -> int:
        rng, count = np.random.default_rng(3), 0
        weights = 1 / np.arange(3, 1503)
        elements = [np.sort(rng.choice(1500, 20, False, weights / weights.sum())).tolist() for _ in range(rows)]
        batch = pa.RecordBatch.from_arrays([pa.array([0] * rows, pa.int32()), pa.array(range(rows)), pa.array(range(rows)), pa.array([20] * rows, pa.int32()), pa.array(elements, pa.list_(pa.int64()))], names=["field", "rid", "node", "n", "elements"])
        known = np.zeros(similarity.BUCKETS, np.int64)
        pairs, near = similarity.pairs_in_runs, similarity._near

        def counted(pos, *most):
            nonlocal count
            count += int(pos.sum())
            return pairs(pos, *most)

        def counted_near(rows, cols, *rest):
            nonlocal count
            count += len(rows) * len(cols)
            return near(rows, cols, *rest)

        with monkeypatch.context() as m:
            m.setattr(similarity, "pairs_in_runs", counted)
            m.setattr(similarity, "_near", counted_near)
            s = MarkovClusters.similar
            for told in similarity._counter(s)(iter([batch])):
                known[told.column(0).to_numpy()] = told.column(1).to_numpy()
            blobs = pa.Table.from_batches(similarity._poster(s, SimpleNamespace(value=known), {0: 1}, {0: 2})(iter([batch])))
            list(similarity._tiles(s)(iter(blobs.combine_chunks().to_batches())))
        return count

    few, many = compared(4000), compared(16000)
    assert few and many < 10 * few


@pytest.mark.parametrize("small", [2, 64])
def test_carried_postings_equal_brute_force(spark, monkeypatch, small):
    """Runs of any size are split as far as they can be; sets of few elements too."""
    monkeypatch.setattr(similarity, "SMALL_RUN", small)
    monkeypatch.setattr(similarity, "SPLIT", 64)
    rng = random.Random(small)
    sets = [sorted(rng.sample(range(14), rng.randint(1, 9))) for _ in range(700)]
    n = len(sets)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(range(n)), pa.array([hash(tuple(x)) for x in sets]), pa.array([len(x) for x in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names=["field", "rid", "node", "n", "elements"])
    s = MarkovClusters.similar
    run = _poster(s, SimpleNamespace(value=np.zeros(BUCKETS, np.int64)), {0: 1}, {0: 2})
    blobs = [b for out in run(iter([batch])) for b in out.column(1).to_pylist()]
    key, at, pos, rid, size, code = similarity.unpack_carried(blobs[0])
    label = similarity._Splits(s, size, np.cumsum(size) - size, code).run(key, at, pos)
    own = [set(sets[r]) for r in rid.tolist()]
    links = [(a, b) for a in range(len(own)) for b in range(a) if 5 * len(own[a] & own[b]) >= 3 * len(own[a] | own[b])]
    want = components(links, range(len(own)))
    assert [want[k] for k in range(len(own))] == label.tolist()


def test_a_part_of_any_size_is_held_by_some_keys_at_a_time(monkeypatch):
    """p4: the links are those of the whole part, and memory follows CODES and WIDE, not the codes of the part."""
    for name, value in (("CODES", 1 << 19), ("WIDE", 1 << 16), ("SENT", 1 << 12)):
        monkeypatch.setattr(similarity, name, value, raising=False)
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(40 * k, 40 * k + 40), 30)) for k in range(20) for _ in range(20)]
    copies = sets * 100
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(copies), pa.int32()), pa.array(range(len(copies))), pa.array(range(len(copies))), pa.array([30] * len(copies), pa.int32()), pa.array(copies, pa.list_(pa.int64()))], names=["field", "rid", "node", "n", "elements"])
    s = MarkovClusters.similar
    blobs = pa.Table.from_batches(_poster(s, SimpleNamespace(value=np.zeros(BUCKETS, np.int64)), {0: 1}, {0: 2})(iter([batch]))).combine_chunks().to_batches()
    tracemalloc.start()
    try:
        found = [x for out in similarity._tiles(s)(iter(blobs)) for x in zip(*(c.to_pylist() for c in out.columns))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = components(found, range(len(copies)))
    own = [set(x) for x in sets]
    want = components([(a, b) for a in range(len(own)) for b in range(a) if 5 * len(own[a] & own[b]) >= 3 * len(own[a] | own[b])], range(len(own)))
    assert [want[k % len(sets)] for k in range(len(copies))] == [got[k] for k in range(len(copies))]
    assert peak < 60 << 20, peak


def test_result_does_not_depend_on_partitions(spark):
    rows = made_texts(11, 20, 6, 20, 4, 30)
    one = MarkovClusters(spark.createDataFrame(rows, SCHEMA).coalesce(1)).rows().collect()
    many = MarkovClusters(spark.createDataFrame(rows, SCHEMA).repartition(7)).rows().collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
