import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lymphspark.functions.numbers import hash_uniform, round_half_even
from lymphspark.operators import graph, lexicon, metrics, negative, network, tabular, vectors
from lymphspark.operators.network import FitParams, ImmuneNetwork, PredictParams, clone_counts, mature
from lymphspark.operators.quota import random_key, take_quotas
from lymphspark.streaming.score import score_stream


def frame(spark, rows, labels=None):
    return spark.createDataFrame([(k, [float(x) for x in v], (labels[k] if labels else 0)) for k, v in enumerate(rows)], "id long, v array<double>, label int")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.02, (30, 2)) for c in ((0.2, 0.2), (0.8, 0.3), (0.5, 0.9))]).clip(0, 1)
    return points, [k // 30 for k in range(90)], frame(spark, points, [k // 30 for k in range(90)])


def test_distances():
    assert vectors.distances(np.array([0.0, 0.0]), np.array([[1.0, 0.0]]), "cosine").tolist() == [[1.0]]
    a = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert vectors.distances(a, a[::-1], "cosine").tolist() == [[1.0, 0.0], [0.0, 1.0]]
    assert vectors.distances(np.zeros((0, 2)), a, "euclidean").shape == (0, 2)
    with pytest.raises(ValueError):
        vectors.distances(a, a, "chebyshev")


def test_suppression_keeps_the_last_of_a_chain(spark):
    df = frame(spark, [[0.0], [0.05], [0.10]])
    assert [r.id for r in vectors.suppress(df, "euclidean", 0.06).collect()] == [2]
    assert vectors.suppress(df.limit(0), "euclidean", 0.06).collect() == []


def test_blocks_do_not_change_results(spark, blobs):
    points, _, df = blobs
    want = [(i, j) for i in range(90) for j in range(i + 1, 90)]
    kernel = lambda x, y, d, same: pd.DataFrame({"n": [int(np.triu(np.ones_like(d), 1).sum()) if same else d.size]})
    parts = vectors.over_blocks(df, None, kernel, "n long", "euclidean", block=16).agg(F.sum("n")).head()[0]
    assert parts == len(want)
    got = {(r.i, r.j): r.d for r in vectors.pairs(df, "euclidean").collect()}
    assert set(got) == set(want) and all(abs(got[i, j] - np.linalg.norm(points[i] - points[j])) < 1e-9 for i, j in want)
    near = {(r.id, r.rk): r.target for r in vectors.nearest(df.filter("id < 5"), df.filter("id >= 5"), "euclidean", 3).collect()}
    for i in range(5):
        order = sorted(range(5, 90), key=lambda j: (round(np.linalg.norm(points[i] - points[j]), 9), j))
        assert [near[i, k] for k in (1, 2, 3)] == order[:3]


def test_measures(spark, blobs):
    points, labels, df = blobs
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    labels = np.array(labels)
    links = metrics.cluster_links(df, "euclidean").persist()
    diam = max(d[np.ix_(labels == c, labels == c)].max() for c in range(3))
    mean = {(a, b): d[np.ix_(labels == a, labels == b)].mean() for a in range(3) for b in range(3) if a != b}
    assert metrics.dunn(links).head()[0] == pytest.approx(min(mean.values()) / diam, abs=1e-6)
    sil = []
    for i in range(90):
        a = d[i][labels == labels[i]].sum() / 29
        b = min(d[i][labels == c].mean() for c in range(3) if c != labels[i])
        sil.append((b - a) / max(a, b))
    assert metrics.silhouette(df, "euclidean").head()[0] == pytest.approx(np.mean(sil), abs=1e-6)
    one = frame(spark, points[:5])
    single = metrics.cluster_links(one, "euclidean")
    assert metrics.dunn(single).head()[0] > 1e300 and metrics.davies_bouldin(single).head()[0] is None
    assert metrics.silhouette(frame(spark, [[0.0], [1.0], [5.0]], [0, 0, 1]), "euclidean").head()[0] == pytest.approx((4 / 5 + 3 / 4 + 0) / 3)


def test_own_labels_as_prediction(spark, blobs):
    _, _, df = blobs
    cells = metrics.contingency(df, F.col("label"), F.col("label"))
    assert all(metrics.nmi(cells, a).head()[0] == pytest.approx(1) for a in ("arithmetic", "geometric", "max"))
    assert metrics.ami(cells) == pytest.approx(1) and metrics.accuracy(df, F.col("v"), F.col("label"), F.col("label")).head()[0] == 1
    renamed = metrics.contingency(df, F.col("label"), F.col("label") + 7)
    assert metrics.ami(renamed) == pytest.approx(1)
    flat = metrics.contingency(df, F.lit(1), F.lit(2))
    assert metrics.nmi(flat, "max").head()[0] == 1


def test_zero_distance_votes(spark):
    rows = [([1.0], "a", 0), ([1.0], "b", 0), ([1.0], "b", 1), ([2.0], "c", 1), ([2.0], "a", 1)]
    df = spark.createDataFrame(rows, "v array<double>, t string, p int")
    got = dict(metrics.map_predictions(df, F.col("v"), F.col("t"), F.col("p")).collect())
    votes = {p: {} for p in (0, 1)}
    for v, _, p in rows:
        for w, t, _ in rows:
            if v == w:
                votes[p][t] = votes[p].get(t, 0) + 1
    assert got == {p: min(x, key=lambda t: (-x[t], t)) for p, x in votes.items()}


def test_component_numbers(spark):
    nodes = spark.range(6).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(1, 2), (4, 5)], "u long, v long")
    assert dict(graph.component_labels(nodes, edges).collect()) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert dict(graph.component_labels(nodes, edges, True).collect()) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}


def test_pruning(spark):
    path = spark.createDataFrame([(0, 1, 1.0), (1, 2, 9.0), (2, 3, 1.0)], "u long, v long, w double")
    assert [tuple(r) for r in graph.prune(path, "threshold", 0.5).collect()] == [(1, 2, 9.0)]
    assert graph.prune(path, "threshold", 1.0).collect() == []
    assert [tuple(r) for r in graph.prune(path, "average", k=1.0).collect()] == [(1, 2, 9.0)]
    with pytest.raises(ValueError):
        graph.prune(path, "other")


def test_spanning_forest_equals_prim(spark, blobs):
    points, _, df = blobs
    d = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)), 9)
    inside, total = {0}, 0.0
    while len(inside) < 90:
        w, j = min((d[i, j], j) for i in inside for j in range(90) if j not in inside)
        inside.add(j)
        total += w
    edges = graph.spanning_forest(df, "euclidean", block=32).collect()
    assert len(edges) == 89 and sum(e.w for e in edges) == pytest.approx(total)
    twins = graph.spanning_forest(frame(spark, [[0.0], [0.0]]), "euclidean")
    assert twins.collect() == []


def test_agglomeration(spark, blobs):
    points, labels, df = blobs
    clusters, merges = graph.agglomerate(df, "euclidean", 0.3)
    assert dict(clusters.collect()) == {k: 30 * labels[k] for k in range(90)} and merges.count() == 87
    path = graph.agglomerate(frame(spark, [[0.0], [1.0], [0.1]]), "euclidean", 0.5, spark.createDataFrame([(0, 1), (1, 2)], "u long, v long"))
    assert path[1].collect() == []
    assert graph.agglomerate(df.limit(0), "cosine", 1.0)[0].collect() == []


def test_clone_counts_are_half_even_and_never_negative(spark):
    ag, ab = frame(spark, [[0.0, 0.0]]), frame(spark, [[0.25, 0.0], [0.35, 0.0], [0.0, 1.4]])
    got = {r.ab: r.clones for r in clone_counts(ag, ab, "euclidean", 3, 10).collect()}
    assert got == {0: 8, 1: 6, 2: 0}


def test_network_finds_blobs_on_any_partitioning(spark, blobs):
    _, labels, df = blobs
    p = FitParams(40, 4, 5, 0.8, 0.2, 0.012, max_iter=3)
    net = ImmuneNetwork(spark, 7).fit(df, p)
    other = ImmuneNetwork(spark, 7).fit(df.repartition(8), p)
    assert np.allclose(net.population, other.population) and len(net.history) >= 1
    pred = net.predict(df, PredictParams(mst_pruning_type="average", k=0.5))
    assert pred.count() == 90
    joined = pred.join(df, "id").select("id", "v", F.col("cluster").cast("int").alias("p"), "label")
    assert metrics.accuracy(joined, F.col("v"), F.col("label"), F.col("p")).head()[0] == 1.0
    scored = dict(score_stream(df, net, PredictParams(mst_pruning_type="average", k=0.5)).collect())
    assert scored == dict(pred.collect())


def test_network_saves_and_loads(spark, blobs, tmp_path):
    _, _, df = blobs
    net = ImmuneNetwork(spark, 7).fit(df, FitParams(20, 3, 5, 0.8, 0.2, 0.08, max_iter=1))
    net.save(str(tmp_path / "m"))
    back = ImmuneNetwork.load(spark, str(tmp_path / "m"))
    assert np.allclose(back.population, net.population) and back.params == net.params and back.history == net.history


def test_extinction_and_bad_input(spark, blobs):
    _, _, df = blobs
    net = ImmuneNetwork(spark, 7).fit(df, FitParams(5, 2, 5, 0.0, 0.2, max_iter=3))
    assert len(net.population) == 0 and {r.cluster for r in net.predict(df).collect()} == {-1} and net.history[-1][2] == 0
    with pytest.raises(ValueError):
        ImmuneNetwork(spark, 7).fit(frame(spark, [[2.0]]), FitParams(5, 2, 5, 0.5, 0.2))
    with pytest.raises(ValueError):
        ImmuneNetwork(spark, 7, "Manhattan")
    assert ImmuneNetwork(spark, 7, "Euclidean").distance_method == "euclidean"
    assert len(ImmuneNetwork(spark, 7).fit(df.limit(0), FitParams(5, 2, 5, 0.5, 0.2)).population) == 0


def test_maturation_moves_towards_the_antigen():
    p = FitParams(5, 2, 10, 1.0, 1.0, 0.0)
    got, best = mature(np.array([0.5, 0.5]), 1.0, np.array([[0.1, 0.1], [0.9, 0.9]]), p, "euclidean", np.random.default_rng(1))
    assert len(got) == 8 and 0 <= best < np.hypot(0.4, 0.4)


def test_negative_selection(spark):
    rng = np.random.default_rng(5)
    rows = [np.r_[1, 0, 0, 0] + rng.normal(0, 0.1, 4) for _ in range(40)] + [np.r_[0, 0, 1, 1] + rng.normal(0, 0.1, 4) for _ in range(40)]
    df = frame(spark, rows, [k // 40 for k in range(80)])
    p = negative.NegativeParams(number_of_detectors=30, fit_threshold=0.8, crossover_points=2)
    model = negative.NegativeSelection(p).fit(df)
    assert model.detectors.count() == 30
    own = df.filter("label = 1").select("id", "v")
    assert negative.matched(own, model.detectors, 0.8).collect() == []
    pred = model.predict(df).join(df, "id").groupBy("label").agg(F.avg("pred").alias("p")).collect()
    share = {r.label: r.p for r in pred}
    assert share[1] == 1.0 and share[0] < 1.0


def test_detectors_are_made_until_there_are_enough(spark):
    """Rows of class 1 leave free about one direction in a hundred."""
    angles = np.radians(np.linspace(0, 294, 30))
    rows = [[0.0, 0.0]] * 3 + [[np.cos(a), np.sin(a)] for a in angles]
    df = frame(spark, rows, [0] * 3 + [1] * 30)
    p = negative.NegativeParams(number_of_detectors=5, fit_threshold=0.85, crossover_points=1.5)
    model = negative.NegativeSelection(p).fit(df)
    assert model.detectors.count() == 5 and negative.matched(df.filter("label = 1"), model.detectors, 0.85).collect() == []
    with pytest.raises(RuntimeError):
        negative.NegativeSelection(p).fit(df, most_batches=1)
    with pytest.raises(ValueError):
        negative.NegativeSelection(p).fit(df.filter("label = 1"))


def test_parents_come_from_all_rows(spark):
    """Over 4,096 rows in each class: a parent's place is counted over them all."""
    df = spark.range(11000).select("id", F.array(F.col("id") * 1000.0, F.col("id") * 1000.0).alias("v"), (F.col("id") >= 6000).cast("int").alias("label"))
    got = {r.id: [round(x / 1000) for x in r.v] for r in negative.candidates(df, 0, 40, 2, negative.NegativeParams(crossover_points=1.5)).collect()}
    keys = sorted((r.u, r.id) for r in df.select("id", hash_uniform(777, F.lit("pool"), "id").alias("u")).collect())
    pools = {"a": [i for _, i in keys if i < 6000], "b": [i for _, i in keys if i >= 6000]}
    want = {k: {r.id: pool[int(r.u * len(pool))] for r in spark.range(40).select("id", hash_uniform(777, F.lit(k), "id").alias("u")).collect()} for k, pool in pools.items()}
    assert len(got) == 40 and all(v[0] == want["a"][k] and v[1] in (want["a"][k], want["b"][k]) for k, v in got.items())
    assert any(v[1] == want["b"][k] for k, v in got.items())


def test_lexicon(spark):
    names, patterns = lexicon.parse_dictionary("%\n1\tcatA\n2\tcatB\n%\nhapp*\t1\nhappen\t2\nthe\t2\nthe\t1\n")
    assert patterns == {"happ*": ["catA"], "happen": ["catB"], "the": ["catA"]}
    tokens = spark.createDataFrame([(t,) for t in ("happen", "happy", "hap", "the", "then", None)], "token string")
    got = {r.token: r.categories for r in lexicon.match_lexicon(tokens, lexicon.lexicon_frame(spark, patterns)).collect()}
    assert got == {"happen": ["catA"], "happy": ["catA"], "the": ["catA"]}
    with pytest.raises(KeyError):
        lexicon.parse_dictionary("%\n1\ta\n%\nx\t9\n")


def test_tabular(spark):
    df = spark.createDataFrame([(k, ["a", "b", None][k % 3]) for k in range(100)], "id long, label string")
    got = tabular.stratified_sample(df, "id", "label", 0.1, 1).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"a": 3, "b": 3, None: 3}
    assert {r.column_name: r.nulls for r in tabular.null_audit(df, df.columns).collect()} == {"id": 0, "label": 33}
    flat = tabular.min_max(frame(spark, [[1.0, 5.0], [3.0, 5.0]]), "v").orderBy("id").collect()
    assert [r.v for r in flat] == [[0.0, 0.0], [1.0, 0.0]]
    assert [r[0] for r in spark.createDataFrame([(2.5,), (7.5,)], "x double").select(round_half_even(F.col("x"))).collect()] == [2.0, 8.0]
    assert spark.range(1).select(hash_uniform(777, 1, 2, 3)).head()[0] == pytest.approx(0.30336586192611037)


def test_quotas_are_exact_in_a_hot_cell(spark):
    rows = spark.range(20000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id < 10 THEN 'few' END AS c")
    quotas = spark.createDataFrame([("hot", 1234), ("few", 100), (None, 7), ("none", 5)], "c string, quota long")
    got = take_quotas(rows, ["c"], random_key(3, "id"), ["id"], quotas)
    few = rows.filter("c = 'few'").count()
    assert {r.c: r["count"] for r in got.groupBy("c").count().collect()} == {"hot": 1234, "few": few, None: 7}
    again = take_quotas(rows.repartition(7), ["c"], random_key(3, "id"), ["id"], quotas)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in again.collect()}
    same = take_quotas(rows, ["c"], F.lit(0.5), ["id"], quotas).filter("c = 'hot'").agg(F.max("id")).head()[0]
    assert same == 3 * 1233


def test_every_antigen_has_a_rate_whatever_the_decay(spark):
    got = [r.rate for r in network.rates(spark.range(3000), 1, 1, 4.0, 0.9999).orderBy("rate", ascending=False).collect()]
    assert got == pytest.approx([4.0 * 0.9999**k for k in range(3000)]) and len(network.rates(spark.range(0), 1, 1, 4.0).collect()) == 0
    again = {r.id: r.rate for r in network.rates(spark.range(3000).repartition(7), 1, 1, 4.0, 0.9999).collect()}
    assert again == {r.id: r.rate for r in network.rates(spark.range(3000), 1, 1, 4.0, 0.9999).collect()}


def test_antibodies_are_recorded_and_detectors_saved(spark, blobs, tmp_path):
    p = network.FitParams(number_of_antibodies=10, no_best_cells_taken_each_selection=2, clone_multiplier=5, pruning_threshold=0.5, percent_clones_reselected=0.5, suppression_threshold=0.05, max_iter=2, record_antibody_history=True)
    net = network.ImmuneNetwork(spark, 3).fit(blobs[2], p)
    assert len(net.antibody_history) == len(net.history) and np.array_equal(net.antibody_history[-1], net.population)
    n = len(net.population)
    assert net.antibody_distances().count() == n * (n - 1) // 2 and net.recorded().filter("iter = 1").count() == net.history[0][1]
    rows = spark.createDataFrame([(k, [float(k % 3), 1.0, float(k % 5)], k % 2) for k in range(40)], "id long, v array<double>, label int")
    model = negative.NegativeSelection(negative.NegativeParams(number_of_detectors=3, fit_threshold=0.999)).fit(rows)
    model.save(str(tmp_path / "n"))
    back = negative.NegativeSelection.load(spark, str(tmp_path / "n"))
    assert back.p == model.p and sorted(back.predict(rows).collect()) == sorted(model.predict(rows).collect())


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_few_targets_are_found_as_many_are(spark, metric, monkeypatch):
    rng = np.random.default_rng(3)
    frame = lambda n: spark.createDataFrame([(k, [round(float(x), 1) for x in rng.random(3)]) for k in range(n)], "id long, v array<double>")
    queries, targets = frame(90), frame(40)
    few = sorted(vectors.nearest(queries, targets, metric, 5).collect())
    assert vectors.nearest(queries, targets.limit(0), metric, 5).collect() == []
    monkeypatch.setattr(vectors, "SMALL", 10)
    assert few == sorted(vectors.nearest(queries, targets, metric, 5).collect()) and len(few) == 450


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_measures_pair_no_copies(spark, monkeypatch, metric):
    """Copies weigh what they are, also those of the zero vector, and no pair of them is made."""
    base = [(0, [0.0, 0.0]), (0, [1.0, 0.5]), (1, [0.2, 0.9]), (1, [0.0, 0.0]), (1, [0.7, 0.1]), (2, [0.4, 0.4])]
    rows = [(10 * k + c, v, label) for k, (label, v) in enumerate(base) for c in range(k % 3 + 1)]
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    norms = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    d = np.linalg.norm(x[:, None] - x[None], axis=2) if metric == "euclidean" else np.where(norms > 0, 1 - x @ x.T / np.where(norms > 0, norms, 1), 1.0)
    np.fill_diagonal(d, 0)
    seen, blocks = [], metrics.over_blocks
    monkeypatch.setattr(metrics, "over_blocks", lambda a, *rest: seen.append(a.count()) or blocks(a, *rest))
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    for r in metrics.cluster_links(df, metric).collect():
        cell = d[np.ix_(label == r.ci, label == r.cj)]
        assert r.n == cell.size and (r.sum_d, r.min_d, r.max_d) == pytest.approx((cell.sum(), cell.min(), cell.max()), abs=1e-7)
    widths = []
    for k in range(len(rows)):
        own = (label == label[k]).sum() - 1
        a, b = d[k][label == label[k]].sum() / max(own, 1), min(d[k][label == o].mean() for o in set(label.tolist()) - {int(label[k])})
        widths.append((b - a) / max(a, b) if own and max(a, b) > 0 else 0.0)
    assert metrics.silhouette(df, metric).head()[0] == pytest.approx(np.mean(widths), abs=1e-7)
    assert seen == [len(base)] * 2
