"""The immune network's steps, spanning forests and negative selection over all embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.operators import graph, negative
from lymphspark.operators import network as N
from lymphspark.queries.measures import SCALED, scaled
from lymphspark.queries.tables import _u

SEED, ANTIBODIES, NEAREST, CLONES, RESELECTED, PRUNED, SUPPRESSED = 777, 50, 3, 5, 0.3, 0.113, 0.05
DIMS = 64


def _antigens(spark, folder):
    return scaled(spark, folder).select("id", "v")


def _antibodies(spark):
    return N.random_antibodies(spark, ANTIBODIES, DIMS, SEED, 0)


def _counts(spark, folder):
    return N.clone_counts(_antigens(spark, folder), _antibodies(spark), "cosine", NEAREST, CLONES)


def ais_clone_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder)


def _clones(spark, folder):
    ag = _antigens(spark, folder)
    return N.mutate(_counts(spark, folder), ag, _antibodies(spark), N.rates(ag, SEED, 1, 4.0), "cosine", SEED, 1)


def ais_mutate(spark: SparkSession, folder: str) -> DataFrame:
    return _clones(spark, folder).select("ag", "ab", "clone", F.round("d", 6).alias("d"), F.round(F.get("v", F.lit(0)), 6).alias("v0"))


def _memory(spark, folder):
    return N.reselect(_clones(spark, folder), RESELECTED)


def ais_reselect(spark: SparkSession, folder: str) -> DataFrame:
    return _memory(spark, folder).select("ag", "ab", "clone", "rk")


def ais_prune(spark: SparkSession, folder: str) -> DataFrame:
    return N.prune(_memory(spark, folder), PRUNED).select("ag", "ab", "clone")


def ais_suppress(spark: SparkSession, folder: str) -> DataFrame:
    return N.suppress_within(N.prune(_memory(spark, folder), PRUNED), "cosine", SUPPRESSED).select("ag", "ab", "clone")


def ais_iteration_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = N.iteration_stats(N.prune(_memory(spark, folder), PRUNED))
    return stats.select("antigens", "memory", F.round("avg_best", 6).alias("avg_best"))


_FIT = N.FitParams(number_of_antibodies=60, no_best_cells_taken_each_selection=4, clone_multiplier=6, pruning_threshold=0.3, percent_clones_reselected=0.2, suppression_threshold=0.05, max_iter=3)


def _fitted(spark, folder):
    return N.ImmuneNetwork(spark, SEED, "cosine").fit(_antigens(spark, folder), _FIT)


def ais_fit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(_fitted(spark, folder).history, "iter int, n_antibodies int, avg_d double")


def ais_predict_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder).predict(_antigens(spark, folder), N.PredictParams(mst_pruning_type="average", k=0.5))


def mst_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.spanning_forest(_antigens(spark, folder), "cosine")


def mst_prune_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return graph.prune(mst_edges(spark, folder), "threshold", 0.052)


def mst_prune_average(spark: SparkSession, folder: str) -> DataFrame:
    return graph.prune(mst_edges(spark, folder), "average", k=0.5)


def component_labels(spark: SparkSession, folder: str) -> DataFrame:
    edges = mst_edges(spark, folder)
    kept = edges.join(graph.prune(edges, "average", k=0.5).select("u", "v"), ["u", "v"], "left_anti")
    return graph.component_labels(_antigens(spark, folder).select(F.col("id").alias("node")), kept)


def agglomerative_merges(spark: SparkSession, folder: str) -> DataFrame:
    """Average linkage along the spanning forest, below a threshold: what a dendrogram shows, with the size of every subtree."""
    ag = _antigens(spark, folder)
    return graph.agglomerate(ag, "cosine", 0.06, graph.spanning_forest(ag, "cosine"))[1].select("a", "b", F.round("d", 6).alias("d"), "size")


def network_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Every row gets the label of its nearest antibody, the antibodies being the rows of the lower classes."""
    ag = scaled(spark, folder)
    net = N.ImmuneNetwork(spark, SEED, "cosine")
    net.population = np.stack([np.array(r.v) for r in ag.filter("label < 5").orderBy("id").select("v").collect()])
    return net.predict(ag.select("id", "v"), N.PredictParams(mst_pruning_type="average", k=0.5))


# negative selection: class 1 are the labels from 5 on

_NEG = negative.NegativeParams(number_of_detectors=40, fit_threshold=0.85)


def _classes(spark, folder):
    return scaled(spark, folder).select("id", "v", (F.col("label") >= 5).cast("int").alias("label"))


def array_crossover(spark: SparkSession, folder: str) -> DataFrame:
    found = negative.candidates(_classes(spark, folder), 0, 40, DIMS, _NEG)
    return found.select("id", F.posexplode("v").alias("dim", "value")).select("id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def negsel_filter_detectors(spark: SparkSession, folder: str) -> DataFrame:
    """Own vectors of class 0 as candidates: those that match no row of class 1."""
    c = _classes(spark, folder)
    return negative.filter_detectors(c.filter("label = 0").select("id", "v"), c.filter("label = 1").select("id", "v"), 0.94).select(F.col("id").alias("det_id"))


def negsel_predict(spark: SparkSession, folder: str) -> DataFrame:
    c = _classes(spark, folder)
    model = negative.NegativeSelection(negative.NegativeParams(fit_threshold=0.94))
    model.detectors = negsel_filter_detectors(spark, folder).select(F.col("det_id").alias("id")).join(c.select("id", "v"), "id")
    return model.predict(c)


def negsel_fit_summary(spark: SparkSession, folder: str) -> DataFrame:
    model = negative.NegativeSelection(_NEG).fit(_classes(spark, folder))
    return model.predict(_classes(spark, folder)).groupBy("pred").agg(F.count("*").alias("cnt"))


_FUNCTIONS = (
    network_predict, ais_clone_counts, ais_mutate, ais_reselect, ais_prune, ais_suppress, ais_iteration_stats, ais_fit_summary, ais_predict_labels, mst_edges, mst_prune_threshold,
    mst_prune_average, component_labels, agglomerative_merges, array_crossover, negsel_filter_detectors, negsel_predict, negsel_fit_summary,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_S = f"'{SEED}'"
_STEPS = f"""{SCALED}, grid AS (SELECT id, dim FROM range({ANTIBODIES}) AS a(id), range({DIMS}) AS d(dim)),
ab AS (SELECT id, list(x ORDER BY dim) AS v FROM (SELECT id, dim, {_u(_S, "'0'", 'id', 'dim')} AS x FROM grid) GROUP BY id),
near AS (SELECT n.id AS ag, ab.id AS ab, round(list_cosine_distance(n.v, ab.v), 9) AS d FROM n, ab QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY d, ab.id) <= {NEAREST}),
counts AS (SELECT ag, ab, d, greatest(round_even({CLONES} - d * {CLONES}, 0), 0)::BIGINT AS clones FROM near),
rate AS (SELECT id AS ag, CASE WHEN pos < 1000 THEN 4.0::DOUBLE * pow(0.9::DOUBLE, pos) ELSE 0 END AS rate FROM (SELECT id, row_number() OVER (ORDER BY {_u(_S, "'1'", 'id')}, id) - 1 AS pos FROM n)),
cell AS (SELECT ag, ab, clone, d, k, a.v[k + 1] AS a, b.v[k + 1] AS b, rate FROM (SELECT ag, ab, d, unnest(range(1, clones + 1)) AS clone FROM counts) c JOIN n a ON a.id = ag JOIN ab b ON b.id = ab JOIN rate USING (ag), range({DIMS}) AS r(k)),
clones AS (SELECT ag, ab, clone, list(x ORDER BY k) AS v FROM (SELECT ag, ab, clone, k, b + {_u(_S, "'1'", 'ag', 'ab', 'clone', 'k')} * d * rate * (a - b) AS x FROM cell) GROUP BY ALL),
mutated AS (SELECT ag, ab, clone, c.v, round(list_cosine_distance(c.v, n.v), 9) AS d FROM clones c JOIN n ON n.id = ag),
memory AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ag ORDER BY d, ab, clone) AS rk, count(*) OVER (PARTITION BY ag) AS k FROM mutated) WHERE rk <= ceil({RESELECTED}::DOUBLE * k)),
pruned AS (SELECT * FROM memory WHERE d <= {PRUNED})"""


def _boruvka(rounds: int = 8) -> str:
    """Rounds of shortest links of all trees, written out: each ends with the trees that its links make."""
    parts = [SCALED, "e AS MATERIALIZED (SELECT a.id AS u, b.id AS v, round(list_cosine_distance(a.v, b.v), 9) AS w FROM n a JOIN n b ON a.id < b.id)", "c0 AS MATERIALIZED (SELECT id AS node, id AS tree FROM n)"]
    for k in range(rounds):
        parts.append(f"x{k} AS MATERIALIZED (SELECT e.u, e.v, e.w, a.tree AS ta, b.tree AS tb FROM e JOIN c{k} a ON a.node = e.u JOIN c{k} b ON b.node = e.v WHERE a.tree <> b.tree AND e.w > 0)")
        parts.append(f"b{k} AS MATERIALIZED (SELECT t, arg_min({{'u': u, 'v': v, 'w': w, 'o': o}}, (w, u, v)) AS m FROM (SELECT u, v, w, ta AS t, tb AS o FROM x{k} UNION ALL SELECT u, v, w, tb, ta FROM x{k}) GROUP BY t)")
        # Of two trees that chose each other the lesser is the root; the others follow their choices.
        parts.append(f"j{k}_0 AS MATERIALIZED (SELECT DISTINCT c.tree AS t, CASE WHEN b.m IS NULL OR (o.m.o = c.tree AND c.tree < b.m.o) THEN c.tree ELSE b.m.o END AS r FROM (SELECT DISTINCT tree FROM c{k}) c LEFT JOIN b{k} b ON b.t = c.tree LEFT JOIN b{k} o ON o.t = b.m.o)")
        jumps = max(2, 9 - k)
        for s in range(jumps):
            parts.append(f"j{k}_{s + 1} AS MATERIALIZED (SELECT a.t, b.r FROM j{k}_{s} a JOIN j{k}_{s} b ON b.t = a.r)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.node, j.r AS tree FROM c{k} c JOIN j{k}_{jumps} j ON j.t = c.tree)")
    union = " UNION ".join(f"SELECT m.u AS u, m.v AS v, m.w AS w FROM b{k}" for k in range(rounds))
    return ", ".join(parts) + f", mst AS MATERIALIZED ({union})"


_OTHERS = """, side AS (SELECT u AS node, u, v, w FROM mst UNION ALL SELECT v, u, v, w FROM mst),
other AS (SELECT m.u, m.v, m.w, s.node, count(*) AS n, avg(o.w) AS mean, stddev_pop(o.w) AS sd FROM mst m JOIN side s ON s.u = m.u AND s.v = m.v JOIN side o ON o.node = s.node AND NOT (o.u = m.u AND o.v = m.v) GROUP BY ALL)"""
_CUT_AVERAGE = "SELECT u, v, w FROM other GROUP BY u, v, w HAVING count(*) = 2 AND bool_and(w > mean + 0.5 * sd)"
_NEGATIVE = """own AS (SELECT id, v FROM n WHERE label >= 5), cand AS (SELECT id, v FROM n WHERE label < 5),
det AS (SELECT id, v FROM cand c WHERE NOT EXISTS (SELECT 1 FROM own o WHERE round_even(list_cosine_similarity(c.v, o.v) * 100, 0) / 100 > 0.94))"""


def _normal(kind: str) -> str:
    u, v = (_u(_S, f"'{kind}'", "id", "dim", f"'{x}'") for x in "uv")
    return f"(sqrt(-2.0 * ln(1.0 - {u})) * cos(2 * 3.141592653589793::DOUBLE * {v}))"


def _parents(kind: str, where: str) -> str:
    return f"pool{kind} AS (SELECT v, row_number() OVER (ORDER BY {_u(_S, repr('pool'), 'id')}, id) - 1 AS place, count(*) OVER () AS k FROM n WHERE {where})"


# The antibodies take the place of all rows, by their own numbers; the rows are kept apart.
_FEW = SCALED.replace("n AS (SELECT", "every AS (SELECT") + ", n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, label, v FROM every WHERE label < 5)"
_LABELS = f"""{_OTHERS}, cut AS ({_CUT_AVERAGE}),
kept AS MATERIALIZED (SELECT u, v FROM mst WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.u = mst.u AND cut.v = mst.v)), arc AS MATERIALIZED (SELECT u, v FROM kept UNION ALL SELECT v, u FROM kept),
reach AS (SELECT id AS node, id AS r FROM n UNION SELECT arc.v, reach.r FROM reach JOIN arc ON arc.u = reach.node AND reach.r < arc.v),
root AS (SELECT node, min(r) AS root FROM reach GROUP BY node),
number AS (SELECT root, coalesce(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (ORDER BY root ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS label FROM (SELECT root, count(*) AS k FROM root GROUP BY root))"""

ORACLES = {
    "network_predict": f"""WITH RECURSIVE {_boruvka().replace(SCALED, _FEW)}{_LABELS},
near AS (SELECT q.id, t.id AS target FROM every q, n t QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_distance(q.v, t.v), 9), t.id) = 1)
SELECT near.id, label AS cluster FROM near JOIN root ON node = target JOIN number USING (root)""",
    "ais_clone_counts": f"WITH {_STEPS} SELECT ag, ab, d, clones FROM counts",
    "ais_mutate": f"WITH {_STEPS} SELECT ag, ab, clone, round(d, 6) AS d, round(v[1], 6) AS v0 FROM mutated",
    "ais_reselect": f"WITH {_STEPS} SELECT ag, ab, clone, rk FROM memory",
    "ais_prune": f"WITH {_STEPS} SELECT ag, ab, clone FROM pruned",
    "ais_suppress": f"WITH {_STEPS} SELECT ag, ab, clone FROM pruned p WHERE NOT EXISTS (SELECT 1 FROM pruned o WHERE o.ag = p.ag AND o.rk > p.rk AND round(list_cosine_distance(p.v, o.v), 9) < {SUPPRESSED})",
    "ais_iteration_stats": f"WITH {_STEPS} SELECT count(*) AS antigens, coalesce(sum(k), 0)::BIGINT AS memory, round(coalesce(avg(best), 0), 6) AS avg_best FROM (SELECT ag, min(d) AS best, count(*) AS k FROM pruned GROUP BY ag)",
    "mst_edges": f"WITH {_boruvka()} SELECT u, v, w FROM mst",
    "mst_prune_threshold": f"WITH {_boruvka()}{_OTHERS} SELECT u, v, w FROM other GROUP BY u, v, w HAVING count(*) = 2 AND bool_and(mean > 0.052)",
    "mst_prune_average": f"WITH {_boruvka()}{_OTHERS} {_CUT_AVERAGE}",
    "component_labels": f"""WITH RECURSIVE {_boruvka()}{_OTHERS}, cut AS ({_CUT_AVERAGE}),
kept AS MATERIALIZED (SELECT u, v FROM mst WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.u = mst.u AND cut.v = mst.v)), arc AS MATERIALIZED (SELECT u, v FROM kept UNION ALL SELECT v, u FROM kept),
reach AS (SELECT id AS node, id AS r FROM n UNION SELECT arc.v, reach.r FROM reach JOIN arc ON arc.u = reach.node AND reach.r < arc.v),
root AS (SELECT node, min(r) AS root FROM reach GROUP BY node),
number AS (SELECT root, coalesce(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (ORDER BY root ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS label FROM (SELECT root, count(*) AS k FROM root GROUP BY root))
SELECT node, label FROM root JOIN number USING (root)""",
    "array_crossover": f"""WITH {SCALED}, {_parents('a', 'label < 5')}, {_parents('b', 'label >= 5')}, cand AS (SELECT range AS id FROM range(40)),
cut AS (SELECT id, list(cut) AS cuts FROM (SELECT id, cut FROM cand, range(1, {DIMS + 1}) AS c(cut) QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_u(_S, repr('cut'), 'id', 'cut')}, cut) <= {_NEG.cuts(DIMS)}) GROUP BY id),
pick AS (SELECT id, cuts, a.v AS a, b.v AS b FROM cut JOIN poola a ON a.place = floor({_u(_S, repr('a'), 'id')} * a.k) JOIN poolb b ON b.place = floor({_u(_S, repr('b'), 'id')} * b.k))
SELECT id, dim, round(CASE WHEN len(list_filter(cuts, lambda c: c <= dim)) % 2 = 0 THEN a[dim + 1] + {_normal('a')} ELSE b[dim + 1] + {_normal('b')} END, 6) AS value FROM pick, range({DIMS}) AS d(dim)""",
    "negsel_filter_detectors": f"WITH {SCALED}, {_NEGATIVE} SELECT id AS det_id FROM det",
    "negsel_predict": f"WITH {SCALED}, {_NEGATIVE} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM det WHERE round_even(list_cosine_similarity(det.v, n.v) * 100, 0) / 100 > 0.94) THEN 0 ELSE 1 END::BIGINT AS pred FROM n",
}
