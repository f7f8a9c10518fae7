"""Distances and measures over all embeddings, and measures of two labellings of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.operators import metrics as M
from lymphspark.operators import tabular, vectors
from lymphspark.session import table


def scaled(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings, rescaled to [0, 1] by column: ``id``, ``v``, ``label``."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return tabular.min_max(e, "v")


def _pairs(metric: str):
    return lambda spark, folder: vectors.pairs(scaled(spark, folder), metric).select("i", "j", F.round("d", 6).alias("d"))


def knn_topn(spark: SparkSession, folder: str) -> DataFrame:
    e = scaled(spark, folder)
    found = vectors.nearest(e.filter("label >= 5"), e.filter("label < 5"), "cosine", 5)
    return found.select("id", "rk", "target", "d")


def nn_assign(spark: SparkSession, folder: str) -> DataFrame:
    e = scaled(spark, folder)
    near = vectors.nearest(e, e.filter("label = 0"), "cosine", 1)
    return near.select("id", F.col("target").alias("ab"))


def ais_suppress_population(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.suppress(scaled(spark, folder), "cosine", 0.065).select("id")


def cluster_diameter(spark: SparkSession, folder: str) -> DataFrame:
    return M.diameters(M.cluster_links(scaled(spark, folder), "cosine")).select("cluster", "diam")


def cluster_linkage(spark: SparkSession, folder: str) -> DataFrame:
    return M.linkage(M.cluster_links(scaled(spark, folder), "cosine")).select("ci", "cj", F.round("avg_d", 6).alias("avg_d"), "min_d")


def _by_metric(f, single: bool):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        parts = [f(M.cluster_links(scaled(spark, folder), m), single).select(F.lit(m).alias("metric"), F.round("value", 6).alias("value")) for m in vectors.METRICS]
        return tabular.union_all(*parts)

    return run


def _value(f):
    return lambda spark, folder: f(spark, folder).select(F.round("value", 6).alias("value"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return M.contingency(_docs(spark, folder), F.expr("coalesce(source, '')"), F.expr("coalesce(lang, '')"))


def map_pred_to_true(spark: SparkSession, folder: str) -> DataFrame:
    return M.map_predictions(_docs(spark, folder).filter("text is not null"), F.col("text"), F.expr("coalesce(source, '')"), F.expr("coalesce(lang, '')"))


def cluster_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return M.accuracy(_docs(spark, folder).filter("text is not null"), F.col("text"), F.expr("coalesce(source, '')"), F.expr("coalesce(lang, '')"))


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return M.confusion_matrix(table(spark, folder, "embeddings"), F.col("label"), F.expr("cast(vec_id % 7 as int)"))


def ami(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(round(M.ami(_cells(spark, folder)), 6),)], "value double")


QUERIES = {
    "pairwise_euclidean": _pairs("euclidean"),
    "pairwise_cosine": _pairs("cosine"),
    "knn_topn": knn_topn,
    "nn_assign": nn_assign,
    "ais_suppress_population": ais_suppress_population,
    "cluster_diameter": cluster_diameter,
    "cluster_linkage": cluster_linkage,
    "dunn_avg": _by_metric(M.dunn, False),
    "dunn_single": _by_metric(M.dunn, True),
    "davies_bouldin_avg": _by_metric(M.davies_bouldin, False),
    "davies_bouldin_single": _by_metric(M.davies_bouldin, True),
    "davies_bouldin_centroid_euc": _value(lambda s, d: M.davies_bouldin_centroid(scaled(s, d), "euclidean")),
    "davies_bouldin_centroid_cos": _value(lambda s, d: M.davies_bouldin_centroid(scaled(s, d), "cosine")),
    "davies_bouldin_std": _value(lambda s, d: M.davies_bouldin_centroid(scaled(s, d), "euclidean", True)),
    "silhouette_euclidean": _value(lambda s, d: M.silhouette(scaled(s, d), "euclidean")),
    "silhouette_cosine": _value(lambda s, d: M.silhouette(scaled(s, d), "cosine")),
    "nmi_arithmetic": _value(lambda s, d: M.nmi(_cells(s, d), "arithmetic")),
    "nmi_geometric": _value(lambda s, d: M.nmi(_cells(s, d), "geometric")),
    "nmi_max": _value(lambda s, d: M.nmi(_cells(s, d), "max")),
    "ami": ami,
    "map_pred_to_true": map_pred_to_true,
    "cluster_accuracy": _value(cluster_accuracy),
    "confusion_matrix": confusion_matrix,
}

SCALED = """long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
unit AS (SELECT vec_id, label, dim, coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0) AS x FROM long WINDOW w AS (PARTITION BY dim)),
n AS (SELECT vec_id AS id, any_value(label) AS label, list(x ORDER BY dim) AS v FROM unit GROUP BY vec_id)"""
_D = {"cosine": "round(list_cosine_distance(a.v, b.v), 9)", "euclidean": "round(list_distance(a.v, b.v), 9)"}


def _p(metric: str) -> str:
    """Every ordered pair, a row with itself at distance 0."""
    return f"p AS (SELECT a.id AS i, b.id AS j, a.label AS ci, b.label AS cj, CASE WHEN a.id = b.id THEN 0 ELSE {_D[metric]} END AS d FROM n a, n b)"


def _each(sql: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {SCALED}, {_p(m)} {sql.format(m=m)})" for m in vectors.METRICS)


def _dunn(link: str) -> str:
    return _each("SELECT '{m}' AS metric, round((SELECT min(l) FROM (SELECT " + link + " AS l FROM p WHERE ci < cj GROUP BY ci, cj)) / (SELECT max(d) FROM p WHERE ci = cj), 6) AS value")


def _davies(link: str) -> str:
    return _each("SELECT '{m}' AS metric, round(avg(m), 6) AS value FROM (SELECT ci, max((di.m + dj.m) / l) AS m FROM (SELECT ci, cj, " + link + " AS l FROM p WHERE ci <> cj GROUP BY ci, cj) JOIN (SELECT ci, max(d) AS m FROM p WHERE ci = cj GROUP BY ci) di USING (ci) JOIN (SELECT cj, max(d) AS m FROM p WHERE ci = cj GROUP BY cj) dj USING (cj) GROUP BY ci)")


def _centroid(metric: str) -> str:
    f = {"cosine": "list_cosine_distance", "euclidean": "list_distance"}[metric]
    return f"""WITH {SCALED}, c AS (SELECT label, list(x ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS x FROM unit GROUP BY ALL) GROUP BY label),
s AS (SELECT label, any_value(c) AS c, avg({f}(v, c)) AS s FROM n JOIN c USING (label) GROUP BY label)
SELECT round(avg(m), 6) AS value FROM (SELECT max((a.s + b.s) / {f}(a.c, b.c)) AS m FROM s a, s b WHERE a.label <> b.label GROUP BY a.label)"""


def _silhouette(metric: str) -> str:
    return f"""WITH {SCALED}, {_p(metric)}, q AS (SELECT i, ci, cj, sum(d) AS s, count(*) AS k FROM p GROUP BY ALL),
r AS (SELECT i, max(CASE WHEN ci = cj AND k > 1 THEN s / (k - 1) END) AS a, min(CASE WHEN ci <> cj THEN s / k END) AS b FROM q GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS value FROM r"""


def _nmi(mean: str) -> str:
    return f"""WITH c AS (SELECT coalesce(source, '') AS t, coalesce(lang, '') AS p, count(*) AS x FROM documents GROUP BY ALL),
w AS (SELECT x, sum(x) OVER (PARTITION BY t) AS nt, sum(x) OVER (PARTITION BY p) AS np, sum(x) OVER () AS n FROM c),
h AS (SELECT sum(x / n * ln(x * n / (nt * np))) AS mi, sum(-x / n * ln(nt / n)) AS ht, sum(-x / n * ln(np / n)) AS hp FROM w)
SELECT round(mi / {mean}, 6) AS value FROM h"""


_VOTES = """WITH d AS (SELECT text AS v, coalesce(source, '') AS t, coalesce(lang, '') AS pred FROM documents WHERE text IS NOT NULL),
vote AS (SELECT m.pred, r.t, count(*) AS k FROM d m JOIN d r ON m.v = r.v GROUP BY ALL),
best AS (SELECT pred, t AS mapped FROM vote QUALIFY row_number() OVER (PARTITION BY pred ORDER BY k DESC, t) = 1)"""

ORACLES = {
    f"pairwise_{m}": f"WITH {SCALED} SELECT a.id AS i, b.id AS j, round({f}(a.v, b.v), 6) AS d FROM n a JOIN n b ON a.id < b.id" for m, f in (("cosine", "list_cosine_distance"), ("euclidean", "list_distance"))
} | {
    "knn_topn": f"WITH {SCALED}, {_p('cosine')}, r AS (SELECT i AS id, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk, j AS target, d FROM p WHERE ci >= 5 AND cj < 5) SELECT * FROM r WHERE rk <= 5",
    "nn_assign": f"WITH {SCALED}, q AS (SELECT a.id AS i, b.id AS j, {_D['cosine']} AS d FROM n a, n b WHERE b.label = 0) SELECT i AS id, j AS ab FROM q QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1",
    "ais_suppress_population": f"WITH {SCALED}, {_p('cosine')} SELECT id FROM n WHERE id NOT IN (SELECT i FROM p WHERE i < j AND d < 0.065)",
    "cluster_diameter": f"WITH {SCALED}, {_p('cosine')} SELECT ci AS cluster, max(d) AS diam FROM p WHERE ci = cj GROUP BY ci",
    "cluster_linkage": f"WITH {SCALED}, {_p('cosine')} SELECT ci, cj, round(avg(d), 6) AS avg_d, min(d) AS min_d FROM p WHERE ci < cj GROUP BY ci, cj",
    "dunn_avg": _dunn("avg(d)"),
    "dunn_single": _dunn("min(d)"),
    "davies_bouldin_avg": _davies("avg(d)"),
    "davies_bouldin_single": _davies("min(d)"),
    "davies_bouldin_centroid_euc": _centroid("euclidean"),
    "davies_bouldin_centroid_cos": _centroid("cosine"),
    "davies_bouldin_std": _centroid("euclidean"),
    "silhouette_euclidean": _silhouette("euclidean"),
    "silhouette_cosine": _silhouette("cosine"),
    "nmi_arithmetic": _nmi("((ht + hp) / 2)"),
    "nmi_geometric": _nmi("sqrt(ht * hp)"),
    "nmi_max": _nmi("greatest(ht, hp)"),
    # The expectation of the information under fixed margins, by the hypergeometric distribution of each cell.
    "ami": """WITH c AS (SELECT coalesce(source, '') AS t, coalesce(lang, '') AS p, count(*) AS x FROM documents GROUP BY ALL), n AS (SELECT sum(x)::DOUBLE AS n FROM c),
a AS (SELECT t, sum(x)::DOUBLE AS a FROM c GROUP BY t), b AS (SELECT p, sum(x)::DOUBLE AS b FROM c GROUP BY p),
mi AS (SELECT sum(x / n * ln(x * n / (a * b))) AS mi FROM c JOIN a USING (t) JOIN b USING (p), n),
k AS (SELECT a, b, n, unnest(range(greatest(1, a + b - n)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM a, b, n),
e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1::DOUBLE) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS e FROM k),
h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM a) AS ht, (SELECT -sum(b / n * ln(b / n)) FROM b) AS hp FROM n)
SELECT round((mi - e) / ((ht + hp) / 2 - e), 6) AS value FROM mi, e, h""",
    "map_pred_to_true": _VOTES + " SELECT pred, mapped FROM best",
    "cluster_accuracy": _VOTES + " SELECT round(avg(CASE WHEN mapped = t THEN 1 ELSE 0 END), 6) AS value FROM d LEFT JOIN best USING (pred)",
    "confusion_matrix": """WITH c AS (SELECT label AS t, (vec_id % 7)::INTEGER AS p FROM embeddings), l AS (SELECT t AS l FROM c UNION SELECT p FROM c)
SELECT a.l AS t, b.l AS p, (SELECT count(*) FROM c WHERE c.t = a.l AND c.p = b.l) AS cnt FROM l a, l b""",
}
