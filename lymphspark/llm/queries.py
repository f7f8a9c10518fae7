"""Queries of the training-data problems, with production parameters, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.functions.words import letter_words
from lymphspark.llm.distinctive import outstanding, score_terms
from lymphspark.llm.markov import MarkovClusters
from lymphspark.llm.mixing import Mixture
from lymphspark.llm.near_duplicates import NearDuplicates
from lymphspark.llm.sampling import TargetSample
from lymphspark.llm.term_counts import count_terms, mark_terms, term_pairs
from lymphspark.llm.tokenizer import encode, token_counts
from lymphspark.llm.truncation import Truncation
from lymphspark.operators.packed_values import split_values
from lymphspark.queries.general import SQL_VALUES
from lymphspark.session import table

ARXIV, FILTERED, COVID, NEWS = "arxiv_cleansed_data", "arxiv_filtered_cleansed_data", "covid_cleansed_data", "newspopularity_cleansed_train_file"
DRUGS, TWEETS, PITCHFORK, WELFAKE = "drugreviews_cleansed_train_data", "tweets_cleansed_mapped_data", "pitchfork_cleansed_data", "welfake_cleansed_data"


def _texts(spark: SparkSession, folder: str, fields: dict[str, str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, folder, t).select(F.lit(k).alias("field"), "row_id", F.col(f).alias("text")) for k, (t, f) in enumerate(fields.items())])


def _named(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The number of the field replaced by its name."""
    names = F.array(*[F.lit(f) for f in fields.values()])
    return df.withColumn("field_name", F.get(names, F.col("field"))).drop("field")


# 1: sample matching target category proportions


def _target_sample(spark: SparkSession, folder: str) -> TargetSample:
    year = lambda c: F.year(c)
    tables = {
        FILTERED: (table(spark, folder, FILTERED), "paper_id", year("loaded_at")),
        COVID: (table(spark, folder, COVID), "article_id", year("published_at")),
        DRUGS: (table(spark, folder, DRUGS), "review_id", year("reviewed_at")),
        TWEETS: (table(spark, folder, TWEETS), "tweet_id", year("posted_at")),
    }
    return TargetSample(tables, table(spark, folder, "sample_targets"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _target_sample(spark, folder).report().filter("not is_met").select("target_set", "category_value")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return _target_sample(spark, folder).report()


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _target_sample(spark, folder).sample()


# 4: grouping records into similarity clusters

_P4 = {FILTERED: "abstracts", PITCHFORK: "review", TWEETS: "tweet"}


def _clusters(spark: SparkSession, folder: str) -> MarkovClusters:
    return MarkovClusters(_texts(spark, folder, _P4))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clusters(spark, folder).rows().filter("group_rows >= 3")
    return _named(rows, _P4).select("field_name", "row_id", F.col("group_row").alias("cluster_row_id"))


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _named(_clusters(spark, folder).rows(), _P4)


def p4_typical(spark: SparkSession, folder: str) -> DataFrame:
    return _named(_clusters(spark, folder).typical(), _P4)


# 5 and 6: distinctive terms, and the frequency of every term


def _words(spark: SparkSession, folder: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Pairs of word and row of each field, and the number of all rows of its table."""
    pairs, totals = [], []
    for name, field in fields.items():
        df = table(spark, folder, name)
        pairs.append(term_pairs(df, "row_id", letter_words(F.col(field)), field))
        totals.append(df.select(F.lit(field).alias("field_name")).groupBy("field_name").agg(F.count("*").alias("all_rows")))
    return reduce(DataFrame.unionByName, pairs), reduce(DataFrame.unionByName, totals)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_terms(*_words(spark, folder, {FILTERED: "abstracts", NEWS: "headline", COVID: "content"})).withColumnRenamed("record", "row_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return outstanding(_scores(spark, folder), {"headline": 2}).select("field_name", "row_id", "term")


def p5_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).select("field_name", "row_id", "term", "n", "occurrences", "n_rows", F.round("score", 6).alias("score"))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    pairs, totals = _words(spark, folder, {FILTERED: "abstracts", PITCHFORK: "review"})
    arxiv = table(spark, folder, ARXIV)
    values = split_values(arxiv, "row_id", ["terms"])
    terms = values.select("field_name", F.lower("term").alias("term"), F.col("row_id").alias("record"), F.lit(1).cast("long").alias("n"))
    total = arxiv.select(F.lit("terms").alias("field_name")).groupBy("field_name").agg(F.count("*").alias("all_rows"))
    return mark_terms(count_terms(pairs.unionByName(terms)), totals.unionByName(total))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).filter("mark is not null").select("field_name", "term", "mark")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).select("field_name", "term", "occurrences", "n_rows")


# 7: near-duplicate records with small edits

_P7 = {COVID: "content", WELFAKE: "text"}


def _near_duplicates(spark: SparkSession, folder: str) -> NearDuplicates:
    return NearDuplicates(_texts(spark, folder, _P7), run=3, num=1, den=2)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _named(_near_duplicates(spark, folder).row_pairs(), _P7).select("field_name", "row_a", "row_b")


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _named(_near_duplicates(spark, folder).groups(), _P7)


# 8 and 9: encoding with a public tokenizer, and mixing by its tokens


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    sizes = token_counts(table(spark, folder, "documents").select("doc_id", "source", "text"), "text")
    return Mixture(sizes, table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report().filter("not is_met").select("mix_name", "source")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report()


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).documents()


# 10: text cut off by field limits


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return Truncation(table(spark, folder, "documents")).found()


def p10_judged(spark: SparkSession, folder: str) -> DataFrame:
    return Truncation(table(spark, folder, "documents")).judged()


def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    return Truncation(table(spark, folder, "documents")).by_source()


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p4_found, p4_clusters, p4_typical, p5_found, p5_scores, p6_found, p6_counts, p7_found, p7_groups, p8_ids, p9_found, p9_report, p9_documents, p10_found, p10_judged, p10_sources)}


def _sql_words(field: str) -> str:
    return rf"regexp_extract_all(lower({field}), '\p{{L}}+')"


def _sql_pairs(fields: dict[str, str]) -> str:
    each = [f"SELECT '{f}' AS field_name, row_id, unnest({_sql_words(f)}) AS term FROM {t} WHERE {f} IS NOT NULL" for t, f in fields.items()]
    return " UNION ALL ".join(each)


def _sql_totals(fields: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS field_name, count(*) AS all_rows FROM {t}" for t, f in fields.items())


_SQL_P4 = " UNION ALL ".join(f"SELECT '{f}' AS field_name, row_id, list_distinct({_sql_words(f)}) AS ws FROM {t} WHERE {f} IS NOT NULL" for t, f in _P4.items())
_P5 = {FILTERED: "abstracts", NEWS: "headline", COVID: "content"}
_P5_SQL = f"""
WITH word AS ({_sql_pairs(_P5)}),
tf AS (SELECT field_name, row_id, term, count(*) AS n FROM word GROUP BY ALL),
stat AS (SELECT field_name, term, cast(sum(n) AS BIGINT) AS occurrences, count(*) AS n_rows FROM tf GROUP BY ALL),
total AS ({_sql_totals(_P5)})
"""
_P6 = {FILTERED: "abstracts", PITCHFORK: "review"}
_P6_SQL = f"""
WITH word AS ({_sql_pairs(_P6)} UNION ALL
  SELECT 'terms', row_id, lower(unnest({SQL_VALUES})) FROM (SELECT row_id, terms AS x FROM {ARXIV}) WHERE x IS NOT NULL),
stat AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT row_id) AS n_rows FROM word GROUP BY ALL),
total AS ({_sql_totals(_P6)} UNION ALL SELECT 'terms', count(*) FROM {ARXIV})
"""
_SQL_RUNS = " UNION ALL ".join(
    rf"""SELECT '{f}' AS field_name, row_id, list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS runs
    FROM (SELECT row_id, regexp_extract_all(lower({f}), '[\p{{L}}\p{{N}}]+') AS w FROM {t}) WHERE len(w) >= 3"""
    for t, f in _P7.items()
)
_P1_KEYS = {FILTERED: ("major_terms", "paper_id"), COVID: ("category", "article_id"), DRUGS: ("rating", "review_id"), TWEETS: ('"5_truthfulness"', "tweet_id")}

ORACLES = {
    "p1_found": "WITH record AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{f.strip(chr(34))}' AS field_name, lower(trim({f}, E' \\t\\r\\n')) AS category_value, count(DISTINCT {k}) AS n FROM {t} GROUP BY 3" for t, (f, k) in _P1_KEYS.items())
    + ") SELECT target_set, category_value FROM sample_targets LEFT JOIN record USING (table_name, field_name, category_value) WHERE coalesce(n, 0) < target_share * sample_size OR coalesce(n, 0) < min_rows",
    "p5_found": _P5_SQL + "SELECT field_name, row_id, term FROM tf JOIN stat USING (field_name, term) WHERE n >= CASE WHEN field_name = 'headline' THEN 2 ELSE 3 END AND n_rows BETWEEN 2 AND 10",
    "p5_scores": _P5_SQL
    + "SELECT field_name, row_id, term, n, occurrences, n_rows, round(n * (-log2(n_rows / all_rows) + log2(1 - exp(-occurrences / all_rows))), 6) AS score FROM tf JOIN stat USING (field_name, term) JOIN total USING (field_name)",
    "p6_found": _P6_SQL
    + "SELECT field_name, term, CASE WHEN n_rows < 3 THEN 'rare' ELSE 'common' END AS mark FROM stat JOIN total USING (field_name) WHERE n_rows < 3 OR n_rows > 0.3::DOUBLE * all_rows",
    # Every similar pair by its shared words, then the least row that is reached from each row.
    "p4_found": f"""
WITH RECURSIVE sets AS ({_SQL_P4}),
item AS (SELECT field_name, row_id, len(ws) AS n, unnest(ws) AS w FROM sets),
pair AS (SELECT a.field_name, a.row_id AS x, b.row_id AS y, count(*) AS o, any_value(a.n + b.n) AS n
  FROM item a JOIN item b ON a.field_name = b.field_name AND a.w = b.w AND a.row_id < b.row_id AND a.n * 5 >= b.n * 3 AND b.n * 5 >= a.n * 3 GROUP BY ALL),
edge AS (SELECT field_name, x, y FROM pair WHERE 5 * o >= 3 * (n - o)),
arc AS (SELECT * FROM edge UNION ALL SELECT field_name, y, x FROM edge),
reach AS (SELECT field_name, x AS row_id, x AS r FROM arc UNION SELECT field_name, y, y FROM arc
  UNION SELECT reach.field_name, arc.y, reach.r FROM reach JOIN arc ON reach.field_name = arc.field_name AND reach.row_id = arc.x AND reach.r < arc.y),
least AS (SELECT field_name, row_id, min(r) AS cluster_row_id FROM reach GROUP BY ALL)
SELECT field_name, row_id, cluster_row_id FROM least QUALIFY count(*) OVER (PARTITION BY field_name, cluster_row_id) >= 3""",
    "p7_found": f"""
WITH sets AS ({_SQL_RUNS}),
item AS (SELECT field_name, row_id, len(runs) AS n, unnest(runs) AS run FROM sets),
pair AS (SELECT a.field_name, a.row_id AS row_a, b.row_id AS row_b, count(*) AS o, any_value(a.n + b.n) AS n
  FROM item a JOIN item b ON a.field_name = b.field_name AND a.run = b.run AND a.row_id < b.row_id GROUP BY ALL)
SELECT field_name, row_a, row_b FROM pair WHERE 2 * o >= n - o""",
    # Classes of equal sets, their links, and the least row that is reached from each.
    "p7_groups": f"""
WITH RECURSIVE sets AS (SELECT field_name, row_id, list_sort(runs) AS runs FROM ({_SQL_RUNS})),
cls AS (SELECT field_name, runs, min(row_id) AS head, count(*) AS copies FROM sets GROUP BY ALL),
item AS (SELECT field_name, head, len(runs) AS n, unnest(runs) AS run FROM cls),
pair AS (SELECT a.field_name, a.head AS x, b.head AS y, count(*) AS o, any_value(a.n + b.n) AS n
  FROM item a JOIN item b ON a.field_name = b.field_name AND a.run = b.run AND a.head < b.head GROUP BY ALL),
edge AS (SELECT field_name, x, y FROM pair WHERE 2 * o >= n - o),
arc AS (SELECT * FROM edge UNION ALL SELECT field_name, y, x FROM edge),
reach AS (SELECT field_name, x AS head, x AS r FROM arc UNION SELECT reach.field_name, arc.y, reach.r FROM reach JOIN arc ON reach.field_name = arc.field_name AND reach.head = arc.x AND reach.r < arc.y),
least AS (SELECT field_name, head, min(r) AS r FROM reach GROUP BY ALL), degree AS (SELECT field_name, x AS head, count(*) AS n_links FROM arc GROUP BY ALL)
SELECT field_name, row_id, coalesce(r, head) AS group_row_id, coalesce(n_links, 0) AS n_links, copies
FROM sets JOIN cls USING (field_name, runs) LEFT JOIN least USING (field_name, head) LEFT JOIN degree USING (field_name, head)""",
    "p6_counts": _P6_SQL + "SELECT field_name, term, occurrences, n_rows FROM stat",
}
