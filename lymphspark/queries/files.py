"""Readers and writers: tables are written to the shared folder in a source's format and read back by its reader."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.operators.representations import make
from lymphspark.plans.executor import checked, output_name
from lymphspark.queries.text import _TOKENS, NEWS
from lymphspark.session import Stage, table
from lymphspark.sources import files

COVID = "covid_cleansed_data"


def _folder(spark: SparkSession) -> str:
    return Stage(spark, "files").root


def delimited_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, delimiters and line breaks in them, and a label, by name."""
    out = _folder(spark)
    rows = table(spark, folder, COVID).select(F.col("row_id").cast("string").alias("row_id"), "title", "content", "category")
    files.write_rows(rows.filter("content <> '' and category <> ''"), out)
    return files.read_delimited(spark, out, "content", ["category", "row_id"]).select("row_id", F.md5("content").alias("content"), F.trim("category").alias("category"))


def unbroken_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A file without line breaks in its fields, which is split among tasks."""
    out = _folder(spark)
    files.write_rows(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), out)
    return files.read_delimited(spark, out, line_breaks=False).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


def points_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A numeric file parted by semicolons: name, whole numbers, label."""
    out = _folder(spark)
    rows = table(spark, folder, "nation").select("n_name", "n_nationkey", (F.col("n_nationkey") * F.col("n_nationkey")).alias("square"), "n_regionkey")
    rows.write.options(header=True, sep=";").csv(out)
    return files.read_points(spark, out).select(F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"), "label")


def lines_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = _folder(spark)
    table(spark, folder, "part").select(F.col("p_name").alias("value")).coalesce(1).write.text(out)
    return files.read_lines(spark, out).groupBy("line").agg(F.count("*").alias("cnt"))


def plan_source(spark: SparkSession, folder: str) -> DataFrame:
    """A plan file's plans, checked, with the defaults filled in and the name of their output."""
    plan = {
        "dataset_path": "/data/Sets/News/train.csv", "text_column": "content", "label_columns": ["category"], "model_params": {"distance_method": "cosine"},
        "fit_params": {"number_of_antibodies": 500, "no_best_cells_taken_each_selection": 15, "clone_multiplier": 10, "pruning_threshold": 0.5, "percent_clones_reselected": 0.1}, "representation_models": [{"ngram": {}}],
    }
    out = _folder(spark)
    spark.createDataFrame([(json.dumps({"executions_plans": [plan, plan | {"file_output_name": "mine"}]}),)], "value string").coalesce(1).write.text(out)
    told = [checked(p) for p in files.read_plans(out, spark)]
    rows = [(k, output_name(p, datetime(2020, 1, 2, 3, 4, 5)), p["fit"].number_of_antibodies, p["fit"].max_iter, p["predict"][0].mst_pruning_type, p["default_executions"]) for k, p in enumerate(told)]
    return spark.createDataFrame(rows, "k int, name string, antibodies int, max_iter int, pruning string, executions int")


def sample_sink(spark: SparkSession, folder: str) -> DataFrame:
    """A sample written as one file, all fields quoted, and read again."""
    out = _folder(spark)
    files.write_sample(table(spark, folder, NEWS).filter("row_id % 7 = 0 and headline is not null and trim(headline) <> ''").select("row_id", "headline"), out, quote_all=True)
    return files.read_delimited(spark, out).select(F.col("row_id").cast("long").alias("row_id"), "headline")


def representation_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """A representation by its name, dense: the number of columns and the counts in them."""
    texts = table(spark, folder, NEWS).select("row_id", F.col("headline").alias("text"))
    dense = make("NGram", low=1, high=1, kind="count").fit(texts).vectors(texts)
    return dense.select(F.col("id").alias("row_id"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("long").alias("tokens"))


QUERIES = {f.__name__: f for f in (delimited_scan, unbroken_scan, points_scan, lines_scan, plan_source, sample_sink, representation_dispatch)}
ORACLES = {
    "delimited_scan": f"SELECT row_id::VARCHAR AS row_id, md5(content) AS content, trim(category, ' ') AS category FROM {COVID} WHERE content <> '' AND category <> ''",
    "unbroken_scan": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "points_scan": "SELECT n_nationkey::DOUBLE AS x, (n_nationkey * n_nationkey)::DOUBLE AS y, n_regionkey::VARCHAR AS label FROM nation",
    "lines_scan": "SELECT p_name AS line, count(*) AS cnt FROM part GROUP BY 1",
    "plan_source": "SELECT * FROM (VALUES (0, 'Sets_News_train_20200102_030405', 500, 100, 'threshold', 1), (1, 'mine_20200102_030405', 500, 100, 'threshold', 1)) AS p(k, name, antibodies, max_iter, pruning, executions)",
    "representation_dispatch": f"WITH tok AS ({_TOKENS}) SELECT row_id, coalesce(len(t), 0) AS tokens FROM {NEWS} LEFT JOIN tok USING (row_id)",
    "sample_sink": f"SELECT row_id, headline FROM {NEWS} WHERE row_id % 7 = 0 AND trim(headline) <> ''",
}
