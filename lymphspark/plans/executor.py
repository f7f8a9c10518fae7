"""Runs declarative experiment plans: read, represent, cluster, score, write. A unit that fails leaves the others running."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import fields
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.operators import metrics as M
from lymphspark.operators import tabular
from lymphspark.operators.network import FitParams, ImmuneNetwork, PredictParams
from lymphspark.operators.representations import make
from lymphspark.session import Stage
from lymphspark.sources.files import read_delimited, with_row_id, write_rows

log = logging.getLogger(__name__)

# The measures' names.
INTERNAL = (
    "euclidean_dunn1", "euclidean_dunn2", "cosine_dunn1", "cosine_dunn2", "euclidean_davies_bouldin", "euclidean_davies_bouldin2", "euclidean_davies_bouldin3",
    "sklearn_davies_bouldin", "cosine_davies_bouldin", "cosine_davies_bouldin2", "cosine_davies_bouldin3", "euclidean_silhouette", "cosine_silhouette",
)
EXTERNAL = ("nmi_geometric", "nmi_max", "nmi_arithmetic", "euclidean_cluster_acc", "cosine_cluster_acc")
#: Fixed values, as the names above: the columns of a result row, in order.
COLUMNS = ("representation_name", "label_column", "total_clusters", "representation_shape", *INTERNAL, *EXTERNAL, "fit_params", "predict_params", "representation_params")
SCHEMA = ", ".join(f"{c} {'int' if c == 'total_clusters' else 'double' if c in INTERNAL + EXTERNAL else 'string'}" for c in COLUMNS)
NAN = float("nan")


@contextmanager
def timed(what: str, *names) -> Iterator[None]:
    """Logs how long a step took, also if it failed."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log.info("%s took %.5f second(s)", what % names, time.perf_counter() - began)


def checked(plan: dict) -> dict:
    """The plan with defaults filled in; what is missing or of a wrong kind is an error. One object as ``predict_params`` is
    taken as a list of one."""
    for key in ("text_column", "label_columns", "model_params", "fit_params", "representation_models"):
        if key not in plan:
            raise ValueError(f"the plan has no {key}")
    if isinstance(plan["label_columns"], str):
        raise TypeError("label_columns must be a list")
    if not plan["model_params"]:
        raise ValueError("model_params is empty")
    predict = plan.get("predict_params") or [{}]
    predict = [predict] if isinstance(predict, dict) else predict
    known = {f.name for f in fields(FitParams)}
    fit = FitParams(**{k: v for k, v in plan["fit_params"].items() if k in known})
    return plan | {"fit": fit, "predict": [PredictParams(**p) for p in predict], "default_executions": plan.get("default_executions", 1)}


def output_name(plan: dict, now: datetime) -> str:
    """The last three parts of the dataset's path without suffix, or the plan's own name, and the time."""
    parts = PurePosixPath(str(plan.get("dataset_path", "table"))).with_suffix("").parts[-3:]
    return f"{plan.get('file_output_name') or '_'.join(p.strip('/') for p in parts)}_{now:%Y%m%d_%H%M%S}"


def _number(make_value) -> float:
    """A measure's value, NaN where it fails or isn't defined."""
    try:
        value = make_value()
        value = value if isinstance(value, (int, float)) else value.head()[0]
        return NAN if value is None else float(value)
    except Exception:
        log.exception("a measure failed")
        return NAN


def internal_measures(vectors: DataFrame) -> dict[str, float]:
    """All internal measures of ``id``, ``v``, ``label``; the sums between clusters are made once per distance."""
    out = {}
    for m in ("euclidean", "cosine"):
        links = M.cluster_links(vectors, m).persist()
        out |= {
            f"{m}_dunn1": _number(lambda: M.dunn(links)), f"{m}_dunn2": _number(lambda: M.dunn(links, True)),
            f"{m}_davies_bouldin": _number(lambda: M.davies_bouldin(links)), f"{m}_davies_bouldin2": _number(lambda: M.davies_bouldin(links, True)),
            f"{m}_davies_bouldin3": _number(lambda: M.davies_bouldin_centroid(vectors, m)), f"{m}_silhouette": _number(lambda: M.silhouette(vectors, m)),
        }
        links.unpersist()
    return out | {"sklearn_davies_bouldin": _number(lambda: M.davies_bouldin_centroid(vectors, "euclidean", True))}


def external_measures(rows: DataFrame) -> dict[str, float]:
    """All external measures of ``v``, ``true``, ``pred``. Distance 0 means equal vectors for either distance."""
    cells = M.contingency(rows, F.col("true"), F.col("pred")).persist()
    out = {f"nmi_{a}": _number(lambda a=a: M.nmi(cells, a)) for a in ("geometric", "max", "arithmetic")}
    cells.unpersist()
    hit = _number(lambda: M.accuracy(rows, F.col("v"), F.col("true"), F.col("pred")))
    return out | {"euclidean_cluster_acc": hit, "cosine_cluster_acc": hit}


class PlanExecutor:
    """``load`` gives a plan's table; the default reads ``dataset_path`` as a delimited file."""

    def __init__(self, spark: SparkSession, load=None):
        self.spark = spark
        self.load = load or (lambda plan: with_row_id(read_delimited(spark, plan["dataset_path"], plan["text_column"], plan["label_columns"], plan.get("delimiter", ","))))

    def execute(self, plans: list[dict], folder: str | None = None, save_models: bool = False) -> DataFrame:
        """One result row per plan, representation, execution, prediction and label column; before them, with the name
        ``original_base``, one per label column in which the labels are their own prediction. Every plan is checked, and its
        table opened, before anything runs."""
        ready = [checked(p) for p in plans]
        for plan in ready:
            self.load(plan).limit(1).collect()
        rows: list[tuple] = []
        now = datetime.now()
        for plan in ready:
            stage = Stage(self.spark, "plan")
            data = stage.write(self.load(plan), "data")
            made: list[tuple] = []
            for entry in plan["representation_models"]:
                for name, told in entry.items():
                    try:
                        made += self._representation(plan, data, stage, name, (told or {}).get("representation_params") or {}, folder if save_models else None, now)
                    except Exception:
                        log.exception("representation %s failed", name)
            if folder and made:
                write_rows(self.spark.createDataFrame(made, SCHEMA), f"{folder}/{output_name(plan, now)}")
            rows += made
        return self.spark.createDataFrame(rows, SCHEMA)

    def _representation(self, plan: dict, data: DataFrame, stage: Stage, name: str, params: dict, models: str | None, now: datetime) -> list[tuple]:
        texts = data.select("row_id", F.col(f"`{plan['text_column']}`").alias("text"))
        if name == "precomputed":
            dense = texts.select(F.col("row_id").alias("id"), F.col("text").alias("v"))
        else:
            dense = make(name, **params).fit(texts).vectors(texts)
        with timed("representation %s", name):
            vectors = stage.write(tabular.min_max(dense, "v"), "vectors")
        shape = vectors.agg(F.count("*"), F.max(F.size("v"))).head()
        labels = data.select(F.col("row_id").alias("id"), *[F.col(f"`{c}`").cast("string").alias(f"l{k}") for k, c in enumerate(plan["label_columns"])])
        known = stage.write(vectors.join(labels, "id"), "labelled")

        def row(rep: str, column: str, k: int, pred: DataFrame, inside: dict, fit: str, predict: str) -> tuple:
            scored = pred.select("id", "v", F.coalesce(f"l{k}", F.lit("")).alias("true"), F.coalesce(F.col("pred").cast("string"), F.lit("")).alias("pred"))
            out = inside | external_measures(scored)
            clusters = scored.agg(F.count_distinct("pred")).head()[0]
            values = {"representation_name": rep, "label_column": column, "total_clusters": clusters, "representation_shape": f"({shape[0]}, {shape[1]})", "fit_params": fit, "predict_params": predict, "representation_params": str(params)}
            return tuple((values | out)[c] for c in COLUMNS)

        rows = []
        for k, column in enumerate(plan["label_columns"]):
            own = known.withColumn("pred", F.col(f"l{k}"))
            inside = internal_measures(own.select("id", "v", F.coalesce("pred", F.lit("")).alias("label")))
            rows.append(row("original_base", column, k, own, inside, "{}", "{}"))
        times = params.get("n_executions", plan["default_executions"]) if isinstance(params, dict) else plan["default_executions"]
        for execution in range(times):
            try:
                told = plan["model_params"]
                with timed("fit %d of %s", execution + 1, name):
                    net = ImmuneNetwork(self.spark, int(told.get("seed", 777)) + execution, told.get("distance_method", "cosine")).fit(vectors, plan["fit"])
                for p in plan["predict"]:
                    with timed("prediction %d of %s", execution + 1, name):
                        pred = stage.write(known.join(net.predict(vectors, p), "id").withColumnRenamed("cluster", "pred"), "pred")
                    with timed("measures of %d of %s", execution + 1, name):
                        inside = internal_measures(pred.select("id", "v", F.col("pred").cast("string").alias("label")))
                    rows += [row(name, column, k, pred, inside, str(plan["fit"]), str(p)) for k, column in enumerate(plan["label_columns"])]
                if models:
                    net.save(f"{models}/network_{output_name(plan, now)}_{name}_{execution + 1}_{times}")
            except Exception:
                log.exception("execution %d of %s failed", execution + 1, name)
        return rows
