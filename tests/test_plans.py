import csv
import json

import pytest
from pyspark.sql import functions as F

from lymphspark.operators.representations import CategoryProfile, Encoder, NGrams, NormProfile, SubwordVectors, TagProfile, WordVectors, make
from lymphspark.plans.executor import COLUMNS, PlanExecutor, checked, output_name
from lymphspark.sources import files
from lymphspark.sources.fixtures import NORM_LINES, SAMPLE_DICTIONARY

FIT = {"number_of_antibodies": 10, "no_best_cells_taken_each_selection": 2, "clone_multiplier": 4, "pruning_threshold": 0.9, "percent_clones_reselected": 0.3, "suppression_threshold": 0.02, "max_iter": 1}


@pytest.fixture
def dataset(tmp_path):
    path = tmp_path / "set" / "x" / "data.csv"
    path.parent.mkdir(parents=True)
    with path.open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["id", "text", "label", "other"])
        for k in range(24):
            w.writerow([k, ["the river harbour, \"quiet\" launch", "proof of a mini report\nover lines", "rebuild the harbour slowly"][k % 3], "abc"[k % 3], "xy"[k % 2]])
    return path


def plan_of(path, **more):
    return {"dataset_path": str(path), "text_column": "text", "label_columns": ["label", "other"], "delimiter": ",", "model_params": {"distance_method": "cosine", "seed": 3}, "fit_params": FIT, "predict_params": {"mst_pruning_type": "average", "k": 1.0}, "representation_models": [{"ngram": {"representation_params": {"kind": "count"}}}, {"nonsense": {}}]} | more


def test_delimited_files(spark, dataset, tmp_path):
    df = files.read_delimited(spark, str(dataset), "text", ["label"])
    assert df.columns == ["text", "label"] and df.count() == 24 and df.filter("text like '%\"quiet\"%'").count() == 8 and df.filter("text like '%\n%'").count() == 8
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(dataset), "nope", [])
    with pytest.raises(TypeError):
        files.read_delimited(spark, str(dataset), "text", "label")
    files.write_sample(df, str(tmp_path / "out"), quote_all=True)
    assert sorted(map(tuple, files.read_delimited(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))
    points = tmp_path / "p.csv"
    points.write_text("Obj;A 1;A 2;Class\n1;4;53;A\n2;5;63;B\n")
    assert [(r.v, r.label) for r in files.read_points(spark, str(points)).orderBy("row_id").collect()] == [([4.0, 53.0], "A"), ([5.0, 63.0], "B")]
    lines = tmp_path / "lines.txt"
    lines.write_text("\n".join(NORM_LINES))
    assert files.read_norms(spark, str(lines)).count() == 7
    words = tmp_path / "d.dic"
    words.write_text(SAMPLE_DICTIONARY)
    assert files.read_dictionary(spark, str(words)).filter("is_prefix").count() == 6


def test_plan(spark, dataset, tmp_path):
    plans = tmp_path / "plans.json"
    plans.write_text(json.dumps({"executions_plans": [plan_of(dataset)]}))
    rows = PlanExecutor(spark).execute(files.read_plans(str(plans)), str(tmp_path / "out"), save_models=True).collect()
    assert [c for c in rows[0].asDict()] == list(COLUMNS) and len(rows) == 4
    base = {r.label_column: r for r in rows if r.representation_name == "original_base"}
    assert base["label"].nmi_max == pytest.approx(1) and base["label"].euclidean_cluster_acc == 1 and base["label"].total_clusters == 3
    assert {r.representation_name for r in rows} == {"original_base", "ngram"}
    written = [p for p in (tmp_path / "out").iterdir()]
    assert any(p.name.startswith("network_") for p in written) and any("data_" in p.name for p in written)


def test_plans_are_checked_before_anything_runs(spark, dataset, tmp_path):
    for wrong in ({"label_columns": "label"}, {"model_params": {}}, {"fit_params": FIT | {"percent_clones_reselected": 0}}):
        with pytest.raises((TypeError, ValueError)):
            checked(plan_of(dataset, **wrong))
    with pytest.raises(Exception):
        PlanExecutor(spark).execute([plan_of(dataset), plan_of(tmp_path / "absent.csv")])
    from datetime import datetime

    assert output_name({"dataset_path": "/a/b/c/d.csv"}, datetime(2020, 1, 2, 3, 4, 5)) == "b_c_d_20200102_030405"
    assert output_name({"dataset_path": "/a/b.csv", "file_output_name": "mine"}, datetime(2020, 1, 2, 3, 4, 5)).startswith("mine_")


def test_representations(spark):
    texts = spark.createDataFrame([(1, "The river, the harbour"), (2, ""), (3, None)], "row_id long, text string")
    model = NGrams(kind="count").fit(texts)
    assert model.names == ["harbour", "river", "the"]
    dense = {r.id: r.v for r in model.vectors(texts).collect()}
    assert dense == {1: [1.0, 1.0, 2.0], 2: [0.0] * 3, 3: [0.0] * 3}
    other = spark.createDataFrame([(9, "river unseen")], "row_id long, text string")
    assert model.fit(other).vectors(other).head().v == [0.0, 1.0, 0.0]
    words = spark.createDataFrame([("river", [1.0, 2.0])], "word string, vector array<double>")
    assert {r.id: r.v for r in WordVectors(words, 2).vectors(texts).collect()}[1] == [0.25, 0.5]
    profile = {r.id: r.v for r in CategoryProfile({"riv*": ["place"]}).vectors(texts).collect()}
    assert profile[1] == [1.0, 0.25] and profile[2] == [0.0, 0.0]
    assert sum({r.id: r.v for r in TagProfile().vectors(texts).collect()}[1]) == pytest.approx(1)
    from lymphspark.operators.lexicon import parse_norms

    norms = parse_norms(spark.createDataFrame(list(enumerate(NORM_LINES)), "line_no long, line string"))
    assert {r.id: r.v for r in NormProfile(norms).vectors(texts).collect()}[1][3] > 0
    buckets = spark.range(50).select(F.col("id").alias("bucket"), F.array(F.lit(1.0)).alias("vector"))
    assert {r.id: r.v for r in SubwordVectors(buckets, 1, count=50).vectors(texts).collect()}[1] == [pytest.approx(1.0)]
    length = Encoder(lambda c: F.array(F.length(F.coalesce(c, F.lit("")))), 1)
    assert {r.id: r.v[0] for r in length.vectors(texts).collect()}[2] == 0
    with pytest.raises(ValueError):
        make("nothing")
