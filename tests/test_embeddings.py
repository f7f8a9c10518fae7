import random
import threading
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lymphspark.functions.words import remove_stop_words
from lymphspark.operators import embeddings
from lymphspark.operators.embeddings import Model, TrainParams, _Outputs, huffman, join_phrases, learn, neighbours, train
from lymphspark.operators.representations import NGrams, ParagraphVectors, SubwordVectors, TrainedSubwordVectors, TrainedWordVectors, WordVectors, make
from lymphspark.queries import plans
from lymphspark.sources.files import read_word_vectors

TOPICS = [["river", "harbour", "bridge", "ferry", "water"], ["market", "price", "budget", "trade", "money"]]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(TOPICS[k % 2]) for _ in range(rng.randint(5, 12)))) for k in range(300)] + [(900, None), (901, ""), (902, "unseen")]
    return spark.createDataFrame(rows, "row_id long, text string").withColumn("v", F.lit(1)).withColumn("tokens", F.lit("x"))


def near(a, b):
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_huffman_paths_are_a_code():
    counts = np.array([40, 20, 10, 10, 5, 1])
    points, turns, offsets = huffman(counts)
    codes = ["".join(str(int(t)) for t in turns[a:b]) for a, b in zip(offsets, offsets[1:])]
    assert len(set(codes)) == 6 and not any(x != y and y.startswith(x) for x in codes for y in codes)
    assert len(codes[0]) == min(map(len, codes)) and points.max() == 4 and huffman(np.array([3]))[2].tolist() == [0, 0]


def test_neighbours_stay_in_their_text():
    text = np.array([0, 0, 0, 1, 1, 2])
    here, there = neighbours(np.arange(6), text, 3, np.random.default_rng(1))
    assert (here != there).all() and (text[here] == text[there]).all() and (np.abs(here - there) <= 3).all()
    assert {(int(a), int(b)) for a, b in zip(here, there)} >= {(0, 1), (1, 0), (3, 4), (4, 3)} and 5 not in here


@pytest.mark.parametrize("negative", [0, 4])
def test_gradients_lower_the_loss_of_their_batch(negative):
    """A step in the direction of the gradient: the loss on the same predictions falls, by what finite differences say."""
    rng = np.random.default_rng(2)
    make_model = lambda: Model([], np.array([9, 7, 5, 3]), np.arange(4), np.arange(5), rng.normal(size=(4, 6)).astype(np.float32), rng.normal(size=(4, 6)).astype(np.float32))
    m, p = make_model(), TrainParams(6, "cbow", 2, negative)
    ids, text = np.array([0, 1, 2, 3, 1, 0]), np.zeros(6, int)
    loss = lambda m, rate: learn(ids, text, None, m, _Outputs(m.counts, negative), p, rate, np.random.default_rng(3))[0]
    before = loss(m, 0.0)
    start = m.inputs.copy()
    loss(m, 1e-3)
    assert loss(m, 0.0) < before
    slope = (m.inputs - start)[1, 2] / 1e-3
    other = Model([], m.counts, m.parts, m.offsets, start.copy(), m.outputs.copy())
    base = loss(other, 0.0)
    other.inputs[1, 2] += 1e-2
    assert -(loss(other, 0.0) - base) / 1e-2 == pytest.approx(slope, rel=0.05, abs=0.02)


@pytest.mark.parametrize(("algorithm", "negative"), [("cbow", 5), ("skip-gram", 5), ("skip-gram", 0), ("cbow", 0)])
def test_word_vectors_tell_topics(texts, algorithm, negative):
    model = TrainedWordVectors(12, 3, 2, 12, algorithm=algorithm, negative=negative).fit(texts)
    v = {r.word: np.array(r.vector) for r in model.words.collect()}
    assert set(v) == {w for t in TOPICS for w in t} and model.losses[-1] < 0.97 * model.losses[0]
    if algorithm == "skip-gram":
        assert np.mean([near(v["river"], v[w]) for w in TOPICS[0][1:]]) > np.mean([near(v["river"], v[w]) for w in TOPICS[1]]) + 0.1


def test_vectors_do_not_depend_on_partitions(texts):
    one, many = (TrainedWordVectors(8, 2, 2, 2).fit(t).words.orderBy("word").collect() for t in (texts.coalesce(1), texts.repartition(7)))
    assert one == many
    a, b = (ParagraphVectors(8, iterations=2).fit(t).learned.orderBy("row_id").collect() for t in (texts.coalesce(1), texts.repartition(7)))
    assert a == b


def test_shards_are_averaged(texts, monkeypatch):
    import lymphspark.operators.embeddings as e

    monkeypatch.setattr(e, "SHARD", 500)
    monkeypatch.setattr(e, "BLOCK", 4)
    model = TrainedWordVectors(12, 3, 2, 12, algorithm="skip-gram").fit(texts)
    assert model.losses[-1] < 0.98 * model.losses[0]


def test_subword_vectors_reach_unseen_words(spark, texts, tmp_path):
    model = TrainedSubwordVectors(12, 3, 2, 8, algorithm="skip-gram").fit(texts)
    assert model.losses[-1] < model.losses[0]
    other = spark.createDataFrame([(1, "harbours"), (2, "harbour"), (3, "qqq")], "row_id long, text string")
    v = {r.id: np.array(r.v) for r in model.vectors(other).collect()}
    assert near(v[1], v[2]) > 0.5 and not v[3].any()
    model.save(spark, str(tmp_path / "m"))
    again = {r.id: r.v for r in SubwordVectors.load(spark, str(tmp_path / "m")).vectors(other).collect()}
    assert all(np.allclose(again[k], v[k]) for k in v)


@pytest.mark.parametrize("algorithm", ["pv-dbow", "pv-dm"])
def test_paragraph_vectors(spark, texts, algorithm, tmp_path):
    model = ParagraphVectors(12, 3, 2, 20, algorithm=algorithm).fit(texts)
    assert model.losses[-1] < model.losses[0]
    learned = {r.row_id: np.array(r.v) for r in model.learned.collect()}
    assert set(learned) == {*range(300), 900, 901, 902}
    new = spark.createDataFrame([(5000, "river ferry water bridge harbour river ferry water"), (5001, "money trade price budget market money"), (5002, None)], "row_id long, text string")
    v = {r.id: np.array(r.v) for r in model.vectors(new).collect()}
    if algorithm == "pv-dbow":
        rivers, markets = (np.mean([learned[k] for k in range(s, 300, 2)], axis=0) for s in (0, 1))
        assert near(v[5000], rivers) > near(v[5000], markets) and near(v[5001], markets) > near(v[5001], rivers)
    model.save(spark, str(tmp_path / "m"))
    again = {r.id: np.array(r.v) for r in ParagraphVectors.load(spark, str(tmp_path / "m")).vectors(new).collect()}
    assert all(np.allclose(again[k], v[k]) for k in v)


def test_phrases_stop_words_and_lemmas(spark):
    df = spark.createDataFrame([(1, ["new", "york", "new", "york", "york"]), (2, None), (3, [])], "row_id long, tokens array<string>")
    phrases = spark.createDataFrame([("new", "york", 11.0)], "w1 string, w2 string, score double")
    assert {r.row_id: r.tokens for r in join_phrases(df, phrases).collect()} == {1: ["new_york", "new_york", "york"], 2: None, 3: []}
    lemma = lambda ts: F.transform(ts, lambda t: F.regexp_replace(t, "s$", ""))
    got = spark.createDataFrame([(["The", "Rivers", "thes", "x"],), (None,)], "t array<string>").select(remove_stop_words(F.col("t"), {"the"}, lemma).alias("r")).collect()
    assert [r.r for r in got] == [["river", "x"], None]
    texts = spark.createDataFrame([(1, "the rivers"), (2, "a river")], "row_id long, text string")
    grams = NGrams(kind="count", stop_words={"the", "a"}, lemma=lemma).fit(texts)
    assert grams.names == ["river"]
    model = TrainedWordVectors(4, 2, 1, 1, phrase_min_count=1, stop_words={"the"})
    many = spark.createDataFrame([(k, f"the silver lake w{k}" if k < 10 else f"the other{k} w{k}") for k in range(150)], "row_id long, text string")
    assert "silver_lake" in {r.word for r in model.fit(many).words.collect()} and "the" not in {r.word for r in model.words.collect()}


def test_models_save_and_files_load(spark, texts, tmp_path):
    grams = NGrams(1, 2, "count").fit(texts)
    grams.save(spark, str(tmp_path / "g"))
    assert NGrams.load(spark, str(tmp_path / "g")).names == grams.names
    (tmp_path / "v.txt").write_text("2 3\nriver 1 2 3\nharbour 0.5 -1 1e-2 \n")
    words = read_word_vectors(spark, str(tmp_path / "v.txt"))
    assert {r.word: r.vector for r in words.collect()} == {"river": [1.0, 2.0, 3.0], "harbour": [0.5, -1.0, 0.01]}
    model = WordVectors(words, 3, stop_words={"harbour"})
    model.save(spark, str(tmp_path / "w"))
    one = spark.createDataFrame([(1, "river harbour")], "row_id long, text string")
    assert WordVectors.load(spark, str(tmp_path / "w")).vectors(one).head().v == model.vectors(one).head().v == [1.0, 2.0, 3.0]


def test_empty_tables_and_limits(spark):
    none = spark.createDataFrame([], "row_id long, text string")
    assert TrainedWordVectors(4).fit(none).words.collect() == [] and TrainedSubwordVectors(4).fit(none).buckets.collect() == []
    assert ParagraphVectors(4).fit(none).learned.collect() == []
    lone = spark.createDataFrame([(1, "word"), (None, "word word")], "row_id long, text string")
    assert TrainedWordVectors(4, min_count=1, iterations=2).fit(lone).words.count() == 1 and TrainedWordVectors(4, min_count=1, iterations=2, negative=0).fit(lone).words.count() == 1
    with pytest.raises(ValueError):
        TrainParams(algorithm="other")
    with pytest.raises(ValueError):
        train(spark.createDataFrame([(1, ["a", "b"])], "row_id long, tokens array<string>"), TrainParams(size=40_000_000), 1)
    assert make("fasttext", size=3).names == ["0", "1", "2"] and make("doc2vec", size=2).names == ["0", "1"]


def test_rows_are_added_as_numpy_adds_them():
    rng = np.random.default_rng(4)
    at, change, to = rng.integers(0, 9, 300), rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(9, 8)).astype(np.float32)
    want = to.copy()
    np.add.at(want, at, change)
    embeddings._add(to, at, change)
    assert (to == want).all()


def test_training_losses_are_learned_side_by_side(spark, texts, monkeypatch):
    """Every way waits for all others: one after the other they would never get on."""
    met = threading.Barrier(5, timeout=20)

    def fit(self, df, *tokens):
        met.wait()
        return SimpleNamespace(losses=[float(self.params.size)])

    for kind in (TrainedWordVectors, TrainedSubwordVectors, ParagraphVectors):
        monkeypatch.setattr(kind, "fit", fit)
    monkeypatch.setattr(plans, "_headlines", lambda spark, folder: texts)
    rows = plans.training_losses(spark, "").collect()
    assert [r.algorithm for r in rows] == ["cbow, negative samples", "skip-gram, tree", "subwords, tree", "pv-dbow", "pv-dm"] and {r.loss for r in rows} == {8.0}
