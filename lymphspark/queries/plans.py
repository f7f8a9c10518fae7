"""Whole experiments: representations, plan rows, trained vectors, scored streams."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.functions import text as T
from lymphspark.functions.words import remove_stop_words, whitespace_tokens
from lymphspark.operators.lexicon import parse_dictionary
from lymphspark.operators.network import FitParams, ImmuneNetwork
from lymphspark.operators.representations import CategoryProfile, NGrams, ParagraphVectors, TagProfile, TrainedSubwordVectors, TrainedWordVectors
from lymphspark.plans.executor import PlanExecutor
from lymphspark.queries.measures import scaled
from lymphspark.queries.tables import _GRAM_BUCKETS, _HEAD, _MATCH, _TAG
from lymphspark.queries.text import _SPLIT, _TOKENS, NEWS, STOP_WORDS, Sql, _q, _weights
from lymphspark.session import Stage, table
from lymphspark.sources.fixtures import SAMPLE_DICTIONARY
from lymphspark.streaming.score import score_stream

_FIT = {"number_of_antibodies": 40, "no_best_cells_taken_each_selection": 3, "clone_multiplier": 5, "pruning_threshold": 0.3, "percent_clones_reselected": 0.2, "suppression_threshold": 0.05, "max_iter": 2}


def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    plan = {
        "text_column": "content", "label_columns": ["category"], "model_params": {"distance_method": "cosine", "seed": 777}, "fit_params": _FIT,
        "predict_params": [{"mst_pruning_type": "average", "k": 0.5}],
        "representation_models": [{"category_profile": {"representation_params": {"patterns": parse_dictionary(SAMPLE_DICTIONARY)[1]}}}],
    }
    return PlanExecutor(spark, lambda p: table(spark, folder, "covid_cleansed_data").select("row_id", "content", "category")).execute([plan])


def _headlines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "newspopularity_cleansed_train_file").select("row_id", F.col("headline").alias("text"))


def w2v_train(spark: SparkSession, folder: str) -> DataFrame:
    model = TrainedWordVectors(size=16, iterations=1).fit(_headlines(spark, folder))
    return model.words.select("word", F.size("vector").alias("n_dims"))


def _long(representation, spark: SparkSession, folder: str) -> DataFrame:
    df = _headlines(spark, folder)
    return representation.fit(df).transform(df).select("row_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def represent_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    return _long(NGrams(), spark, folder)


def represent_categories(spark: SparkSession, folder: str) -> DataFrame:
    return _long(CategoryProfile(parse_dictionary(SAMPLE_DICTIONARY)[1]), spark, folder)


def represent_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _long(TagProfile(), spark, folder)


def score_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = scaled(spark, folder).select("id", "v")
    return score_stream(vectors, ImmuneNetwork(spark, 777, "cosine").fit(vectors, FitParams(**_FIT)))


def subword_train(spark: SparkSession, folder: str) -> DataFrame:
    """The buckets that character n-grams of known words fill."""
    model = TrainedSubwordVectors(size=8, min_count=5, iterations=1).fit(_headlines(spark, folder))
    return model.buckets.select("bucket", F.size("vector").alias("n_dims"))


def paragraph_train(spark: SparkSession, folder: str) -> DataFrame:
    model = ParagraphVectors(size=8, iterations=1).fit(_headlines(spark, folder))
    return model.learned.select("row_id", F.size("v").alias("n_dims"))


def training_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Loss by epoch, of every way of training; all have the same tokens, and as a shard is learned in order on one core, they go side by side."""
    texts = _headlines(spark, folder)
    models = (
        ("cbow, negative samples", TrainedWordVectors(size=8, iterations=3)), ("skip-gram, tree", TrainedWordVectors(size=8, iterations=3, algorithm="skip-gram", negative=0)),
        ("subwords, tree", TrainedSubwordVectors(size=8, min_count=5, iterations=3)), ("pv-dbow", ParagraphVectors(size=8, iterations=3)), ("pv-dm", ParagraphVectors(size=8, iterations=3, algorithm="pv-dm")),
    )
    tokens = Stage(spark, "losses").write(models[0][1].tokens(texts), "tokens")
    with ThreadPoolExecutor(len(models)) as pool:
        fitted = list(pool.map(lambda m: m[1].fit(texts, tokens), models))
    rows = [(name, k, round(x, 6)) for (name, _), model in zip(models, fitted) for k, x in enumerate(model.losses, 1)]
    return spark.createDataFrame(rows, "algorithm string, epoch int, loss double")


def stop_word_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens whose lemma, here the word without a plural s, is no stop word."""
    tokens = whitespace_tokens(T.normalize_for_tokens(F.col("text")))
    lemma = lambda ts: F.transform(ts, lambda t: F.regexp_replace(t, "(..)s$", "$1"))
    kept = remove_stop_words(tokens, STOP_WORDS, lemma)
    return _headlines(spark, folder).select("row_id", F.posexplode(kept).alias("p", "lemma")).select("row_id", (F.col("p") + 1).cast("long").alias("pos"), "lemma")


QUERIES = {f.__name__: f for f in (result_rows, w2v_train, subword_train, paragraph_train, training_losses, stop_word_lemmas, represent_ngrams, represent_categories, represent_tags, score_vectors)}

_KNOWN = f"SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM ({_HEAD})) GROUP BY word"
_CATEGORIES = "[" + ", ".join(_q(c) for c in sorted({c for cs in parse_dictionary(SAMPLE_DICTIONARY)[1].values() for c in cs})) + "]"
# The universal part-of-speech tags, in the order of their columns.
_TAGS = "['ADJ', 'ADP', 'ADV', 'AUX', 'CCONJ', 'DET', 'INTJ', 'NOUN', 'NUM', 'PART', 'PRON', 'PROPN', 'PUNCT', 'SCONJ', 'SYM', 'VERB', 'X']"
ORACLES: dict[str, str] = {
    "w2v_train": f"SELECT word, 16::INTEGER AS n_dims FROM ({_KNOWN}) WHERE n >= 2",
    "subword_train": f"""WITH w AS (SELECT word FROM ({_KNOWN}) WHERE n >= 5), {_GRAM_BUCKETS}
SELECT b::BIGINT AS bucket, 8::INTEGER AS n_dims FROM bucket UNION SELECT ('0x' || substr(md5('<' || word || '>'), 1, 12))::BIGINT % 2000000, 8::INTEGER FROM w""",
    "paragraph_train": f"SELECT row_id, 8::INTEGER AS n_dims FROM {NEWS}",
    "stop_word_lemmas": f"""WITH l AS (SELECT row_id, list_filter(list_transform({_SPLIT(Sql.for_tokens('headline'))}, lambda w: lower(regexp_replace(w, '(..)s$', '\\1'))), lambda w: w NOT IN ({', '.join(map(_q, STOP_WORDS))})) AS t FROM {NEWS})
SELECT row_id, generate_subscripts(t, 1) AS pos, unnest(t) AS lemma FROM l""",
    "represent_ngrams": _weights(_TOKENS, NEWS, "row_id") + ", v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS dim FROM (SELECT DISTINCT term FROM cnt)) SELECT row_id, dim, round(weight, 6) AS value FROM weight JOIN v USING (term)",
    "represent_categories": f"""WITH d AS ({_HEAD}), word AS (SELECT row_id, len(t) AS n, unnest(t) AS token FROM d), {_MATCH},
c AS (SELECT row_id, category, count(*) / any_value(n) AS share FROM (SELECT row_id, n, unnest(string_split(categories, ',')) AS category FROM word JOIN hit USING (token) WHERE categories IS NOT NULL) GROUP BY ALL)
SELECT row_id, list_position({_CATEGORIES}, category)::BIGINT AS dim, round(round_even(share, 8), 6) AS value FROM c
UNION ALL SELECT row_id, 0::BIGINT, round((len(t) - min(len(t)) OVER ()) / (max(len(t)) OVER () - min(len(t)) OVER ()), 6) FROM d""",
    "represent_tags": f"""WITH h AS (SELECT row_id, coalesce({_SPLIT(Sql.normal('headline'))}, []) AS t FROM {NEWS})
SELECT row_id, list_position({_TAGS}, tag)::BIGINT - 1 AS dim, round(count(*) / any_value(n), 6) AS value FROM (SELECT row_id, n, {_TAG} AS tag FROM (SELECT row_id, len(t) AS n, unnest(t) AS w FROM h)) GROUP BY row_id, tag""",
}
