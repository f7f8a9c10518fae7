"""Texts as vectors. Every kind gives the long form (row_id, dim, value), and dense arrays where clustering needs them.

``texts`` frames have ``row_id`` (long) and ``text``. A kind that learns (a vocabulary, vectors) does so in ``fit`` and keeps
it for later calls.
"""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.functions import text as T
from lymphspark.functions.words import remove_stop_words, whitespace_tokens
from lymphspark.operators import embeddings, lexicon, terms
from lymphspark.session import Stage

#: Columns of a dense vector.
MAX_DIMS = 100_000


class Representation(ABC):
    """``names`` are the columns by number after fit()."""

    names: list[str]

    def fit(self, texts: DataFrame) -> Representation:
        return self

    @abstractmethod
    def transform(self, texts: DataFrame) -> DataFrame:
        """``row_id``, ``dim`` (int), ``value``; what has no row is 0."""

    def vectors(self, texts: DataFrame) -> DataFrame:
        """``id``, ``v``: a dense array for every row, rows without values being all zero."""
        width = len(self.names)
        long = self.transform(texts).groupBy("row_id").agg(F.collect_list(F.struct("dim", "value")).alias("cells"))
        every = texts.select("row_id").join(long, "row_id", "left").select(F.col("row_id").alias("id"), F.col("cells.dim").alias("d"), F.col("cells.value").alias("x"))

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    out = np.zeros((batch.num_rows, width))
                    for k, (d, x) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                        if d:
                            out[k, d] = x
                    offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * width
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], names=["id", "v"])

        return every.mapInArrow(dense, "id long, v array<double>")


class NGrams(Representation):
    """Word n-grams, as counts or tf-idf of length 1. The vocabulary is learned once, in alphabetical order, or given."""

    def __init__(self, low: int = 1, high: int = 1, kind: str = "tf-idf", vocabulary: list[str] | None = None, stop_words: Iterable[str] = (), lemma: Callable | None = None):
        if kind not in ("count", "tf-idf") or not 1 <= low <= high:
            raise ValueError("kind is count or tf-idf, and 1 <= low <= high")
        self.low, self.high, self.kind = low, high, kind
        self.names, self.stop_words, self.lemma = list(vocabulary or []), stop_words, lemma

    def counts(self, texts: DataFrame) -> DataFrame:
        tokens = T.ngram_tokens(T.normalize_for_ngrams(F.col("text")))
        if self.stop_words or self.lemma:
            tokens = remove_stop_words(tokens, self.stop_words, self.lemma)
        return terms.ngram_counts(texts, "row_id", tokens, self.low, self.high)

    def fit(self, texts: DataFrame) -> NGrams:
        if not self.names:
            found = [r.term for r in self.counts(texts).select("term").distinct().orderBy("term").limit(MAX_DIMS + 1).collect()]
            if len(found) > MAX_DIMS:
                raise ValueError(f"over {MAX_DIMS} terms; the long form has no such limit")
            self.names = found
        return self

    def transform(self, texts: DataFrame) -> DataFrame:
        counts = self.counts(texts)
        if self.names:
            known = texts.sparkSession.createDataFrame(list(enumerate(self.names)), "dim int, term string")
            counts = counts.join(known, "term")
        else:
            counts = counts.join(terms.vocabulary(counts), "term")
        if self.kind == "count":
            return counts.select("row_id", "dim", F.col("cnt").cast("double").alias("value"))
        weights = terms.tfidf(counts.select("row_id", "term", "cnt"), "row_id", texts.agg(F.count("*").alias("n")))
        return weights.join(counts.select("row_id", "term", "dim"), ["row_id", "term"]).select("row_id", "dim", F.col("weight").alias("value"))

    def save(self, spark: SparkSession, folder: str) -> None:
        _write_told(spark, folder, {"low": self.low, "high": self.high, "kind": self.kind, "stop_words": sorted(self.stop_words)})
        spark.createDataFrame(list(enumerate(self.names)), "dim int, term string").write.mode("overwrite").parquet(f"{folder}/terms")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, lemma: Callable | None = None) -> NGrams:
        names = [r.term for r in spark.read.parquet(f"{folder}/terms").orderBy("dim").limit(MAX_DIMS).collect()]
        return cls(**_read_told(spark, folder), vocabulary=names, lemma=lemma)


def _write_told(spark: SparkSession, folder: str, told: dict) -> None:
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/params")


def _read_told(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/params").head()[0])


def _tokens(texts: DataFrame, normalize: Callable = T.normalize_for_tokens, stop_words: Iterable[str] = (), lemma: Callable | None = None) -> DataFrame:
    tokens = whitespace_tokens(normalize(F.col("text")))
    return texts.select("row_id", (remove_stop_words(tokens, stop_words, lemma) if stop_words or lemma else tokens).alias("tokens"))


class WordVectors(Representation):
    """The mean of given word vectors over all tokens of a text: ``words`` has ``word`` and ``vector``."""

    def __init__(self, words: DataFrame | None = None, dims: int = 0, stop_words: Iterable[str] = (), lemma: Callable | None = None):
        self.words, self.names, self.stop_words, self.lemma = words, [str(k) for k in range(dims)], stop_words, lemma

    def tokens(self, texts: DataFrame) -> DataFrame:
        return _tokens(texts, stop_words=self.stop_words, lemma=self.lemma)

    def transform(self, texts: DataFrame) -> DataFrame:
        long = self.words.select("word", F.posexplode("vector").alias("dim", "x"))
        return terms.average_vectors(self.tokens(texts), long, "row_id")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Word vectors as a folder of tables; the lemma plug-in isn't saved."""
        _write_told(spark, folder, {"dims": len(self.names), "stop_words": sorted(self.stop_words)})
        self.words.write.mode("overwrite").parquet(f"{folder}/words")

    @staticmethod
    def load(spark: SparkSession, folder: str, lemma: Callable | None = None) -> WordVectors:
        return WordVectors(spark.read.parquet(f"{folder}/words"), **_read_told(spark, folder), lemma=lemma)


def _vector_frame(spark: SparkSession, key: str, kind: str, keys: list, vectors: np.ndarray) -> DataFrame:
    table = pa.table({key: keys, "vector": pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * vectors.shape[1], vectors.astype(float).ravel())})
    return spark.createDataFrame(table.cast(pa.schema([(key, pa.string() if kind == "string" else pa.int64()), ("vector", pa.list_(pa.float64()))])))


class TrainedWordVectors(WordVectors):
    """Word vectors learned from the texts: ``cbow`` or ``skip-gram``, by ``negative`` samples, or along a Huffman tree if there are none.

    With ``phrase_min_count`` neighbouring words that occur together more than by chance are one word each, here as in transform().
    """

    def __init__(self, size: int = 50, window: int = 5, min_count: int = 2, iterations: int = 5, seed: int = 777, algorithm: str = "cbow", negative: int = 5, phrase_min_count: int | None = None, stop_words: Iterable[str] = (), lemma: Callable | None = None):
        super().__init__(None, size, stop_words, lemma)
        self.params = embeddings.TrainParams(size, algorithm, window, negative, iterations, seed=seed)
        self.min_count, self.phrase_min_count, self.phrases, self.losses = min_count, phrase_min_count, None, []

    def tokens(self, texts: DataFrame) -> DataFrame:
        plain = super().tokens(texts)
        return plain if self.phrases is None else embeddings.join_phrases(plain, self.phrases)

    def fit(self, texts: DataFrame, tokens: DataFrame | None = None) -> TrainedWordVectors:
        """``tokens``, if given, are those of the texts, which several kinds may share."""
        if self.phrase_min_count is not None:
            self.phrases = None
            self.phrases = Stage(texts.sparkSession, "phrases").write(terms.collocations(self.tokens(texts), F.col("tokens"), self.phrase_min_count))
        model, _ = embeddings.train(self.tokens(texts) if tokens is None else tokens, self.params, self.min_count)
        self.words, self.losses = _vector_frame(texts.sparkSession, "word", "string", model.words, model.vectors()), model.losses
        return self


class SubwordVectors(Representation):
    """A word is the mean of its character n-grams' vectors, found by hashed bucket: ``buckets`` has ``bucket``, ``vector``.
    With ``whole`` the word itself is one of its n-grams."""

    def __init__(self, buckets: DataFrame | None, dims: int, low: int = 3, high: int = 6, count: int = 2_000_000, whole: bool = False, stop_words: Iterable[str] = (), lemma: Callable | None = None):
        self.buckets, self.low, self.high, self.count, self.whole, self.stop_words, self.lemma = buckets, low, high, count, whole, stop_words, lemma
        self.names = [str(k) for k in range(dims)]

    def transform(self, texts: DataFrame) -> DataFrame:
        tokens = _tokens(texts, stop_words=self.stop_words, lemma=self.lemma)
        parts = terms.char_ngrams(F.col("word"), self.low, self.high)
        if self.whole:
            marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
            parts = F.when(F.array_contains(parts, marked), parts).otherwise(F.concat(parts, F.array(marked)))
        grams = tokens.select(F.explode("tokens").alias("word")).distinct().select("word", F.explode(parts).alias("gram"))
        hits = grams.select("word", terms.hash_bucket(F.col("gram"), self.count).alias("bucket")).join(self.buckets.select("bucket", F.posexplode("vector").alias("dim", "x")), "bucket")
        return terms.average_vectors(tokens, hits.groupBy("word", "dim").agg(F.avg("x").alias("x")), "row_id")

    def save(self, spark: SparkSession, folder: str) -> None:
        _write_told(spark, folder, {"dims": len(self.names), "low": self.low, "high": self.high, "count": self.count, "whole": self.whole, "stop_words": sorted(self.stop_words)})
        self.buckets.write.mode("overwrite").parquet(f"{folder}/buckets")

    @staticmethod
    def load(spark: SparkSession, folder: str, lemma: Callable | None = None) -> SubwordVectors:
        return SubwordVectors(spark.read.parquet(f"{folder}/buckets"), **_read_told(spark, folder), lemma=lemma)


class TrainedSubwordVectors(SubwordVectors):
    """Vectors of character n-grams learned from the texts, so that unseen words have vectors too; a word is one of its n-grams."""

    def __init__(self, size: int = 100, window: int = 5, min_count: int = 5, iterations: int = 10, seed: int = 777, algorithm: str = "cbow", negative: int = 0, low: int = 3, high: int = 6, count: int = 2_000_000, stop_words: Iterable[str] = (), lemma: Callable | None = None):
        super().__init__(None, size, low, high, count, True, stop_words, lemma)
        self.params, self.min_count, self.losses = embeddings.TrainParams(size, algorithm, window, negative, iterations, seed=seed), min_count, []

    def _buckets(self, word: str) -> list[int]:
        marked = f"<{word}>"
        grams = [marked[k : k + n] for n in range(self.low, self.high + 1) for k in range(len(marked) - n + 1)]
        return [int(hashlib.md5(g.encode()).hexdigest()[:12], 16) % self.count for g in (grams if marked in grams else [*grams, marked])]

    def fit(self, texts: DataFrame, tokens: DataFrame | None = None) -> TrainedSubwordVectors:
        tokens = _tokens(texts, stop_words=self.stop_words, lemma=self.lemma) if tokens is None else tokens
        words = embeddings.known_words(tokens, self.min_count, embeddings.MAX_VALUES // (2 * self.params.size))
        own = {w: self._buckets(w) for w, _ in words}
        # Only buckets that occur have a row.
        rows = {b: k for k, b in enumerate(sorted({b for bs in own.values() for b in bs}))}
        model, _ = embeddings.train(tokens, self.params, self.min_count, {w: [rows[b] for b in bs] for w, bs in own.items()}, len(rows), words)
        self.buckets, self.losses = _vector_frame(texts.sparkSession, "bucket", "long", list(rows), model.inputs), model.losses
        return self


class ParagraphVectors(Representation):
    """Vectors of whole texts: ``pv-dbow`` (the text alone predicts its words) or ``pv-dm`` (with a word's neighbours). New texts are
    learned alone against the words as they are."""

    def __init__(self, size: int = 50, window: int = 5, min_count: int = 2, iterations: int = 10, seed: int = 777, algorithm: str = "pv-dbow", negative: int = 5, stop_words: Iterable[str] = (), lemma: Callable | None = None):
        if not algorithm.startswith("pv-"):
            raise ValueError("algorithm is pv-dbow or pv-dm")
        self.params = embeddings.TrainParams(size, algorithm, window, negative, iterations, seed=seed)
        self.min_count, self.stop_words, self.lemma, self.names = min_count, stop_words, lemma, [str(k) for k in range(size)]
        self.model, self.learned, self.losses = None, None, []

    def tokens(self, texts: DataFrame) -> DataFrame:
        return _tokens(texts, stop_words=self.stop_words, lemma=self.lemma)

    def fit(self, texts: DataFrame, tokens: DataFrame | None = None) -> ParagraphVectors:
        """``learned`` has ``row_id``, ``v`` of the texts fitted on."""
        self.model, self.learned = embeddings.train(self.tokens(texts) if tokens is None else tokens, self.params, self.min_count)
        self.losses = self.model.losses
        return self

    def transform(self, texts: DataFrame) -> DataFrame:
        found = embeddings.infer(self.tokens(texts), self.model, self.params)
        return found.select("row_id", F.posexplode("v").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))

    def save(self, spark: SparkSession, folder: str) -> None:
        """What new texts need: words with their counts, input and output vectors."""
        p = self.params
        _write_told(spark, folder, {"size": p.size, "window": p.window, "min_count": self.min_count, "iterations": p.epochs, "seed": p.seed, "algorithm": p.algorithm, "negative": p.negative, "stop_words": sorted(self.stop_words)})
        rows = [(k, w, int(n), i.tolist(), o.tolist()) for k, (w, n, i, o) in enumerate(zip(self.model.words, self.model.counts, self.model.inputs, self.model.outputs))]
        spark.createDataFrame(rows, "k int, word string, n long, i array<float>, o array<float>").write.mode("overwrite").parquet(f"{folder}/words")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, lemma: Callable | None = None) -> ParagraphVectors:
        out = cls(**_read_told(spark, folder), lemma=lemma)
        rows = spark.read.parquet(f"{folder}/words").orderBy("k").limit(embeddings.MAX_VALUES // out.params.size).collect()
        n, zero = len(rows), np.zeros((0, out.params.size), np.float32)
        stacked = lambda c: np.array([r[c] for r in rows], np.float32) if n else zero
        out.model = embeddings.Model([r.word for r in rows], np.array([r.n for r in rows], np.int64), np.arange(n), np.arange(n + 1), stacked("i"), stacked("o"))
        return out


class CategoryProfile(Representation):
    """Shares of lexicon categories; the first column is the token count, rescaled over the texts."""

    def __init__(self, patterns: dict[str, list[str]]):
        self.patterns = patterns
        self.names = ["WC", *sorted({c for cs in patterns.values() for c in cs})]

    def transform(self, texts: DataFrame) -> DataFrame:
        spark = texts.sparkSession
        tokens = _tokens(texts)
        profile = lexicon.category_profile(tokens, "row_id", lexicon.lexicon_frame(spark, self.patterns))
        known = spark.createDataFrame(list(enumerate(self.names)), "dim int, category string")
        n = tokens.select("row_id", F.size("tokens").cast("double").alias("n"))
        wide = F.broadcast(n.agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
        count = n.crossJoin(wide).select("row_id", F.lit(0).alias("dim"), F.coalesce(F.try_divide(F.col("n") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("value"))
        return count.unionByName(profile.join(F.broadcast(known), "category").select("row_id", "dim", F.col("share").alias("value")))


class TagProfile(Representation):
    """Shares of part-of-speech tags. ``tagger`` makes an array of tags from an array of tokens, as a column."""

    #: The universal part-of-speech tags.
    TAGS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")

    def __init__(self, tagger: Callable = lexicon.suffix_tags):
        self.tagger, self.names = tagger, list(self.TAGS)

    def transform(self, texts: DataFrame) -> DataFrame:
        tagged = _tokens(texts, T.normalize_text).select("row_id", self.tagger(F.col("tokens")).alias("tags"))
        known = texts.sparkSession.createDataFrame(list(enumerate(self.names)), "dim int, tag string")
        return lexicon.tag_distribution(tagged, "row_id").join(F.broadcast(known), "tag").select("row_id", "dim", F.col("share").alias("value"))


class NormProfile(Representation):
    """Word norms by word and word type, averaged over a text's tokens: ``norms`` as parse_norms() gives them."""

    def __init__(self, norms: DataFrame, tagger: Callable = lexicon.suffix_tags):
        self.norms, self.tagger, self.names = norms, tagger, list(lexicon.DIMENSIONS)

    def transform(self, texts: DataFrame) -> DataFrame:
        tokens = _tokens(texts)
        known = texts.sparkSession.createDataFrame(list(enumerate(self.names)), "at int, dim string")
        profile = lexicon.norm_profile(tokens.withColumn("tags", self.tagger(F.col("tokens"))), "row_id", self.norms)
        return profile.join(F.broadcast(known), "dim").select("row_id", F.col("at").alias("dim"), "value")


class Encoder(Representation):
    """A sentence encoder that the caller brings: a column function from text to an array of numbers (as a pandas UDF)."""

    def __init__(self, encode: Callable, dims: int):
        self.encode, self.names = encode, [str(k) for k in range(dims)]

    def transform(self, texts: DataFrame) -> DataFrame:
        encoded = self.encode(T.normalize_for_tokens(F.col("text")))
        return texts.select("row_id", F.posexplode(encoded).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


#: Kinds that a plan may name.
REGISTRY: dict[str, Callable[..., Representation]] = {
    "ngram": NGrams,
    "word2vec": TrainedWordVectors,
    "word_vectors": WordVectors,
    "subword_vectors": SubwordVectors,
    "fasttext": TrainedSubwordVectors,
    "doc2vec": ParagraphVectors,
    "category_profile": CategoryProfile,
    "tag_profile": TagProfile,
    "norm_profile": NormProfile,
    "encoder": Encoder,
}


def make(name: str, **params) -> Representation:
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown representation {name}; known are {', '.join(REGISTRY)}")
    return REGISTRY[name.lower()](**params)
