"""Word n-grams, tf-idf, collocations, character n-grams and averaged word vectors, in long form.

The long form (row, term, value) is the representation; nothing is ever made dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lymphspark.functions.words import unnest


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All word n-grams with low to high words, as an array of strings; empty where there are too few tokens."""
    def of(n: int) -> Column:
        if n == 1:
            return tokens
        last = F.size(tokens) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return tokens if high == 1 else F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def ngram_counts(df: DataFrame, id_col: str, tokens: Column, low: int = 1, high: int = 1) -> DataFrame:
    """``id``, ``term``, ``cnt``: occurrences of every n-gram in every row. Rows without tokens have none."""
    return unnest(df.select(id_col, ngrams(tokens, low, high).alias("term")), "term").groupBy(id_col, "term").agg(F.count("*").alias("cnt"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """``term`` and ``dim``: columns in alphabetical order. A sorted numbering over partitions, without one global window."""
    terms = counts.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term")
    placed = terms.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id())
    firsts = placed.groupBy("part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    offsets = firsts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(offsets.select("part", "first", "before")), "part").select("term", (F.col("seq") - F.col("first") + F.col("before")).alias("dim"))


def tfidf(counts: DataFrame, id_col: str, n_rows: DataFrame) -> DataFrame:
    """``id``, ``term``, ``weight``: count times ln((1 + n) / (1 + df)) + 1, each row scaled to length 1.

    ``n_rows`` has one row with the number ``n`` of all rows, those without terms too.
    """
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n_rows)).select("term", (F.log((F.lit(1) + F.col("n")) / (F.lit(1) + F.col("df"))) + 1).alias("idf"))
    weighted = counts.join(idf, "term").withColumn("w", F.col("cnt") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weighted.withColumn("weight", F.col("w") / length).select(id_col, "term", "weight")


def collocations(df: DataFrame, tokens: Column, min_count: int = 2, threshold: float = 10.0) -> DataFrame:
    """Neighbouring words that occur together more than by chance: ``w1``, ``w2``, ``score``.

    score = (count(ab) - min_count) * vocabulary / (count(a) * count(b)); words and pairs below min_count don't count.
    """
    every = df.select(tokens.alias("t"))
    word = unnest(every.select(F.col("t").alias("w")), "w").groupBy("w").agg(F.count("*").alias("n"))
    size = word.agg(F.count("*").alias("v"))
    after = F.size("t") - 1
    both = F.arrays_zip(F.slice("t", 1, F.greatest(after, F.lit(0))).alias("w1"), F.slice("t", 2, F.greatest(after, F.lit(0))).alias("w2"))
    pair = unnest(every.select(both.alias("p")), "p")
    pair = pair.groupBy("p.w1", "p.w2").agg(F.count("*").alias("n12")).filter(F.col("n12") >= min_count)
    joined = pair.join(word.select(F.col("w").alias("w1"), F.col("n").alias("n1")), "w1").join(word.select(F.col("w").alias("w2"), F.col("n").alias("n2")), "w2").crossJoin(F.broadcast(size))
    score = (F.col("n12") - min_count) * F.col("v") / (F.col("n1") * F.col("n2"))
    return joined.select("w1", "w2", score.alias("score")).filter(F.col("score") > threshold)


def char_ngrams(token: Column, low: int = 3, high: int = 6) -> Column:
    """Character n-grams of a token with ``<`` and ``>`` around it."""
    word = F.concat(F.lit("<"), token, F.lit(">"))

    def of(n: int) -> Column:
        last = F.length(word) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def hash_bucket(gram: Column, buckets: int = 2_000_000) -> Column:
    return F.conv(F.substring(F.md5(gram), 1, 12), 16, 10).cast("bigint") % F.lit(buckets)


def average_vectors(tokens: DataFrame, vectors: DataFrame, id_col: str) -> DataFrame:
    """``id``, ``dim``, ``value``: the sum of the vectors of a row's known tokens over the number of all its tokens.

    ``tokens`` has the id and ``tokens`` (array); ``vectors`` has ``word``, ``dim``, ``x``. Token counts are added up per row
    and word before the join. Rows without a known token have no values, which stand for zeros.
    """
    n = unnest(tokens.select(id_col, F.size("tokens").alias("n"), F.col("tokens").alias("word")), "word")
    per = n.groupBy(id_col, "n", "word").agg(F.count("*").alias("times"))
    return per.join(vectors, "word").groupBy(id_col, "dim").agg((F.sum(F.col("times") * F.col("x")) / F.first("n")).alias("value"))
