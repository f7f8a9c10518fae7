"""How characteristic a term is of a record: residual inverse document frequency times frequency in the record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lymphspark.session import Stage

#: A term in more than this share of a field's rows is hot: its pairs are spread over SALTS join keys. A row of w distinct
#: terms adds w pairs, so that a field has at most w / HOT_SHARE hot terms whatever its size (w: the mean row).
HOT_SHARE = 0.001
SALTS = 32


def ridf(n_rows: Column, occurrences: Column, all_rows: Column) -> Column:
    """-log2(df / N) + log2(1 - exp(-cf / N)): the observed inverse document frequency less the one that a Poisson spread of the
    cf occurrences over N rows would have."""
    return -F.log2(n_rows / all_rows) + F.log2(-F.expm1(-occurrences / all_rows))


def term_statistics(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Per field and term: ``occurrences`` (cf), ``n_rows`` (df), ``all_rows`` (N) and ``ridf``."""
    stats = pairs.groupBy("field_name", "term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_rows"))
    return stats.join(F.broadcast(totals), "field_name").withColumn("ridf", ridf(F.col("n_rows"), F.col("occurrences"), F.col("all_rows")))


def score_terms(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per field, row and term of it: ``n`` (occurrences in the row), ``occurrences``, ``n_rows``, ``all_rows``, ``ridf``, ``score``.

    score = n * ridf. ``pairs`` has ``field_name``, ``term``, ``record``, ``n``, one row for each; ``totals`` the number of
    all rows by field. Rows without terms (null, empty, blank) have none in the result. Repeated rows count each.
    """
    spark = pairs.sparkSession
    stats = Stage(spark, "terms").write(term_statistics(pairs, totals), "stats")
    hot = stats.filter(F.col("n_rows") > F.greatest(F.lit(100.0), F.lit(HOT_SHARE) * F.col("all_rows"))).select("field_name", "term", F.lit(True).alias("hot"))
    salted = pairs.join(F.broadcast(hot), ["field_name", "term"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    spread = stats.join(F.broadcast(hot), ["field_name", "term"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    joined = salted.join(spread, ["field_name", "term", "salt"]).drop("salt")
    return joined.withColumn("score", F.col("n") * F.col("ridf"))


def least_score(n: Column, rows: tuple[int, int], all_rows: Column) -> Column:
    """The least score of a term that is n times in a record and in ``rows`` records: ridf grows with the occurrences, and a
    term in df records that is n times in one of them has at least n + df - 1."""
    return n * reduce(F.least, [ridf(F.lit(float(df)), n + (df - 1), all_rows) for df in range(rows[0], rows[1] + 1)])


def outstanding(scores: DataFrame, min_in_row: dict[str, int], default_min: int = 3, rows: tuple[int, int] = (2, 10)) -> DataFrame:
    """The terms that stand out: those whose score reaches what a term as frequent in the record has at least if it is in
    ``rows`` records, and that, exactly counted, are frequent enough in the record and in so few records but more than one."""
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in min_in_row.items() for x in kv]), F.col("field_name")), F.lit(default_min)) if min_in_row else F.lit(default_min)
    reaches = F.col("score") >= least_score(F.col("n"), rows, F.col("all_rows")) - 1e-9
    return scores.filter(reaches).filter((F.col("n") >= least) & F.col("n_rows").between(*rows))
