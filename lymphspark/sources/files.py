"""Readers and writers: delimited files, line files, lexica, word norms, experiment plans, result rows."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.operators.lexicon import lexicon_frame, parse_dictionary, parse_norms


#: How delimited files are written: white space around values stays, as it does when they are read.
_WRITTEN = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_delimited(spark: SparkSession, path: str, text_column: str | None = None, label_columns: list[str] | None = None, delimiter: str = ",", quote: str = '"', line_breaks: bool = True) -> DataFrame:
    """All columns as strings, named by the header; quotes inside quoted fields are doubled, line breaks may stand in them.

    With ``text_column`` only that and the labels are read. ``label_columns`` must be a list; a missing column is an error.
    An empty ``quote`` switches quoting off. A file whose fields may have line breaks is read by one task; where none has, or with
    ``line_breaks`` off, it is split among many.
    """
    if isinstance(label_columns, str):
        raise TypeError("label_columns must be a list of names")
    options = {"header": True, "sep": delimiter, "quote": quote, "escape": '"', "multiLine": bool(quote) and line_breaks, "inferSchema": False, "encoding": "UTF-8", "maxCharsPerColumn": -1}
    df = spark.read.options(**options).csv(path)
    if text_column is None:
        return df
    wanted = [text_column, *(label_columns or [])]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word``, ``vector`` from lines of a word and its numbers, parted by single spaces, as word vectors are published; a first
    line with two numbers only (words and dimensions) and lines without numbers are left out. A line that isn't so is an error."""
    parts = F.split(F.regexp_replace("value", r"\s+$", ""), " ")
    rows = spark.read.text(path).select(parts.alias("p")).filter((F.size("p") > 2) | ((F.size("p") == 2) & ~F.get("p", F.lit(0)).rlike(r"^\d+$")))
    return rows.select(F.get("p", F.lit(0)).alias("word"), F.slice("p", 2, F.size("p") - 1).cast("array<double>").alias("vector"))


def with_row_id(df: DataFrame) -> DataFrame:
    """Adds ``row_id``: unique and in file order within each partition; nothing else names a row of a delimited file."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (unique, in file order) and ``line``. A missing file is an error."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A category dictionary as ``pattern``, ``is_prefix``, ``categories``. It is written by hand, so the driver parses it."""
    return lexicon_frame(spark, parse_dictionary(_whole(spark, path))[1])


def read_norms(spark: SparkSession, path: str) -> DataFrame:
    return parse_norms(read_lines(spark, path))


def read_points(spark: SparkSession, path: str, delimiter: str = ";") -> DataFrame:
    """A numeric file without quoting: the first column is a name and is left out, the last is the label, the rest are whole
    numbers: ``row_id``, ``v`` (array of double), ``label``."""
    df = with_row_id(read_delimited(spark, path, delimiter=delimiter, quote=""))
    names = [c for c in df.columns if c != "row_id"]
    return df.select("row_id", F.array(*[F.col(f"`{c}`").cast("int").cast("double") for c in names[1:-1]]).alias("v"), F.col(f"`{names[-1]}`").alias("label"))


def _whole(spark: SparkSession, path: str) -> str:
    """A small file from any file system."""
    return spark.read.text(path, wholetext=True).head()[0]


def read_plans(path: str, spark: SparkSession | None = None) -> list[dict]:
    """The plans of a file, which has them under ``executions_plans``; with a session from any file system."""
    return json.loads(_whole(spark, path) if spark else Path(path).read_text(encoding="utf-8"))["executions_plans"]


def write_rows(rows: DataFrame, folder: str) -> None:
    """Appends rows to a folder of delimited files with a header each, the columns in the order of the frame."""
    rows.write.mode("append").options(**_WRITTEN).csv(folder)


def write_sample(df: DataFrame, folder: str, quote_all: bool = False) -> None:
    """A sample as one delimited file; it is small by construction."""
    df.coalesce(1).write.mode("overwrite").options(**_WRITTEN, quoteAll=quote_all).csv(folder)
