"""Words as array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letter_words(text: Column) -> Column:
    """Longest runs of letters of any script, in lower case, in order. Null text gives an empty array."""
    return _runs(text, r"[^\p{L}]+")


def letter_digit_words(text: Column) -> Column:
    """Longest runs of letters or digits, in lower case, in order. Null text gives an empty array."""
    return _runs(text, r"[^\p{L}\p{N}]+")


def _runs(text: Column, other: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), other), "")


def whitespace_tokens(text: Column) -> Column:
    """``str.split()``: pieces between runs of white space, without empty ones; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\s\x1c-\x1f]+"), "")


def remove_stop_words(tokens: Column, stop_words: Iterable[str], lemma: Callable[[Column], Column] | None = None) -> Column:
    """The tokens, in lower case, that aren't stop words. ``lemma`` makes an array of lemmas from an array of tokens, as a column;
    these are compared and kept then. Null gives null."""
    found = F.transform(lemma(tokens) if lemma else tokens, F.lower)
    words = sorted(stop_words)
    return F.filter(found, lambda w: ~w.isin(words)) if words else found


def unnest(df: DataFrame, column: str) -> DataFrame:
    """One row per element of an array column, which keeps its name; null and empty arrays give none. Elements aren't null.

    The outer form is used since the inner one makes the optimizer infer a filter on the array's size, which it pushes below
    and so computes a costly array twice more, before any exchange.
    """
    return df.withColumn(column, F.explode_outer(column)).filter(F.col(column).isNotNull())
