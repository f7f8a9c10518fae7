"""Fields that hold several values with inconsistent delimiters and quoting: one value per row, in order.

The delimiter is inferred for each source, a source being a field together with the punctuation its notation uses. Every
candidate is scored by the pieces that it cuts: how regular their types are (a quoted value, a code, a word or phrase) and how consistent their number is over the rows. A field is cut at the delimiter of its source; a piece of a regular
type is a value, and only pieces that still hold several values, as another delimiter was mixed in, are cut further.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delimiters that are tried, first in ties.
CANDIDATES = (";", "|", ",", "/", "\t", "\n", " ")

#: Pairs of quotes; a backslash before a quote belongs to it.
_PAIRS = (('"', '"'), ("'", "'"), ("‘", "’"), ("“", "”"), ("«", "»"), ("`", "`"))
_QUOTED = "|".join(rf"\\*{a}[^{b}]*{b}" for a, b in _PAIRS)
_BLANK = "|".join(rf"\\*{a}[\s\\]*{b}" for a, b in _PAIRS)
_RUN = r"[\p{L}\p{Nd}.\-]+"
_WORD = r"[\p{L}\-]+"
_CODE = r"(?<![\p{L}\-])[\p{L}\-]*+[\p{Nd}.][\p{L}\p{Nd}.\-]*"
#: As a pattern for Java and RE2 alike.
VALUE = f"{_QUOTED}|{_RUN}"
#: Words that only spaces part; classes without groups, as these would recurse once a word.
_PHRASE = r"[\p{L}\-][\p{L}\- ]*(?<=[\p{L}\-])"
#: As VALUE where phrases are one value.
PHRASES = rf"{_QUOTED}|{_PHRASE}(?![\p{{L}}\p{{Nd}}.\-])|{_RUN}"
OPENING = r"""^\\*["'‘“«`]\s*"""
CLOSING = r"""\s*\\*["'’”»`]$"""
#: Stand for a quoted value, a code, and a word or phrase in a skeleton.
_MARKS = "\ue000\ue010\ue011"
_Q, _C, _W = _MARKS
_BRACKETS = r"^[\s\[\](){}]+|[\s\[\](){}]+$"
#: Stand for the delimiters inside quotes while a field is cut.
_HIDDEN = "\ue001\ue002\ue003\ue004\ue005\ue006\ue007"


def _clean(value: Column) -> Column:
    bare = F.when(value.rlike(OPENING), F.regexp_replace(F.regexp_replace(value, OPENING, ""), CLOSING, "")).otherwise(value)
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def values_in(text: Column, pattern: str = VALUE) -> Column:
    """All values of a field in order, without quotes, backslashes before them and outer white space; blank ones left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.filter(F.transform(found, _clean), lambda v: v != "")


def skeleton(text: Column, words_apart: bool = False) -> Column:
    """The field with each quoted value, code, and word or phrase replaced by a mark: what is left are brackets and delimiters."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK, "")
    for pattern, mark in ((_QUOTED, _Q), (_CODE, _C), (_WORD if words_apart else _PHRASE, _W)):
        bare = F.regexp_replace(bare, pattern, mark)
    return bare


def _types(skel: Column, d: str) -> Column:
    """Types of the pieces that hold any value: the mark of the only value, or a blank for several."""
    bare = F.transform(F.split(skel, F.lit("\\Q" + d + "\\E")), lambda p: F.regexp_replace(p, _BRACKETS, ""))
    kept = F.filter(bare, lambda p: p.rlike(f"[{_MARKS}]"))
    return F.transform(kept, lambda p: F.when(F.length(p) == 1, p).otherwise(""))


def infer_delimiters(fields: DataFrame) -> DataFrame:
    """Best delimiter of each source: ``source``, ``delimiter``, ``score``. ``fields`` has ``source`` and ``skeleton``.

    The score is regularity times consistency. Regularity: the share of pieces that have the commonest type of one value.
    Consistency: the share of rows that are cut at all, over 1 + the coefficient of variation of the number of pieces.
    Ties go to the first of CANDIDATES. Sources in which nothing is cut into single values have a null delimiter.
    """
    counted = fields.groupBy("source", "skeleton").count()
    several = counted.filter(F.length("skeleton") - F.length(F.translate("skeleton", _MARKS, "")) > 1)
    tried = several.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("delimiter"), _types(F.col("skeleton"), d).alias("types")) for k, d in enumerate(CANDIDATES)])).alias("c"))
    w, n = F.col("count"), F.size("c.types")
    typed = [F.sum((n - F.size(F.array_remove("c.types", v))) * w) for v in _MARKS]
    score = tried.groupBy("source", "c.k", "c.delimiter").agg(
        F.greatest(*typed).alias("regular"), F.sum(n * w).alias("pieces"), F.sum(n * n * w).alias("squares"), F.sum(F.when(n > 1, w).otherwise(0)).alias("cut"), F.sum(w).alias("rows"),
    )
    mean = F.col("pieces") / F.col("rows")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("rows") - mean * mean, F.lit(0.0))) / mean
    value = F.when(F.col("pieces") > 0, F.col("regular") / F.col("pieces") * F.col("cut") / F.col("rows") / (1 + spread)).otherwise(0.0)
    best = score.withColumn("score", value).groupBy("source").agg(F.max_by(F.struct("delimiter", "score"), F.struct("score", -F.col("k"))).alias("b"))
    return best.select("source", F.when(F.col("b.score") > 0, F.col("b.delimiter")).alias("delimiter"), F.col("b.score").alias("score"))


def split_values(df: DataFrame, id_col: str, columns: list[str], min_values: int = 1, words_apart: bool = False) -> DataFrame:
    """One row per value: the id, ``field_name``, ``pos`` (int, from 1), ``term``, ``delimiter`` of the source and ``n_values``.

    A row is cut at the delimiter of its source where that stands outside quotes. A piece that is one value by its type is
    one; a piece that holds several (another delimiter was mixed in) gives all of them in order, so that no value is lost.
    Words that only spaces part are one value, or with ``words_apart`` one each. ``min_values`` leaves out fields with fewer values.
    Null, empty and blank fields and empty lists give no rows; repeated values count each; repeated rows come out each.
    """
    long = reduce(DataFrame.unionByName, [df.select(F.col(id_col), F.lit(c).alias("field_name"), F.col(c).cast("string").alias("text")) for c in columns])
    long = long.filter(F.col("text").isNotNull()).withColumn("skeleton", skeleton(F.col("text"), words_apart))
    signs = F.array_sort(F.array_distinct(F.split(F.translate("skeleton", _MARKS, ""), "")))
    long = long.withColumn("source", F.concat_ws(" ", "field_name", F.array_join(signs, "")))
    best = infer_delimiters(long)
    joined = long.join(best, "source", "left")
    spaced = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(_QUOTED), F.lit(0))), lambda q: q.rlike(r"[;|,/\s]"))
    hidden = F.aggregate(spaced, F.col("text"), lambda text, q: F.replace(text, q, F.translate(q, "".join(CANDIDATES), _HIDDEN)))
    pieces = F.when(F.col("delimiter").isNull(), F.array("text")).otherwise(F.split(hidden, F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E"))))
    one = rf"^(?:{_QUOTED}|{_RUN}{'' if words_apart else f'|{_PHRASE}'})$"
    bare = F.transform(pieces, lambda p: F.regexp_replace(F.translate(p, _HIDDEN, "".join(CANDIDATES)), _BRACKETS, ""))
    values = F.flatten(F.transform(bare, lambda p: F.when(p == "", F.array().cast("array<string>")).when(p.rlike(one), F.array(_clean(p))).otherwise(values_in(p, VALUE if words_apart else PHRASES))))
    kept = joined.withColumn("values", F.filter(values, lambda v: v != "")).filter(F.size("values") >= min_values)
    out = kept.select(F.col(id_col), "field_name", "delimiter", F.size("values").alias("n_values"), F.posexplode("values").alias("p", "term"))
    return out.select(id_col, "field_name", (F.col("p") + 1).cast("int").alias("pos"), "term", "delimiter", "n_values")
