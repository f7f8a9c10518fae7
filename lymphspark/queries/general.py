"""Queries of the general data-preparation problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.operators.packed_values import CLOSING, OPENING, VALUE, split_values
from lymphspark.operators.reject_rows import load_records
from lymphspark.session import table


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    return load_records(table(spark, folder, "raw_records"), table(spark, folder, "raw_layouts"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder).filter("not is_valid").select("raw_id")


def p2_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder).filter("not is_valid").select("raw_id", "file_name", "reason", F.array_join("bad_fields", ",").alias("bad_fields"))


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return _loaded(spark, folder).filter("is_valid").select("raw_id", "file_name", F.explode("fields").alias("field_name", "value"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    values = split_values(table(spark, folder, "arxiv_cleansed_data"), "row_id", ["terms", "major_terms"], min_values=2, words_apart=True)
    return values.select("row_id", "field_name", "pos", "term")


def p3_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    values = split_values(table(spark, folder, "arxiv_cleansed_data"), "row_id", ["terms", "major_terms"], words_apart=True)
    return values.groupBy("field_name", "delimiter").agg(F.count("*").alias("n_values"), F.countDistinct("row_id").alias("n_rows"))


_Q = "'"


def sql_text(pattern: str) -> str:
    return _Q + pattern.replace(_Q, _Q * 2) + _Q


#: Values of a packed field in SQL, from the column ``x``.
SQL_VALUES = rf"""list_filter(list_transform(regexp_extract_all(x, {sql_text(VALUE)}),
  lambda v: regexp_replace(CASE WHEN regexp_matches(v, {sql_text(OPENING)}) THEN regexp_replace(regexp_replace(v, {sql_text(OPENING)}, ''), {sql_text(CLOSING)}, '') ELSE v END, '^\s+|\s+$', '', 'g')),
  lambda v: v <> '')"""

_P2_JUDGED = r"""
WITH layout AS (
  SELECT file_name, min(delimiter) AS d, count(*) AS n_fields FROM raw_layouts GROUP BY file_name),
shaped AS (
  SELECT raw_id, raw_line, file_name, d, n_fields,
    coalesce(regexp_matches(raw_line, '\A(?:"(?:[^"]|"")*"|[^"\r\n' || d || ']*)(?:[' || d || '](?:"(?:[^"]|"")*"|[^"\r\n' || d || ']*))*\z'), false) AS sound
  FROM raw_records LEFT JOIN layout USING (file_name)),
cut AS (
  SELECT *, CASE WHEN sound THEN regexp_extract_all(d || raw_line, '[' || d || ']("(?:[^"]|"")*"|[^"' || d || ']*)', 1) END AS parts FROM shaped),
cell AS (
  SELECT raw_id, file_name, field_name, value_kind, allowed_values, is_required, raw, trim(raw, E' \t\r\n') AS v
  FROM (SELECT *, CASE WHEN p[1] = '"' THEN replace(p[2:len(p) - 1], '""', '"') ELSE p END AS raw FROM (SELECT raw_id, file_name, unnest(parts) AS p, generate_subscripts(parts, 1) AS field_no FROM cut WHERE sound AND len(parts) = n_fields)
  JOIN raw_layouts USING (file_name, field_no))),
fault AS (
  SELECT raw_id FROM cell WHERE
    CASE WHEN v = '' THEN is_required
         WHEN value_kind = 'choice' THEN NOT list_contains(string_split(lower(allowed_values), '|'), lower(v))
         WHEN value_kind = 'int' THEN NOT regexp_full_match(v, '[0-9]+') OR NOT coalesce(try_cast(v AS BIGINT) BETWEEN cast(split_part(allowed_values, '..', 1) AS BIGINT) AND cast(split_part(allowed_values, '..', 2) AS BIGINT), false)
         WHEN value_kind = 'date' THEN NOT regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(v AS DATE) IS NULL
         ELSE false END)
"""

QUERIES = {"p2_found": p2_found, "p2_rejects": p2_rejects, "p2_loaded": p2_loaded, "p3_found": p3_found, "p3_delimiters": p3_delimiters}

ORACLES = {
    "p2_found": _P2_JUDGED + "SELECT raw_id FROM cut WHERE NOT sound OR len(parts) <> n_fields UNION SELECT raw_id FROM fault",
    "p2_loaded": _P2_JUDGED + "SELECT raw_id, file_name, field_name, CASE WHEN value_kind = 'choice' THEN lower(v) WHEN value_kind IN ('int', 'date') THEN v ELSE raw END AS value FROM cell WHERE raw_id NOT IN (SELECT raw_id FROM fault)",
    "p3_found": f"""
WITH long AS (
  SELECT row_id, 'terms' AS field_name, terms AS x FROM arxiv_cleansed_data UNION ALL SELECT row_id, 'major_terms', major_terms FROM arxiv_cleansed_data),
split AS (SELECT row_id, field_name, {SQL_VALUES} AS vs FROM long WHERE x IS NOT NULL)
SELECT row_id, field_name, cast(generate_subscripts(vs, 1) AS INTEGER) AS pos, unnest(vs) AS term FROM split WHERE len(vs) >= 2""",
}
