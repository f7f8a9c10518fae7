"""Tabular operators, lexica and fixtures that state an operator's whole input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphspark.functions import text as T
from lymphspark.functions.numbers import cosine_similarity, hash_uniform, normalize_vector, round_half_even
from lymphspark.functions.words import unnest, whitespace_tokens
from lymphspark.operators import lexicon, tabular, terms
from lymphspark.operators.network import positions
from lymphspark.operators.packed_values import split_values
from lymphspark.queries.text import _COUNT, _SPLIT, _TOKENS, DOCS, NEWS, Sql, _headline_tokens, _q, texts
from lymphspark.session import table
from lymphspark.sources.fixtures import NORM_LINES, SAMPLE_DICTIONARY

ARXIV, DRUGS, COVID, WELFAKE = "arxiv_cleansed_data", "drugreviews_cleansed_train_data", "covid_cleansed_data", "welfake_cleansed_data"
LABEL = "lower(trim(category))"


def scan_project_text_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, COVID).select("row_id", "content", "category")


def label_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tabular.value_counts(table(spark, folder, COVID), F.expr(LABEL))


def label_percent_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return tabular.percent_distribution(table(spark, folder, COVID), F.expr(LABEL))


def having_min_count(spark: SparkSession, folder: str) -> DataFrame:
    return tabular.value_counts(table(spark, folder, DRUGS), F.col("ailment")).filter("cnt > 20").orderBy(F.desc("cnt"), "label")


def topk_label_semijoin(spark: SparkSession, folder: str) -> DataFrame:
    return tabular.top_k_semijoin(table(spark, folder, DRUGS), "ailment", 3).select("row_id", "ailment")


def null_audit(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, COVID)
    return tabular.null_audit(df, df.columns)


def distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, COVID).select(F.expr(LABEL).alias("label")).distinct()


def cluster_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, COVID).agg(F.countDistinct(F.expr(LABEL)).alias("k"))


def stratified_sample_010(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, WELFAKE).select("row_id", F.expr("lower(trim(label))").alias("label"))
    return tabular.stratified_sample(df, "row_id", "label", 0.10, 42)


def filter_self_nonself(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").filter("label >= 5").select("vec_id", "label")


def tail_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, DRUGS).orderBy(F.desc("row_id")).limit(10).select("row_id", "rating")


def positional_columns(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem")
    return df.select(df.columns[1:-1][:4]).groupBy("l_suppkey").agg(F.count("*").alias("cnt"))


def lineitem_min_max(spark: SparkSession, folder: str) -> DataFrame:
    """Two numeric columns rescaled by their ranges: one pass for the ranges, which are broadcast."""
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    r = F.broadcast(df.agg(*[f(c).alias(f"{n}_{c}") for c in ("l_quantity", "l_extendedprice") for n, f in (("lo", F.min), ("hi", F.max))]))
    scaled = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)), 6).alias(c)
    return df.crossJoin(r).select("l_orderkey", "l_linenumber", scaled("l_quantity"), scaled("l_extendedprice"))


def event_type_share(spark: SparkSession, folder: str) -> DataFrame:
    return tabular.percent_distribution(table(spark, folder, "events"), F.col("event_type"))


# lists in strings


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    """The list literals of the terms column; other notations give null."""
    df = table(spark, folder, ARXIV).filter(r"terms rlike '^\\[\'.*\'\\]$'")
    return df.select("row_id", F.from_json("terms", "array<string>", {"allowSingleQuotes": "true"}).alias("terms"))


# Subject classes that count as physics, as the reference spells them.
PHYSICS = ("atro-ph", "cond-mat", "gr-qc", "hep-ex", "hep-lat", "hep-ph", "hep-th", "math-ph", "nlin", "nucl-ex", "nucl-th", "quant-ph")


def arxiv_clean_terms(spark: SparkSession, folder: str) -> DataFrame:
    strip = F.transform("terms", lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    kept = F.filter(strip, lambda t: t.rlike(r"^[^0-9\s.]+(\.[^0-9^\s]+)*$"))
    major = F.transform(kept, lambda t: F.split(F.lower(t), r"\.")[0])
    mapped = F.transform(major, lambda m: F.when(m.isin(*PHYSICS), "physics").otherwise(m))
    return _terms(spark, folder).select("row_id", F.array_join(F.array_sort(F.array_distinct(mapped)), ",").alias("majors"), (F.size(kept) == 0).alias("is_empty"))


def exploded_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("cnt"))


def rarest_terms(spark: SparkSession, folder: str) -> DataFrame:
    return exploded_term_counts(spark, folder).orderBy("cnt", "term").limit(10)


def _values(spark: SparkSession, folder: str) -> DataFrame:
    return split_values(table(spark, folder, ARXIV), "row_id", ["terms"], words_apart=True)


def term_counts_any_notation(spark: SparkSession, folder: str) -> DataFrame:
    """As exploded_term_counts, over every row, whatever its notation."""
    return _values(spark, folder).groupBy("term").agg(F.count("*").alias("cnt"))


def rarest_terms_any_notation(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts_any_notation(spark, folder).orderBy("cnt", "term").limit(10)


def clean_terms_any_notation(spark: SparkSession, folder: str) -> DataFrame:
    """As arxiv_clean_terms, for every row; rows without values have no majors."""
    lists = _values(spark, folder).filter(F.col("term").rlike(r"^[^0-9\s.]+(\.[^0-9^\s]+)*$")).withColumn("major", F.split(F.lower("term"), r"\.")[0])
    majors = lists.select("row_id", F.when(F.col("major").isin(*PHYSICS), "physics").otherwise(F.col("major")).alias("major")).groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("major")), ",").alias("majors"))
    return table(spark, folder, ARXIV).select("row_id").join(majors, "row_id", "left").select("row_id", F.coalesce("majors", F.lit("")).alias("majors"), F.col("majors").isNull().alias("is_empty"))


# lexica


def lexicon_parse(spark: SparkSession, folder: str) -> DataFrame:
    _, patterns = lexicon.parse_dictionary(SAMPLE_DICTIONARY)
    return lexicon.lexicon_frame(spark, patterns).select("pattern", "is_prefix", F.array_join("categories", ",").alias("categories"))


def _lexicon(spark: SparkSession) -> DataFrame:
    return lexicon.lexicon_frame(spark, lexicon.parse_dictionary(SAMPLE_DICTIONARY)[1])


def _doc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select("doc_id", whitespace_tokens(T.normalize_for_tokens(F.col("text"))).alias("tokens"))


def lexicon_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    words = unnest(_doc_tokens(spark, folder).select(F.col("tokens").alias("token")), "token")
    return lexicon.match_lexicon(words, _lexicon(spark)).select("token", F.array_join("categories", ",").alias("categories"))


def lexicon_category_profile(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.category_profile(_doc_tokens(spark, folder), "doc_id", _lexicon(spark))


def word_count_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """The token count of each text, rescaled over the collection: the only profile column that is."""
    n = _doc_tokens(spark, folder).select("doc_id", F.size("tokens").cast("double").alias("wc"))
    r = F.broadcast(n.agg(F.min("wc").alias("lo"), F.max("wc").alias("hi")))
    return n.crossJoin(r).select("doc_id", F.round(F.coalesce(F.try_divide(F.col("wc") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)), 6).alias("wc"))


def fixed_width_parse(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(NORM_LINES)), "line_no long, line string")
    long = lexicon.parse_norms(lines).select("word", "wtype", F.posexplode("vals").alias("at", "value"))
    return long.filter("value <> 0").select("word", "wtype", F.col("at").cast("long").alias("place"), F.col("value").cast("long").alias("value"))


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    t = whitespace_tokens(T.normalize_for_tokens(F.col("headline")))
    return table(spark, folder, NEWS).select("row_id", t.alias("tokens")).withColumn("tags", lexicon.suffix_tags(F.col("tokens")))


def tag_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.tag_distribution(_tagged(spark, folder), "row_id").select("row_id", "tag", F.round("share", 6).alias("share"))


def psycholinguistic_profile(spark: SparkSession, folder: str) -> DataFrame:
    norms = lexicon.parse_norms(spark.createDataFrame(list(enumerate(NORM_LINES)), "line_no long, line string"))
    return lexicon.norm_profile(_tagged(spark, folder), "row_id", norms).select("row_id", "dim", F.round("value", 6).alias("value"))


# word vectors from keys


def _vectors(words: DataFrame, dims: int = 8) -> DataFrame:
    spread = words.select("word", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"))
    return spread.select("word", "dim", hash_uniform("word", "dim").alias("x"))


def avg_word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _headline_tokens(spark, folder)
    known = tokens.select(F.explode("tokens").alias("word")).distinct().filter("length(word) > 3")
    return terms.average_vectors(tokens, _vectors(known), "row_id").select("row_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def subword_avg_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A word's vector is the mean of those of its character n-grams, by bucket; a row's the mean over its tokens."""
    tokens = _headline_tokens(spark, folder)
    grams = tokens.select(F.explode("tokens").alias("word")).distinct().select("word", F.explode(terms.char_ngrams(F.col("word"))).alias("gram"))
    bucket = grams.select("word", terms.hash_bucket(F.col("gram")).cast("string").alias("b"))
    spread = bucket.select("word", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dim"))
    vectors = spread.groupBy("word", "dim").agg(F.avg(hash_uniform("b", "dim")).alias("x"))
    return terms.average_vectors(tokens, vectors, "row_id").select("row_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


# numbers and seeded series


def round_half_even_fixture(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(float(x),) for x in (0.5, 1.5, 2.5, -0.5, 7.5, 6.5, 2.4)], "x double").select("x", round_half_even(F.col("x")).alias("y"))


def norma_vector(spark: SparkSession, folder: str) -> DataFrame:
    v = normalize_vector(F.col("embedding").cast("array<double>"))
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(v).alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def hash_uniform_series(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(10_000).select("id", hash_uniform(777, "id").alias("u"))


def gen_two_spirals(spark: SparkSession, folder: str) -> DataFrame:
    """Two mirrored spirals with noise, from seeded keys."""
    theta = F.sqrt(hash_uniform(1, "id", F.lit("t"))) * F.lit(780 * 2 * 3.141592653589793 / 360)
    arm = spark.range(200).withColumn("theta", theta).select("id", (-F.cos("theta") * F.col("theta") + hash_uniform(1, "id", F.lit("x")) * 0.5).alias("x"), (F.sin("theta") * F.col("theta") + hash_uniform(1, "id", F.lit("y")) * 0.5).alias("y"))
    both = arm.select("id", "x", "y", F.lit(0).alias("label")).unionByName(arm.select("id", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"), F.lit(1).alias("label")))
    return both.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "label")


def crossover_points(spark: SparkSession, folder: str) -> DataFrame:
    """Nine cut points out of 1..64 without replacement, in order."""
    drawn = spark.range(1, 65).orderBy(hash_uniform(777, "id"), "id").limit(9)
    return drawn.select(F.col("id").alias("cut"))


def hypermutation_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Antigens in a seeded order, each with a rate that decays by its position."""
    placed = positions(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id")), 777, 1)
    return placed.select(F.col("id").alias("vec_id"), (F.col("pos") + 1).cast("long").alias("pos")).select("vec_id", "pos", F.round(F.lit(4.0) * F.pow(F.lit(0.9), F.col("pos") - 1), 9).alias("rate"))


def ruspini_label_encode(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select("r_name", (F.ascii(F.lower("r_name")) - 97).cast("long").alias("code"))


def cosine_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine similarity of each vector with the next by id."""
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(other, "vec_id").select("vec_id", F.round(cosine_similarity(F.col("v"), F.col("w")), 6).alias("cosine"))


def precomputed_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return tabular.to_long(table(spark, folder, "embeddings"), "vec_id", F.col("embedding")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def minmax_columns(spark: SparkSession, folder: str) -> DataFrame:
    scaled = tabular.min_max(table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding")
    return tabular.to_long(scaled, "vec_id", F.col("embedding")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def union_population(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "label")
    return tabular.union_all(e, e.filter("label < 3"))


_FUNCTIONS = (
    scan_project_text_labels, label_value_counts, label_percent_distribution, having_min_count, topk_label_semijoin, null_audit, distinct_labels, cluster_count,
    stratified_sample_010, filter_self_nonself, tail_rows, positional_columns, lineitem_min_max, event_type_share, arxiv_clean_terms, exploded_term_counts, rarest_terms,
    lexicon_parse, lexicon_prefix_join, lexicon_category_profile, word_count_scaled, fixed_width_parse, tag_distribution, psycholinguistic_profile, avg_word_vectors,
    term_counts_any_notation, rarest_terms_any_notation, clean_terms_any_notation, subword_avg_vectors, norma_vector, gen_two_spirals, crossover_points, hypermutation_schedule, ruspini_label_encode, cosine_neighbours, precomputed_embeddings,
    minmax_columns, union_population,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {"round_half_even": round_half_even_fixture, "hash_uniform": hash_uniform_series}


def _u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT / 281474976710656.0)"


_LEX = "(VALUES " + ", ".join(f"({_q(p.split('*')[0])}, {'true' if '*' in p else 'false'}, {_q(','.join(c))})" for p, c in lexicon.parse_dictionary(SAMPLE_DICTIONARY)[1].items()) + ") AS lex(pattern, is_prefix, categories)"
_DOC = f"SELECT doc_id, coalesce({_SPLIT(Sql.for_tokens('text'))}, []) AS t FROM {DOCS}"
_MATCH = f"""hit AS (SELECT token, coalesce(
    (SELECT arg_min(categories, len(pattern)) FROM {_LEX} WHERE is_prefix AND starts_with(token, pattern)),
    (SELECT any_value(categories) FROM {_LEX} WHERE NOT is_prefix AND pattern = token)) AS categories FROM (SELECT DISTINCT token FROM word))"""
_TAG = f"""CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'NUM' WHEN w IN ('the','a','an','this','that','every','no') THEN 'DET' WHEN w IN ('i','you','he','she','it','we','they') THEN 'PRON'
  WHEN w IN ('and','or','but') THEN 'CCONJ' WHEN w IN ('in','on','at','of','for','to','with','by','from') THEN 'ADP' WHEN w IN ('is','are','was','were','be','has','have') THEN 'AUX'
  WHEN regexp_matches(w, 'ly$') THEN 'ADV' WHEN regexp_matches(w, '(ed|ing|ise|ize)$') THEN 'VERB' WHEN regexp_matches(w, '(ful|ous|ive|al|ic|less)$') THEN 'ADJ' ELSE 'NOUN' END"""
_HEAD = f"SELECT row_id, coalesce({_SPLIT(Sql.for_tokens('headline'))}, []) AS t FROM {NEWS}"
_LIST = rf"""SELECT row_id, list_transform(regexp_extract_all(terms, '''[^'']*''|"[^"]*"'), lambda x: x[2:len(x) - 1]) AS ts FROM {ARXIV} WHERE regexp_matches(terms, '^\[''.*''\]$')"""
_LINES = "(VALUES " + ", ".join(f"({k}, {_q(line)})" for k, line in enumerate(NORM_LINES)) + ") AS l(line_no, line)"
_VALS = ", ".join([f"coalesce(try_cast(trim(substr(line, {a + 1}, {b - a})) AS INTEGER), 0)" for _, a, b in lexicon.FIELDS] + [f"CASE WHEN substr(line, {lexicon.FLAG_AT + 1}, 1) = 'Q' THEN 1 ELSE 0 END"] + [f"CASE WHEN upper(substr(line, {at + 1}, 1)) = {_q(c)} THEN 1 ELSE 0 END" for at, codes in lexicon.CODES for c, _ in codes])
_NORMS = f"norm AS (SELECT word, wtype, arg_max(vals, line_no) AS vals FROM (SELECT line_no, lower(trim(split_part(substr(line, {lexicon.WORD_AT + 1}), '|', 1))) AS word, substr(line, {lexicon.TYPE_AT + 1}, 1) AS wtype, [{_VALS}] AS vals FROM {_LINES}) GROUP BY ALL)"
_TYPES = "(VALUES " + ", ".join(f"({_q(t)}, {_q(w)})" for t, w in lexicon.WORD_TYPES) + ") AS ty(tag, wtype)"
_DIMS = "[" + ", ".join(map(_q, lexicon.DIMENSIONS)) + "]"
_LONG = "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings"
_CLEAN = r"list_filter(list_transform(ts, lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: regexp_full_match(t, '[^0-9\s.]+(\.[^0-9^\s]+)*'))"

# Values of any notation: between a pair of quotes of any kind, or an unbroken run of letters, digits, dots and hyphens.
_ANY = r"""SELECT row_id, term FROM (SELECT row_id, trim(CASE WHEN regexp_matches(v, '^\\*["''‘“«`]') THEN regexp_replace(regexp_replace(v, '^\\*["''‘“«`]\s*', ''), '\s*\\*["''’”»`]$', '') ELSE v END, E' \t\r\n') AS term
  FROM (SELECT row_id, unnest(regexp_extract_all(terms, '\\*"[^"]*"|\\*''[^'']*''|\\*‘[^’]*’|\\*“[^”]*”|\\*«[^»]*»|\\*`[^`]*`|[\p{L}\p{Nd}.\-]+')) AS v FROM arxiv_cleansed_data WHERE terms IS NOT NULL)) WHERE term <> ''"""
_GRAM_BUCKETS = """g AS (SELECT word, substr('<' || word || '>', i, n) AS gram FROM w, range(3, 7) AS ns(n), range(1, 2000) AS pos(i) WHERE i + n - 1 <= len(word) + 2),
bucket AS (SELECT word, (('0x' || substr(md5(gram), 1, 12))::BIGINT % 2000000)::VARCHAR AS b FROM g)"""

ORACLES = {
    "term_counts_any_notation": f"SELECT term, count(*) AS cnt FROM ({_ANY}) GROUP BY 1",
    "rarest_terms_any_notation": f"SELECT term, count(*) AS cnt FROM ({_ANY}) GROUP BY 1 ORDER BY cnt, term LIMIT 10",
    "clean_terms_any_notation": rf"""WITH m AS (SELECT row_id, split_part(lower(term), '.', 1) AS m FROM ({_ANY}) WHERE regexp_full_match(term, '[^0-9\s.]+(\.[^0-9^\s]+)*')),
l AS (SELECT row_id, string_agg(DISTINCT CASE WHEN m IN ({', '.join(map(_q, PHYSICS))}) THEN 'physics' ELSE m END, ',' ORDER BY CASE WHEN m IN ({', '.join(map(_q, PHYSICS))}) THEN 'physics' ELSE m END) AS majors FROM m GROUP BY row_id)
SELECT row_id, coalesce(majors, '') AS majors, majors IS NULL AS is_empty FROM {ARXIV} LEFT JOIN l USING (row_id)""",
    "subword_avg_vectors": f"""WITH tok AS ({_TOKENS}), t AS (SELECT row_id, len(t) AS n, unnest(t) AS word FROM tok), w AS (SELECT DISTINCT word FROM t), {_GRAM_BUCKETS},
vec AS (SELECT word, dim, avg({_u('b', 'dim')}) AS x FROM bucket, range(8) AS r(dim) GROUP BY word, dim)
SELECT row_id, dim, round(sum(x) / any_value(n), 6) AS value FROM t JOIN vec USING (word) GROUP BY row_id, dim""",
    "scan_project_text_labels": f"SELECT row_id, content, category FROM {COVID}",
    "label_value_counts": f"SELECT {LABEL} AS label, count(*) AS cnt FROM {COVID} GROUP BY 1",
    "label_percent_distribution": f"SELECT {LABEL} AS label, count(*) AS cnt, round_even(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM {COVID} GROUP BY 1",
    "having_min_count": f"SELECT ailment AS label, count(*) AS cnt FROM {DRUGS} GROUP BY 1 HAVING count(*) > 20",
    "topk_label_semijoin": f"SELECT row_id, ailment FROM {DRUGS} WHERE ailment IN (SELECT ailment FROM {DRUGS} WHERE ailment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)",
    "null_audit": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM {COVID}" for c in ("row_id", "article_id", "title", "content", "category", "published_at", "loaded_at")),
    "distinct_labels": f"SELECT DISTINCT {LABEL} AS label FROM {COVID}",
    "cluster_count": f"SELECT count(DISTINCT {LABEL}) AS k FROM {COVID}",
    "stratified_sample_010": f"""WITH k AS (SELECT row_id, lower(trim(label)) AS label, {_u("'42'", 'row_id')} AS u FROM {WELFAKE})
SELECT row_id, label FROM k QUALIFY row_number() OVER (PARTITION BY label ORDER BY u, row_id) <= round_even(0.1::DOUBLE * count(*) OVER (PARTITION BY label), 0)""",
    "filter_self_nonself": "SELECT vec_id, label FROM embeddings WHERE label >= 5",
    "tail_rows": f"SELECT row_id, rating FROM {DRUGS} ORDER BY row_id DESC LIMIT 10",
    "positional_columns": "SELECT l_suppkey, count(*) AS cnt FROM lineitem GROUP BY 1",
    "lineitem_min_max": """SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity,
round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS l_extendedprice FROM lineitem""",
    "event_type_share": "SELECT event_type AS label, count(*) AS cnt, round_even(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM events GROUP BY 1",
    "arxiv_clean_terms": f"""WITH l AS ({_LIST}), c AS (SELECT row_id, {_CLEAN} AS kept FROM l)
SELECT row_id, array_to_string(list_sort(list_distinct(list_transform(kept, lambda t: CASE WHEN split_part(lower(t), '.', 1) IN ({', '.join(map(_q, PHYSICS))}) THEN 'physics' ELSE split_part(lower(t), '.', 1) END))), ',') AS majors, len(kept) = 0 AS is_empty FROM c""",
    "exploded_term_counts": f"SELECT term, count(*) AS cnt FROM (SELECT unnest(ts) AS term FROM ({_LIST})) GROUP BY 1",
    "rarest_terms": f"SELECT term, count(*) AS cnt FROM (SELECT unnest(ts) AS term FROM ({_LIST})) GROUP BY 1 ORDER BY cnt, term LIMIT 10",
    "lexicon_parse": f"SELECT pattern, is_prefix, categories FROM {_LEX}",
    "lexicon_prefix_join": f"WITH d AS ({_DOC}), word AS (SELECT unnest(t) AS token FROM d), {_MATCH} SELECT token, categories FROM hit WHERE categories IS NOT NULL",
    "lexicon_category_profile": f"""WITH d AS ({_DOC}), word AS (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM d), {_MATCH}
SELECT doc_id, category, round_even(count(*) / any_value(n), 8) AS share FROM (SELECT doc_id, n, unnest(string_split(categories, ',')) AS category FROM word JOIN hit USING (token) WHERE categories IS NOT NULL) GROUP BY ALL""",
    "word_count_scaled": f"WITH d AS (SELECT doc_id, len(t)::DOUBLE AS wc FROM ({_DOC})) SELECT doc_id, round((wc - min(wc) OVER ()) / (max(wc) OVER () - min(wc) OVER ()), 6) AS wc FROM d",
    "fixed_width_parse": f"WITH {_NORMS} SELECT word, wtype, place, value FROM (SELECT word, wtype, generate_subscripts(vals, 1) - 1 AS place, unnest(vals)::BIGINT AS value FROM norm) WHERE value <> 0",
    "tag_distribution": f"WITH h AS ({_HEAD}) SELECT row_id, tag, round(count(*) / any_value(n), 6) AS share FROM (SELECT row_id, n, {_TAG} AS tag FROM (SELECT row_id, len(t) AS n, unnest(t) AS w FROM h)) GROUP BY ALL",
    "psycholinguistic_profile": f"""WITH h AS ({_HEAD}), {_NORMS}, z AS (SELECT row_id, n, w AS word, {_TAG} AS tag FROM (SELECT row_id, greatest(len(t), 1) AS n, unnest(t) AS w FROM h)),
v AS (SELECT row_id, n, generate_subscripts(vals, 1) AS place, unnest(vals) AS x FROM z JOIN {_TYPES} USING (tag) JOIN norm USING (word, wtype))
SELECT row_id, {_DIMS}[place] AS dim, round(sum(x) / any_value(n), 6) AS value FROM v WHERE x <> 0 GROUP BY row_id, place""",
    "avg_word_vectors": f"""WITH tok AS ({_TOKENS}), w AS (SELECT row_id, len(t) AS n, unnest(t) AS word FROM tok)
SELECT row_id, dim, round(sum({_u('word', 'dim')}) / any_value(n), 6) AS value FROM w, range(8) AS r(dim) WHERE len(word) > 3 GROUP BY row_id, dim""",
    "norma_vector": f"SELECT vec_id, dim, round((value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE max(value) OVER w - min(value) OVER w END, 6) AS value FROM ({_LONG}) WINDOW w AS (PARTITION BY vec_id)",
    "gen_two_spirals": f"""WITH a AS (SELECT range AS id, sqrt({_u("'1'", 'range', "'t'")}) * (780 * 2 * 3.141592653589793::DOUBLE / 360) AS th FROM range(200)),
b AS (SELECT id, -cos(th) * th + {_u("'1'", 'id', "'x'")} * 0.5 AS x, sin(th) * th + {_u("'1'", 'id', "'y'")} * 0.5 AS y FROM a)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, 0::INTEGER AS label FROM b UNION ALL SELECT id, round(-x, 6), round(-y, 6), 1::INTEGER FROM b""",
    "crossover_points": f"SELECT range AS cut FROM range(1, 65) ORDER BY {_u(repr('777'), 'range')}, range LIMIT 9",
    "hypermutation_schedule": f"WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY {_u(repr('777'), repr('1'), 'vec_id')}, vec_id) AS pos FROM embeddings) SELECT vec_id, pos, round(4.0::DOUBLE * pow(0.9::DOUBLE, pos - 1), 9) AS rate FROM p",
    "ruspini_label_encode": "SELECT r_name, (ascii(lower(r_name)) - 97)::BIGINT AS code FROM region",
    "cosine_neighbours": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "precomputed_embeddings": f"SELECT vec_id, dim, round(value, 6) AS value FROM ({_LONG})",
    "minmax_columns": f"SELECT vec_id, dim, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 6) AS value FROM ({_LONG}) WINDOW w AS (PARTITION BY dim)",
    "union_population": "SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings WHERE label < 3",
    "round_half_even": "SELECT x, round_even(x, 0) AS y FROM (SELECT unnest([0.5, 1.5, 2.5, -0.5, 7.5, 6.5, 2.4]::DOUBLE[]) AS x)",
    "hash_uniform": f"SELECT range AS id, {_u(repr('777'), 'range')} AS u FROM range(10000)",
}
