"""Text functions, tokens, n-grams and tf-idf over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphspark.functions import text as T
from lymphspark.functions.words import whitespace_tokens
from lymphspark.operators import terms
from lymphspark.session import spread, table

DOCS, NEWS = "documents", "newspopularity_cleansed_train_file"

# A short list of English function words.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "in", "is", "it", "its", "my", "no", "not", "of", "on", "or", "our", "that", "the", "their", "this", "to", "was", "we", "were", "what", "when", "why", "with", "you", "your")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Sql:
    """The same functions in SQL, as strings."""

    @staticmethod
    def sub(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {_q(pattern)}, {_q(to)}, 'g')"

    @classmethod
    def ascii(cls, x: str, fold_case: bool) -> str:
        single, made, several = T.ascii_table(fold_case)
        out = x
        for c, to in several:
            out = f"replace({out}, {_q(c)}, {_q(to)})"
        return cls.sub(f"translate({out}, {_q(single)}, {_q(made)})", r"[^\x00-\x7f]", "")

    @classmethod
    def collapse(cls, x):
        return cls.sub(x, f"[{T.SPACE}]{{2,}}", " ")

    @classmethod
    def trim(cls, x):
        return cls.sub(x, f"^[{T.SPACE}]+|[{T.SPACE}]+$", "")

    @classmethod
    def special(cls, x):
        return cls.collapse(cls.sub(x, T.SPECIAL, " "))

    @classmethod
    def punctuation(cls, x):
        return cls.collapse(cls.sub(x, f"[{T.PUNCTUATION}]", " "))

    @classmethod
    def numbers(cls, x):
        return cls.collapse(cls.sub(x, rf"(?i)[{T.DIGIT}]+(st|nd|rd|th)?", ""))

    @classmethod
    def apostrophe(cls, x):
        return cls.collapse(cls.sub(x, f"[{T.QUOTES}]", " "))

    @classmethod
    def no_spaces(cls, x):
        return cls.sub(x, f"[{T.SPACE}]", "")

    @classmethod
    def contractions(cls, x):
        return cls.sub(x, f"([{T.WORD}]+)([{T.QUOTES}]+)([{T.WORD}]{{1,3}})", r"\1 '\3")

    @classmethod
    def single(cls, x):
        return cls.sub(x, f"[{T.DOUBLE}]", "'")

    @classmethod
    def quotations(cls, x):
        for pattern, to in T.QUOTATION_RULES:
            x = cls.sub(x, pattern, to.replace("$", "\\"))
        return cls.collapse(x)

    @classmethod
    def normal(cls, x):
        return cls.quotations(cls.trim(cls.collapse(cls.special(cls.ascii(f"lower({x})", True)))))

    @classmethod
    def for_tokens(cls, x):
        return cls.punctuation(cls.normal(x))

    @classmethod
    def for_ngrams(cls, x):
        return cls.single(cls.contractions(cls.numbers(cls.punctuation(cls.normal(x)))))


_FUNCTIONS = {
    "fn_casefold": (T.casefold, lambda x: f"translate(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"),
    "fn_remove_accents": (T.remove_accents, lambda x: Sql.ascii(x, False)),
    "fn_remove_special_chars": (T.remove_special_chars, Sql.special),
    "fn_remove_punctuations": (T.remove_punctuations, Sql.punctuation),
    "fn_remove_numbers": (T.remove_numbers, Sql.numbers),
    "fn_collapse_spaces": (T.collapse_spaces, Sql.collapse),
    "fn_trim_ws": (T.trim_ws, Sql.trim),
    "fn_remove_apostrophe": (T.remove_apostrophe, Sql.apostrophe),
    "fn_remove_all_spaces": (T.remove_all_spaces, Sql.no_spaces),
    "fn_split_contractions": (T.split_contractions, Sql.contractions),
    "fn_single_quotes": (T.single_quotes, Sql.single),
    "fn_strip_quotations": (T.strip_quotations, Sql.quotations),
    "text_normalize": (T.normalize_text, Sql.normal),
    "text_normalize_tokens": (T.normalize_for_tokens, Sql.for_tokens),
    "text_normalize_ngram": (T.normalize_for_ngrams, Sql.for_ngrams),
}


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, DOCS).select("doc_id", "lang", "text"))


def _scalar(f):
    return lambda spark, folder: texts(spark, folder).select("doc_id", f(F.col("text")).alias("out"))


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    t = whitespace_tokens(T.normalize_for_tokens(F.col("text")))
    return texts(spark, folder).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def stopword_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    t = whitespace_tokens(T.normalize_for_tokens(F.col("headline")))
    kept = F.filter(t, lambda w: ~w.isin(*STOP_WORDS))
    return table(spark, folder, NEWS).select("row_id", F.posexplode(kept).alias("p", "token")).select("row_id", (F.col("p") + 1).cast("long").alias("pos"), "token")


def regex_predicates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, DOCS).select("doc_id", F.col("text").rlike("[0-9]").alias("has_digit"), F.col("text").rlike("(?i)^the").alias("starts_the"), F.col("text").rlike(r"^[^0-9.]+$").alias("plain"))


def _headline_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, NEWS).select("row_id", "headline")).select("row_id", T.ngram_tokens(T.normalize_for_ngrams(F.col("headline"))).alias("tokens"))


def ngram_count_1(spark: SparkSession, folder: str) -> DataFrame:
    return terms.ngram_counts(_headline_tokens(spark, folder), "row_id", F.col("tokens"))


def ngram_count_1_3(spark: SparkSession, folder: str) -> DataFrame:
    return terms.ngram_counts(_headline_tokens(spark, folder), "row_id", F.col("tokens"), 1, 3)


def ngram_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return terms.vocabulary(ngram_count_1(spark, folder))


def tfidf_l2(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, NEWS).agg(F.count("*").alias("n"))
    return terms.tfidf(ngram_count_1(spark, folder), "row_id", n).select("row_id", "term", F.round("weight", 6).alias("weight"))


def bigram_collocations(spark: SparkSession, folder: str) -> DataFrame:
    t = whitespace_tokens(T.normalize_for_tokens(F.col("text")))
    return terms.collocations(texts(spark, folder), t, min_count=5).select("w1", "w2", F.round("score", 6).alias("score"))


def char_ngram_buckets(spark: SparkSession, folder: str) -> DataFrame:
    words = _headline_tokens(spark, folder).select(F.explode("tokens").alias("token")).distinct()
    return words.select("token", F.explode(terms.char_ngrams(F.col("token"))).alias("gram")).distinct().select("token", "gram", terms.hash_bucket(F.col("gram")).alias("bucket"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Three heaviest tf-idf terms of each language."""
    docs = texts(spark, folder).filter("lang is not null")
    tokens = docs.select("doc_id", T.ngram_tokens(T.normalize_for_ngrams(F.col("text"))).alias("tokens"))
    weights = terms.tfidf(terms.ngram_counts(tokens, "doc_id", F.col("tokens")), "doc_id", docs.agg(F.count("*").alias("n")))
    mean = weights.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "term").agg(F.round(F.avg("weight"), 6).alias("mean_weight"), F.count("*").alias("docs"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("mean_weight"), "term"))
    return mean.withColumn("rk", rank).filter("rk <= 3").select("lang", F.col("rk").cast("long").alias("rk"), "term", "mean_weight", "docs")


QUERIES = {name: _scalar(f) for name, (f, _) in _FUNCTIONS.items()} | {
    f.__name__: f for f in (tokenize, stopword_antijoin, regex_predicates, ngram_count_1, ngram_count_1_3, ngram_vocabulary, tfidf_l2, bigram_collocations, char_ngram_buckets)
} | {"flagship_tfidf": flagship}

_SPLIT = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\s\\x1c-\\x1f]+'), lambda w: w <> '')"
# A run of word characters of any length, of which those of two and more are tokens.
_TOKENS = f"SELECT row_id, list_filter(regexp_extract_all({Sql.for_ngrams('headline')}, '[a-zA-Z0-9_]+'), lambda w: len(w) >= 2) AS t FROM {NEWS} WHERE headline IS NOT NULL"
_COUNT = f"WITH tok AS ({_TOKENS}), cnt AS (SELECT row_id, term, count(*) AS cnt FROM (SELECT row_id, unnest(t) AS term FROM tok) GROUP BY ALL)"


def _weights(tokens: str, rows: str, key: str) -> str:
    return f"""WITH tok AS ({tokens}), cnt AS (SELECT {key}, term, count(*) AS cnt FROM (SELECT {key}, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM cnt GROUP BY term), n AS (SELECT count(*) AS n FROM {rows}),
w AS (SELECT {key}, term, cnt * (ln((1 + n) / (1 + df)) + 1) AS w FROM cnt JOIN df USING (term), n),
weight AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM w)"""


_GRAMS = " UNION ALL ".join(f"SELECT row_id, unnest(list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS term FROM tok WHERE len(t) >= {n}" for n in (1, 2, 3))
_DOC_TOKENS = f"SELECT doc_id, list_filter(regexp_extract_all({Sql.for_ngrams('text')}, '[a-zA-Z0-9_]+'), lambda w: len(w) >= 2) AS t FROM {DOCS} WHERE text IS NOT NULL AND lang IS NOT NULL"

ORACLES = {name: f"SELECT doc_id, {sql('text')} AS out FROM {DOCS}" for name, (_, sql) in _FUNCTIONS.items()} | {
    "tokenize": f"WITH t AS (SELECT doc_id, coalesce({_SPLIT(Sql.for_tokens('text'))}, []) AS t FROM {DOCS}) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM t",
    "stopword_antijoin": f"WITH t AS (SELECT row_id, list_filter({_SPLIT(Sql.for_tokens('headline'))}, lambda w: w NOT IN ({', '.join(map(_q, STOP_WORDS))})) AS t FROM {NEWS}) SELECT row_id, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM t",
    "regex_predicates": f"SELECT doc_id, regexp_matches(text, '[0-9]') AS has_digit, regexp_matches(text, '(?i)^the') AS starts_the, regexp_matches(text, '^[^0-9.]+$') AS plain FROM {DOCS}",
    "ngram_count_1": _COUNT + " SELECT row_id, term, cnt FROM cnt",
    "ngram_count_1_3": f"WITH tok AS ({_TOKENS}) SELECT row_id, term, count(*) AS cnt FROM ({_GRAMS}) GROUP BY ALL",
    "ngram_vocabulary": _COUNT + " SELECT term, row_number() OVER (ORDER BY term) - 1 AS dim FROM (SELECT DISTINCT term FROM cnt)",
    "tfidf_l2": _weights(_TOKENS, NEWS, "row_id") + " SELECT row_id, term, round(weight, 6) AS weight FROM weight",
    "bigram_collocations": f"""WITH t AS (SELECT {_SPLIT(Sql.for_tokens('text'))} AS t FROM {DOCS} WHERE text IS NOT NULL),
word AS (SELECT w, count(*) AS n FROM (SELECT unnest(t) AS w FROM t) GROUP BY w),
pair AS (SELECT p.a AS w1, p.b AS w2, count(*) AS n12 FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS p FROM t WHERE len(t) > 1) GROUP BY ALL HAVING count(*) >= 5)
SELECT w1, w2, round((n12 - 5) * (SELECT count(*) FROM word) / (a.n * b.n), 6) AS score FROM pair JOIN word a ON a.w = w1 JOIN word b ON b.w = w2 WHERE (n12 - 5) * (SELECT count(*) FROM word) / (a.n * b.n) > 10""",
    "char_ngram_buckets": f"""WITH tok AS ({_TOKENS}), w AS (SELECT DISTINCT unnest(t) AS token FROM tok),
g AS (SELECT DISTINCT token, substr('<' || token || '>', i, n) AS gram FROM w, range(3, 7) AS ns(n), range(1, 2000) AS pos(i) WHERE i + n - 1 <= len(token) + 2)
SELECT token, gram, ('0x' || substr(md5(gram), 1, 12))::BIGINT % 2000000 AS bucket FROM g""",
    "flagship_tfidf": _weights(_DOC_TOKENS, f"{DOCS} WHERE lang IS NOT NULL", "doc_id")
    + f""", mean AS (SELECT lang, term, round(avg(weight), 6) AS mean_weight, count(*) AS docs FROM weight JOIN {DOCS} USING (doc_id) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY mean_weight DESC, term) AS rk, term, mean_weight, docs FROM mean QUALIFY rk <= 3""",
}
