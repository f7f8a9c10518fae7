import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lymphspark.functions import text as T
from lymphspark.operators import terms

SAMPLES = ["", "  two  spaces\t\ttabs ", 'say "hello" now', "don't we’ll it´s", "the 21st of 3 and 42ND", "a<br/>b</p> <hr />x", "back\\nslash \\s \\\\", "Éclair naïve ﬁne ½ ² … ＡＢ", "Straße ÄÖÜ", "x = (a+b)*[c]; d!", "“curly” ‘quotes’", "tab\tone\nline", "\xa0nbsp　wide", "日本 ελλ", "'' '", 'a" b" "c']


def py_accents(s):
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


PY = {
    T.remove_accents: py_accents,
    T.collapse_spaces: lambda s: re.sub(r"\s{2,}", " ", s),
    T.trim_ws: lambda s: re.sub(r"^\s+|\s+$", "", s),
    T.remove_all_spaces: lambda s: re.sub(r"\s", "", s),
    T.remove_numbers: lambda s: re.sub(r"\s{2,}", " ", re.sub(r"(?i)\d+(st|nd|rd|th)?", "", s)),
    T.split_contractions: lambda s: re.sub(r"""(\w+)([‘’'´`"”“]+)(\w{1,3})""", r"\1 '\3", s),
    T.single_quotes: lambda s: re.sub(r'["”“]', "'", s),
}


@pytest.mark.parametrize("f", list(PY), ids=lambda f: f.__name__)
def test_function(spark, f):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "id int, text string")
    got = {r.id: r.out for r in df.select("id", f(F.col("text")).alias("out")).collect()}
    assert got == {k: PY[f](s) for k, s in enumerate(SAMPLES)}


def test_micro_fixtures(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "t string").select(f(F.col("t"))).head()[0]
    assert one(T.strip_quotations, 'say "hello" now') == "say hello now"
    assert one(T.remove_special_chars, "a<br/>b</p>") == "a b</p>"
    assert one(T.remove_numbers, "the 21st of 3") == "the of "
    assert one(T.normalize_text, "  Straße “Ärger” ﬁne…  ") == "strasse arger fine..."
    assert one(T.normalize_text, None) is None and one(T.casefold, "ΣΑΣ ẞ") == "σασ ss"
    assert one(T.normalize_for_ngrams, "It's the 21st, isn't \"it\"?") == "it 's the isn 't it "


def test_tfidf_and_vocabulary(spark):
    import math

    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "id long, t array<string>")
    counts = terms.ngram_counts(docs, "id", F.col("t"))
    w = {(r.id, r.term): r.weight for r in terms.tfidf(counts, "id", docs.agg(F.count("*").alias("n"))).collect()}
    ia, ib = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    length = math.hypot(2 * ia, ib)
    assert w == pytest.approx({(1, "a"): 2 * ia / length, (1, "b"): ib / length, (2, "b"): 1.0})
    assert {r.term: r.dim for r in terms.vocabulary(counts).collect()} == {"a": 0, "b": 1}
    grams = {r.term for r in terms.ngram_counts(docs, "id", F.col("t"), 1, 3).filter("id = 1").collect()}
    assert grams == {"a", "b", "a b", "b a", "a b a"}


def test_collocations_and_char_ngrams(spark):
    docs = spark.createDataFrame([(["new", "york", f"w{k}"],) for k in range(30)] + [(["the", "new", "thing"],)] * 2, "t array<string>")
    got = {(r.w1, r.w2): r.score for r in terms.collocations(docs, F.col("t"), 5, 0.0).collect()}
    assert got == pytest.approx({("new", "york"): 25 * 34 / (32 * 30)})
    assert spark.range(1).select(terms.char_ngrams(F.lit("ab"))).head()[0] == ["<ab", "ab>", "<ab>"]


def test_average_vectors_count_unknown_words(spark):
    tokens = spark.createDataFrame([(1, ["a", "a", "zz"]), (2, [])], "id long, tokens array<string>")
    vectors = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 6.0)], "word string, dim int, x double")
    assert {(r.id, r.dim): r.value for r in terms.average_vectors(tokens, vectors, "id").collect()} == {(1, 0): 2.0, (1, 1): 4.0}


def test_compatibility_forms_of_all_planes(spark):
    """Whatever has an ASCII part in its compatibility decomposition keeps it: styled letters, squared units, enclosed letters."""
    import unicodedata

    texts = ["𝐀𝖇𝒸 𝟘𝟡 ＡＢ", "㎏ ㏂ ㎡ ㍿", "🄰🄑 ⑽ Ⅻ ﬁ", "x²₃ ½ ™ …", "é ß ı Ł", "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.decomposition(c))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.remove_accents(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
