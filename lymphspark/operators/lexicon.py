"""Lexica: category patterns with wildcards, fixed-width word norms, tag distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphspark.functions.numbers import round_half_even
from lymphspark.functions.words import unnest

# The fields of a fixed-width norm line (name, start from 0, end), then the flag, the type and five codes.
FIELDS = (
    ("NLET", 0, 2), ("NPHON", 2, 4), ("NSYL", 4, 5), ("K-F-FREQ", 5, 10), ("K-F-NCATS", 10, 12), ("K-F-NSAMP", 12, 15), ("T-L-FREQ", 15, 21),
    ("BROWN-FREQ", 21, 25), ("FAM", 25, 28), ("CONC", 28, 31), ("IMAG", 31, 34), ("MEANC", 34, 37), ("MEANP", 37, 40), ("AOA", 40, 43),
)
FLAG_AT, TYPE_AT, WORD_AT = 43, 44, 51
# The codes of each categorical column with their output columns, in order.
CODES = (
    (46, (("A", "ABBREVIATION"), ("S", "SUFFIX"), ("P", "PREFIX"), ("H", "HYPHENATED"), ("M", "MULTI-WORD"))),
    (47, (
        ("D", "DIALECT"), ("F", "ALIEN"), ("A", "ARCHAIC"), ("Q", "COLLOQUIAL"), ("C", "CAPITAL"), ("N", "ERRONEOUS"), ("E", "NONSENSE"), ("W", "NONCE WORD"),
        ("O", "OBSOLETE"), ("P", "POETICAL"), ("R", "RARE"), ("H", "RHETORICAL"), ("$", "SPECIALISED"), ("S", "STANDARD"), ("Z", "SUBSTANDARD"),
    )),
    (48, (("O", "PRONUNCIATION_DIFFER_STRESS"), ("B", "PRONUNCIATION_DIFFER"))),
    (49, (("C", "CAPITALIZATION"),)),
    (50, (("Z", "PLURAL"), ("Y", "SINGULAR"), ("B", "BOTH_SINGULAR_PLURAL"), ("N", "NO_PLURAL"), ("P", "PLURAL_ACT_SINGULAR"))),
)
# Word types by universal part-of-speech tag.
WORD_TYPES = (
    ("PRON", "U"), ("VERB", "V"), ("VERB", "P"), ("DET", "J"), ("NOUN", "N"), ("ADP", "R"), ("ADJ", "J"), ("CCONJ", "C"), ("AUX", "V"),
    ("ADV", "A"), ("PART", "O"), ("NUM", "J"), ("CONJ", "C"), ("INTJ", "I"), ("PROPN", "N"), ("SCONJ", "C"), ("X", "O"),
)
DIMENSIONS = [name for name, _, _ in FIELDS] + ["DERIVATIONAL"] + [name for _, codes in CODES for _, name in codes]


def parse_dictionary(text: str) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Categories by id and patterns with their category names, from a dictionary file's text.

    The part between the first two ``%`` lines has id and name, what follows pattern and ids, separated by tabs. Of a
    repeated pattern the last holds; an unknown id is an error. Text after a ``*`` is ignored.
    """
    lines = [line.rstrip("\r\n") for line in text.splitlines()]
    marks = [k for k, line in enumerate(lines) if line.strip() == "%"]
    if len(marks) < 2:
        raise ValueError("a dictionary needs two lines with %")
    names = dict(line.split("\t")[:2] for line in lines[marks[0] + 1 : marks[1]] if line.strip())
    patterns: dict[str, list[str]] = {}
    for line in lines[marks[1] + 1 :]:
        if line.strip():
            pattern, *ids = [x for x in line.split("\t") if x]
            patterns[pattern] = [names[i.strip()] for i in ids]
    return names, patterns


def lexicon_frame(spark: SparkSession, patterns: dict[str, list[str]]) -> DataFrame:
    """``pattern``, ``is_prefix``, ``categories``."""
    rows = [(p.split("*")[0], "*" in p, c) for p, c in patterns.items()]
    return spark.createDataFrame(rows, "pattern string, is_prefix boolean, categories array<string>")


def match_lexicon(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``token`` and ``categories`` of the distinct tokens that match. ``tokens`` has ``token``.

    The shortest wildcard that is a prefix of the token wins over anything longer, an exact entry included; otherwise the
    exact entry counts. All joins are equi-joins, on the token's prefixes of lengths that wildcards have.
    """
    words = tokens.select("token").filter("token is not null").distinct()
    wild = lexicon.filter("is_prefix").select(F.col("pattern").alias("prefix"), F.col("categories").alias("wild"))
    longest = F.broadcast(wild.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0)).alias("longest")))
    cut = words.crossJoin(longest).select("token", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("token"), "longest")), lambda n: F.substring("token", F.lit(1), n))).alias("prefix"))
    first = cut.join(wild, "prefix").groupBy("token").agg(F.min_by("wild", F.length("prefix")).alias("wild"))
    exact = lexicon.filter("not is_prefix").select(F.col("pattern").alias("token"), F.col("categories").alias("exact"))
    both = words.join(first, "token", "left").join(exact, "token", "left")
    return both.select("token", F.coalesce("wild", "exact").alias("categories")).filter("categories is not null")


def category_profile(df: DataFrame, id_col: str, lexicon: DataFrame) -> DataFrame:
    """``id``, ``category``, ``share``: tokens of a category over all tokens, to 8 places. ``df`` has the id and ``tokens``."""
    per = unnest(df.select(id_col, F.size("tokens").alias("n"), F.col("tokens").alias("token")), "token").groupBy(id_col, "n", "token").agg(F.count("*").alias("times"))
    matched = per.join(match_lexicon(per, lexicon), "token")
    counts = matched.select(id_col, "n", "times", F.explode("categories").alias("category")).groupBy(id_col, "n", "category").agg(F.sum("times").alias("c"))
    return counts.select(id_col, "category", round_half_even(F.col("c") / F.col("n"), 8).alias("share"))


def parse_norms(lines: DataFrame) -> DataFrame:
    """``word``, ``wtype``, ``vals`` (43 whole numbers) from ``line_no`` and ``line``; of a repeated word and type the last line."""
    part = lambda a, b: F.substring("line", a + 1, b - a)
    number = lambda a, b: F.coalesce(F.expr(f"try_cast(trim(substring(line, {a + 1}, {b - a})) as int)"), F.lit(0))
    flags = [F.when(part(FLAG_AT, FLAG_AT + 1) == "Q", 1).otherwise(0)]
    flags += [F.when(F.upper(part(at, at + 1)) == c, 1).otherwise(0) for at, codes in CODES for c, _ in codes]
    word = F.lower(F.trim(F.element_at(F.split(F.substring("line", WORD_AT + 1, 1 << 20), r"\|"), 1)))
    parsed = lines.select("line_no", word.alias("word"), part(TYPE_AT, TYPE_AT + 1).alias("wtype"), F.array(*[number(a, b) for _, a, b in FIELDS], *flags).alias("vals"))
    return parsed.groupBy("word", "wtype").agg(F.max_by("vals", "line_no").alias("vals"))


def norm_profile(df: DataFrame, id_col: str, norms: DataFrame) -> DataFrame:
    """``id``, ``dim`` (name), ``value``: sums of the norms of every token and word type over the number of tokens (1 at least).

    ``df`` has the id, ``tokens`` and ``tags``, read side by side as far as both go. Values of 0 have no row.
    """
    types = df.sparkSession.createDataFrame(WORD_TYPES, "tag string, wtype string")
    both = F.least(F.size("tokens"), F.size("tags"))
    zipped = df.select(id_col, F.greatest(F.size("tokens"), F.lit(1)).alias("n"), F.explode(F.arrays_zip(F.slice("tokens", 1, both).alias("word"), F.slice("tags", 1, both).alias("tag"))).alias("z"))
    counted = zipped.groupBy(id_col, "n", "z.word", "z.tag").agg(F.count("*").alias("times"))
    hits = counted.join(F.broadcast(types), "tag").join(norms, ["word", "wtype"])
    names = F.array(*[F.lit(d) for d in DIMENSIONS])
    long = hits.select(id_col, "n", "times", F.posexplode("vals").alias("at", "v")).filter("v <> 0")
    return long.groupBy(id_col, "n", "at").agg(F.sum(F.col("times") * F.col("v")).alias("s")).select(id_col, F.get(names, F.col("at")).alias("dim"), (F.col("s") / F.col("n")).alias("value"))


def suffix_tags(tokens: Column) -> Column:
    """A stand-in tagger for where no model is at hand: tags by function word, digits and suffix."""
    def tag(w: Column) -> Column:
        return (
            F.when(w.rlike(r"^[0-9]+$"), "NUM")
            .when(w.isin("the", "a", "an", "this", "that", "every", "no"), "DET")
            .when(w.isin("i", "you", "he", "she", "it", "we", "they"), "PRON")
            .when(w.isin("and", "or", "but"), "CCONJ")
            .when(w.isin("in", "on", "at", "of", "for", "to", "with", "by", "from"), "ADP")
            .when(w.isin("is", "are", "was", "were", "be", "has", "have"), "AUX")
            .when(w.rlike("ly$"), "ADV")
            .when(w.rlike("(ed|ing|ise|ize)$"), "VERB")
            .when(w.rlike("(ful|ous|ive|al|ic|less)$"), "ADJ")
            .otherwise("NOUN")
        )

    return F.transform(tokens, tag)


def tag_distribution(df: DataFrame, id_col: str) -> DataFrame:
    """``id``, ``tag``, ``share``: how often each tag occurs among the row's tags. ``df`` has the id and ``tags``."""
    return unnest(df.select(id_col, F.size("tags").alias("n"), F.col("tags").alias("tag")), "tag").groupBy(id_col, "n", "tag").agg(F.count("*").alias("c")).select(id_col, "tag", (F.col("c") / F.col("n")).alias("share"))
