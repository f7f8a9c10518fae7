import base64
import random

import pytest
from pyspark.sql import functions as F

from lymphspark.llm.tokenizer import LONG_WORD, Encoder, encode, load_vocabulary, token_counts, tokenizer_file
from lymphspark.llm.truncation import Truncation, goes_on

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    path = tokenizer_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    from lymphspark.llm.tokenizer import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_reference_encoder(reference):
    rng = random.Random(6)
    texts = ["", " ", "\n\n\t x", "it's we'll THEY'RE", "<|endoftext|> is text", "a" * 1000, "ab" * (LONG_WORD + 3), "ñ½²… 🤦🏽‍♀️ 日本語 ελληνικά", "\x00�"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 900), rng.randint(0x4E00, 0x4F00), 32])) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(LONG_WORD * 3)) for _ in range(5)]
    got = Encoder(load_vocabulary(tokenizer_file())).ids(texts)
    assert [g.tolist() for g in got] == [reference.encode_ordinary(t) for t in texts]


def test_encode_rows(spark, reference):
    rows = [(1, None, 5), (2, "", 5), (3, "two words", 5), (3, "two words", 5), (None, " \n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in encode(df).collect())
    assert got == sorted([(1, []), (2, []), (3, reference.encode_ordinary("two words")), (3, reference.encode_ordinary("two words")), (0, reference.encode_ordinary(" \n"))])
    n = token_counts(df.withColumn("n_tokens", F.lit(-1)), "text").collect()
    assert sorted(r.n_tokens for r in n) == sorted(len(x) for _, x in got) and set(n[0].asDict()) == {"doc_id", "ids", "n_tokens"}
    assert encode(df.limit(0)).collect() == []


NAMES = ["Lerno", "Kapil", "Tusab", "Marend", "Oskel", "Fenbo", "Jarit", "Pelum"]


def sentences(rng, n):
    verbs, nouns = ["opened", "closed", "praised", "counted", "moved"], ["harbour", "council", "garden", "bridge", "market", "library"]
    return [f"The {rng.choice(nouns)} of {rng.choice(NAMES)} {rng.choice(verbs)} the {rng.choice(nouns)} near {rng.choice(NAMES)}." for _ in range(n)]


def test_truncation(spark):
    rng = random.Random(8)
    rows, cut = [], set()
    add = lambda text, source, is_cut=False: (rows.append((len(rows), source, text)), is_cut and cut.add(len(rows) - 1))
    for k in range(120):
        whole = " ".join(sentences(rng, rng.randint(4, 9)))
        add(whole, "daily")
        add(whole + rng.choice(["", " #Lerno", " https://x.example/a1", " 🔥", "</p>", " :-)"]), "daily")
        if k % 4 == 0:
            add(whole[: rng.randint(60, 150)].rstrip(". ") + "x", "feed", True)
        if k % 5 == 0 and len(whole) > 180 and whole[179].isalpha() and whole[180].isalpha():
            add(whole[:180], "limited", True)
        if k % 6 == 0:
            add(whole[:140].rstrip() + "q... (more)", "wire", True)
        if k % 7 == 0:
            add(" ".join(sentences(rng, 4)) + " And yet…", "daily")
        if k % 8 == 0:
            add(" ".join(sentences(rng, 4)) + "\n\nContact: desk@paper.example", "daily")
        add(f"No {rng.choice(NAMES)} this year", "ticker")
    add(None, "daily"), add("", "daily"), add(" \n", None)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("remark", F.lit(1)).withColumn("last", F.lit("x"))
    t = Truncation(df)
    found = {r.doc_id for r in t.found().collect()}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.03 * len(found)
    by = {r.source: r for r in t.by_source().collect()}
    assert by["ticker"].cut == 0 and by["wire"].cut_share > 0.9
    empty = Truncation(df.limit(0))
    assert empty.found().collect() == [] and empty.by_source().collect() == []


def test_alignment():
    whole = "The council of Lerno opened a garden near the old bridge. Then everyone went home to sleep."
    assert goes_on("The council of Lerno opened a garden near the o", whole) == "inside"
    assert goes_on("The council of Lerno opened a garden near the", whole) == "inside"
    assert goes_on("The council of Lerno opened a garden near the old bridge", whole) == "ended"
    assert goes_on(whole, whole) is None
    assert goes_on("Nobody opened a garden near the river today", whole) is None


def test_every_copy_of_a_band_is_aligned(spark):
    """Longer retellings that part from the suspect at its end must not hide the one copy that goes on there."""
    words = [f"w{k}" for k in range(1000)]
    rows = [(1, "s", " ".join(words[:999])), (2, "s", " ".join(words) + " now.")]
    # What makes these longer are word runs that all have, so that they stand in the suspect's bands.
    rows += [(k, "s", " ".join([*words[:997], words[k], *words[:50]])) for k in range(10, 30)]
    got = {r.doc_id: r.inside for r in Truncation(spark.createDataFrame(rows, "doc_id long, source string, text string"))._copies().collect()}
    assert got.get(1) is True


def test_edge_cases_of_endings(spark):
    rows = [(1, None, None), (2, "s", ""), (3, "s", " \u00a0\n"), (4, "s", "..."), (5, None, "A text. And a second one that is"), (5, None, "A text. And a second one that is"), (6, "s", "word " * 60000 + "end."), (None, "s", "lost and"), (7, "s", "!" * 50000), (8, "s", "x" * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "text AS whole", "1 AS kind", "1 AS word")
    t = Truncation(df)
    got = t.judged().collect()
    assert [r.doc_id for r in got if r.is_cut] == [5, 5] and {r.doc_id for r in got} <= {4, 5, 8}
    assert {r.source: (r.docs, r.cut) for r in t.by_source().collect()} == {"s": (4, 0), None: (2, 2)}


def test_terminality_is_learned(spark):
    """Half words and words that no sentence ends with are told from those that texts end with, in a source of titles without stops
    as in one of sentences, where the same words stand inside too; at any size of the collection."""
    rng = random.Random(4)
    for copies in (1, 6):
        rows, cut = [], set()
        for _ in range(150 * copies):
            rows.append((len(rows), "daily", " ".join(sentences(rng, 6))))
            rows.append((len(rows), "titles", f"The {rng.choice(['harbour', 'garden', 'market'])} of {rng.choice(NAMES)}"))
            if len(rows) % 5 == 0:
                text = " ".join(sentences(rng, 3))
                at = next(k for k in range(rng.randint(40, len(text) - 12), 0, -1) if text[k - 1].isalpha() and text[k].isalpha())
                cut.add(len(rows))
                rows.append((len(rows), rng.choice(["daily", "titles"]), text[:at]))
        found = {r.doc_id for r in Truncation(spark.createDataFrame(rows, "doc_id long, source string, text string")).found().collect()}
        assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.02 * len(rows)


def test_share_of_cut_texts():
    import numpy as np

    from lymphspark.llm.truncation import share_of_cut

    likely = np.array([[0.1, 0.9], [0.8, 0.2]])
    for share in (0.02, 0.3, 0.9):
        counts = 10000 * (share * likely[1] + (1 - share) * likely[0])
        assert share_of_cut(counts, likely, 0.5, 1.0) == pytest.approx(share, abs=0.01)
    assert share_of_cut(np.zeros(2), likely, 0.9, 2.0) == pytest.approx(0.9)


def test_a_much_longer_copy_goes_on(spark):
    """A short cut text and the long one that it was cut from have hardly a band in common: the words before the cut find it."""
    rng = random.Random(12)
    letters = "abcdefghijklmnop"
    words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(4000)]
    rows = [(1, "s", " ".join(words[2000:2014]) + " " + words[2014][:3]), (2, "s", " ".join(words) + "."), (3, "s", "Other words end here. And so does this."), (4, "s", " ".join(words[2000:2014]) + " " + words[2014] + ".")]
    rows += [(k, "s", " ".join(rng.sample(words, 30)) + ".") for k in range(10, 40)]
    got = {r.doc_id: (r.inside, r.at_end) for r in Truncation(spark.createDataFrame(rows, "doc_id long, source string, text string"))._copies().collect()}
    assert got == {1: (True, False)}


def test_hot_keys_are_salted(spark, monkeypatch):
    """Keys that all texts have give the same alignments cut into salts, broadcast or joined."""
    import lymphspark.llm.truncation as truncation

    words = [f"w{k}" for k in range(300)]
    rows = [(k, "s", " ".join(words[: 200 + k])) for k in range(12)] + [(50, "s", " ".join(words) + ".")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = lambda: sorted(map(tuple, Truncation(df)._copies().collect()))
    plain = found()
    assert {r[0] for r in plain} == set(range(12))
    monkeypatch.setattr(truncation, "HOT", 3)
    assert found() == plain
    monkeypatch.setattr(truncation, "MANY", 0)
    assert found() == plain
