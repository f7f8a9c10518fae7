import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lymphspark.functions.words import letter_words
from lymphspark.llm.distinctive import outstanding, score_terms
from lymphspark.llm.mixing import Mixture, fit_lengths
from lymphspark.llm.sampling import TargetSample, allocate, round_table
from lymphspark.llm.term_counts import count_terms, mark_terms, term_pairs


def test_counts_marks_and_scores(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "a", "river", "port", "łódź", f"rare{chr(97 + k % 26)}"]) for _ in range(rng.randint(0, 30))) for k in range(200)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, "THE the 12 ... the", "x"), (None, "lost", "x")]
    df = spark.createDataFrame(rows, "row_id long, text string, term string").withColumn("record", F.lit(1))
    pairs = term_pairs(df, "row_id", letter_words(F.col("text")), "text")
    tf = {k: Counter(w for w in (t or "").lower().split() if w.isalpha()) for k, t, _ in rows if k is not None}
    cf, dfs = Counter(), Counter()
    for c in tf.values():
        cf.update(c)
        dfs.update(c.keys())
    got = count_terms(pairs.repartition(5))
    assert {r.term: (r.occurrences, r.n_rows) for r in got.collect()} == {w: (cf[w], dfs[w]) for w in cf}
    totals = spark.createDataFrame([("text", len(rows))], "field_name string, all_rows long")
    marks = {r.term: r.mark for r in mark_terms(got, totals).collect()}
    assert all(marks[w] == ("rare" if n < 3 else "common" if n > 0.3 * len(rows) else None) for w, n in dfs.items())
    scores = {(r.record, r.term): r.score for r in score_terms(pairs, totals).collect()}
    assert len(scores) == sum(map(len, tf.values()))
    for (k, w), s in scores.items():
        n = len(rows)
        assert s == pytest.approx(tf[k][w] * (-math.log2(dfs[w] / n) + math.log2(-math.expm1(-cf[w] / n))))
    few = outstanding(score_terms(pairs, totals), {"text": 2}).select("record", "term").collect()
    assert {tuple(r) for r in few} == {(k, w) for k, c in tf.items() for w, n in c.items() if n >= 2 and 2 <= dfs[w] <= 10}


def test_repeated_pairs_and_empty_tables(spark):
    schema = "field_name string, term string, record long, n long"
    got = count_terms(spark.createDataFrame([("f", "a", 1, 2), ("f", "a", 1, 3), ("f", "a", 2, 1), ("g", "a", 1, 1)], schema)).collect()
    assert {(r.field_name, r.occurrences, r.n_rows) for r in got} == {("f", 6, 2), ("g", 1, 1)}
    empty = spark.createDataFrame([], schema)
    totals = spark.createDataFrame([], "field_name string, all_rows long")
    assert count_terms(empty).collect() == [] and score_terms(empty, totals).collect() == []


def test_a_term_that_fills_the_table(spark):
    pairs = spark.range(20000).selectExpr("'f' AS field_name", "'the' AS term", "id AS record", "2L AS n")
    assert [tuple(r) for r in count_terms(pairs).collect()] == [("f", "the", 40000, 20000)]
    totals = spark.createDataFrame([("f", 20000)], "field_name string, all_rows long")
    assert score_terms(pairs, totals).count() == 20000


def test_controlled_rounding():
    from fractions import Fraction

    rng = random.Random(4)
    for _ in range(30):
        table = {(r, c): Fraction(rng.randint(0, 60), rng.choice([3, 7, 10])) for r in range(6) for c in range(5)}
        got = round_table(table)
        near = lambda x, n: math.floor(x) <= n <= math.ceil(x)
        assert all(near(table[k], got[k]) for k in table)
        for axis in (0, 1):
            for k in {x[axis] for x in table}:
                assert near(sum(v for x, v in table.items() if x[axis] == k), sum(v for x, v in got.items() if x[axis] == k))
        assert near(sum(table.values()), sum(got.values()))
    assert round_table({}) == {}


def test_allocation_keeps_minima_and_adds_up():
    got = allocate([("a", 0.7, 1), ("b", 0.2, 30), ("c", 0.1, 1), ("d", 0.0, 0)], {"a": 500, "b": 40, "c": 4}, 100)
    assert sum(got.values()) == 100 and got["b"] >= 30 and got["c"] == 4 and got["d"] == 0
    assert sum(allocate([("a", 0.5, 1), ("b", 0.5, 1)], {"a": 3, "b": 4}, 100).values()) == 7
    assert allocate([("a", 1.0, 5)], {}, 10) == {"a": 0}


def test_sample(spark):
    rows = [(f"k{k // 2}", ["Red ", "red", "BLUE", "\tgreen\n", None, " "][k % 6], 2000 + k % 5) for k in range(1200)] + [(None, "green", None)] * 3
    df = spark.createDataFrame(rows, "key_id string, label string, year int").withColumn("category_value", F.lit("red")).withColumn("stratum", F.lit(1))
    targets = [("s", "t", "label", "red", 0.5, 1, 100), ("s", "t", "label", "blue", 0.4, 1, 100), ("s", "t", "label", "green", 0.1, 900, 100), ("s", "t", "label", "teal", 0.0, 1, 100), ("n", "none", "label", "x", 1.0, 1, 5), ("n", "t", "nofield", "x", 1.0, 1, 5)]
    t = spark.createDataFrame(targets, "target_set string, table_name string, field_name string, category_value string, target_share double, min_rows long, sample_size long")
    s = TargetSample({"t": (df, "key_id", F.col("year"))}, t)
    report = {(r.target_set, r.category_value): r for r in s.report().collect()}
    assert {k for k, r in report.items() if not r.is_met} == {("s", "green"), ("s", "teal"), ("n", "x")}
    drawn = s.sample().collect()
    assert len(drawn) == len({(r.target_set, r.category_value, r.key) for r in drawn}) == sum(r.drawn for r in report.values())
    assert all(r.drawn == r.quota for r in report.values()) and sum(r.drawn for k, r in report.items() if k[0] == "s") == 100
    # A third of green's rows have no key: each is a record of its own.
    keys = {r[0] for r in rows if r[1] and r[1].strip().lower() == "green" and r[0]}
    assert report["s", "green"].available == len(keys) + 3
    again = TargetSample({"t": (df.repartition(5), "key_id", F.col("year"))}, t).sample().filter("key not like '\x00%'").collect()
    assert {tuple(r) for r in again} >= {tuple(r) for r in drawn if not r.key.startswith("\x00")} - {tuple(r) for r in drawn if r.category_value == "green"}
    empty = TargetSample({"t": (df.limit(0), "key_id", F.col("year"))}, t)
    assert empty.sample().collect() == [] and all(r.quota == 0 for r in empty.report().collect())


def test_fit_lengths_reaches_the_budget():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.choice(np.arange(1, 300), rng.integers(1, 40), replace=False)
        counts = rng.integers(1, 50, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 10))
        take = fit_lengths(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all() and (lengths * take).sum() <= budget
    assert fit_lengths(np.array([7, 11]), np.array([5, 5]), 29).tolist() == [1, 2]
    # Brute force over small cases: nothing comes nearer.
    for budget in range(0, 60):
        best = max(4 * a + 9 * b for a in range(5) for b in range(4) if 4 * a + 9 * b <= budget)
        assert int((fit_lengths(np.array([4, 9]), np.array([4, 3]), budget) * [4, 9]).sum()) >= best - 9


def test_fit_lengths_is_never_short_of_the_best():
    """A thousand random cases against all reachable sums, without tolerance; small rooms force more documents to be given back."""
    import numpy as np

    from lymphspark.llm import mixing

    rng, known = random.Random(3), mixing.ROOM
    try:
        for _ in range(1000):
            lengths = rng.sample(range(1, rng.choice([10, 40, 400, 3000]) + 15), rng.randint(1, 12))
            counts = [rng.randint(1, rng.choice([2, 9, 60])) for _ in lengths]
            budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
            reach = 1
            for n, c in zip(lengths, counts):
                for _ in range(c):
                    reach |= reach << n
            mixing.ROOM = rng.choice([1, 64, known])
            take = fit_lengths(np.array(lengths), np.array(counts), budget)
            assert ((take >= 0) & (take <= counts)).all()
            assert int((take * lengths).sum()) == (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    finally:
        mixing.ROOM = known


def test_mixture(spark):
    docs = [(k, ["big", "small", "tiny"][min(k // 400, 2)], 10 + k % 23) for k in range(820)] + [(900, None, 50), (901, "big", 0), (902, "other", 9)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("quota", F.lit(1))
    targets = [("m", "big", 0.6, 1, 10000), ("m", "small", 0.35, 3, 10000), ("m", "tiny", 0.05, 2, 10000), ("w", "small", 0.9, 4, 30000), ("w", "absent", 0.1, 2, 30000), ("z", "big", None, None, None)]
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int, budget_tokens long")
    mix = Mixture(sizes, t)
    report = {(r.mix_name, r.source): r for r in mix.report().collect()}
    tokens = {s: sum(n for _, x, n in docs if x == s) for s in ("big", "small", "tiny")}
    assert report["m", "big"].is_met and report["m", "big"].given_tokens == pytest.approx(6000, abs=1)
    assert report["m", "big"].missing_tokens == 6000 - report["m", "big"].given_tokens
    assert report["w", "small"].is_met == (tokens["small"] * 4 >= 27000) and not report["w", "absent"].is_met and report["w", "absent"].given_tokens == 0
    used = mix.documents().collect()
    given = Counter()
    for r in used:
        given[r.mix_name, r.source] += r.n_tokens * r.repeats
    assert all(given[k] == r.given_tokens for k, r in report.items())
    most = {(m, s): r for m, s, _, r, _ in targets}
    assert all(1 <= r.repeats <= most[r.mix_name, r.source] for r in used)
    assert len(used) == len({(r.mix_name, r.doc_id) for r in used})
    assert [tuple(r) for r in Mixture(sizes.limit(0), t).documents().collect()] == [] and Mixture(sizes, t.limit(0)).report().collect() == []
