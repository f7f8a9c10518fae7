import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from lymphspark.operators.packed_values import split_values
from lymphspark.operators.reject_rows import load_records

LAYOUT = [
    ("a.csv", 1, "title", ",", "text", "", False), ("a.csv", 2, "body", ",", "text", "", True), ("a.csv", 3, "kind", ",", "choice", "low|Mid|high", True),
    ("a.csv", 4, "day", ",", "date", "", False), ("b.tsv", 1, "n", "\t", "int", "1..10", True),
]
LAYOUT_SCHEMA = "file_name string, field_no int, field_name string, delimiter string, value_kind string, allowed_values string, is_required boolean"


def fields_of(line, d):
    """The fields under the stated quoting rules, or None; written out by hand, one character at a time."""
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i += 1
            value = ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    value += '"'
                    i += 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    value += line[i]
                    i += 1
            if i < len(line) and line[i] != d:
                return None
        else:
            j = line.find(d, i)
            value = line[i : j if j >= 0 else len(line)]
            if '"' in value or "\n" in value or "\r" in value:
                return None
            i += len(value)
        out.append(value)
        if i >= len(line):
            return out
        i += 1


def is_valid(file, line):
    layout = [r for r in LAYOUT if r[0] == file]
    if line is None or not layout:
        return False
    values = fields_of(line, layout[0][3])
    if values is None or len(values) != len(layout):
        return False
    for v, (_, _, _, _, kind, allowed, needed) in zip(values, layout):
        v = v.strip()
        if not v:
            if needed:
                return False
        elif kind == "choice" and v.lower() not in allowed.lower().split("|"):
            return False
        elif kind == "int" and not (re.fullmatch("[0-9]+", v) and 1 <= int(v) <= 10):
            return False
        elif kind == "date":
            try:
                assert re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", v)
                datetime.date.fromisoformat(v)
            except (ValueError, AssertionError):
                return False
    return True


def test_records_equal_brute_force(spark):
    rng = random.Random(1)
    pieces = ['"', '""', ",", "\t", "\n", "\r\n", " ", "low", "MID", "x", "2020-02-29", "2021-02-29", "2020-13-01", "0000-01-01", "7", "007", "10", "11", "-3", "+3", "7.5", "٣", "\\", "é", "9" * 30]
    rows = [(k, rng.choice(["a.csv", "b.tsv"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))) for k in range(3000)]
    rows += [(k + 5000, "a.csv", ",".join([rng.choice(["", "t", '"q ""r"" s"', '"a,b\nc"']), rng.choice(["body", " ", '"x"', '"x"y', 'x"y']), rng.choice(["low", " Mid ", '"HIGH"', "none", ""]), rng.choice(["", "2020-02-29", "2023-02-29", "2023-2-1", '" 2020-01-31"'])])) for k in range(1500)]
    rows += [(9001, None, "x"), (9002, "c.csv", "x"), (9003, "a.csv", None), (9004, "b.tsv", ""), (9005, "b.tsv", "5" + " " * 100000), (9006, "a.csv", '"' + 'long ""text"" ' * 50000 + '",b,low,'), (9007, "b.tsv", "7"), (9007, "b.tsv", "7")]
    df = spark.createDataFrame(rows, "raw_id long, file_name string, raw_line string").withColumn("reason", F.lit("?")).withColumn("fields", F.lit(1))
    got = load_records(df, spark.createDataFrame(LAYOUT, LAYOUT_SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.raw_id, r)
    assert len(got) == len(rows) and {k: r.is_valid for k, r in by.items()} == {k: is_valid(f, x) for k, f, x in rows}
    assert all((r.reason is None) == r.is_valid for r in got)
    assert by[9006].fields["title"].count('"') == 100000 and by[9007].fields == {"n": "7"} and by[9001].reason == "no file name" and by[9003].reason == "the record is null"


def test_records_report_cells_and_structure(spark):
    layouts = spark.createDataFrame(LAYOUT + LAYOUT[:1] + [("d.csv", 1, "x", "::", "text", "", False)], LAYOUT_SCHEMA)
    rows = [(1, "a.csv", "t,,nope,2021-02-30"), (2, "a.csv", "t,b,low"), (3, "a.csv", '"t,b,low,'), (4, "d.csv", "x")]
    got = {r.raw_id: r for r in load_records(spark.createDataFrame(rows, "raw_id long, file_name string, raw_line string"), layouts).collect()}
    assert got[1].bad_fields == ["body", "kind", "day"] and "not an existing date" in got[1].reason and got[1].fields["title"] == "t"
    assert got[2].reason == "3 fields instead of 4" and got[2].fields is None and got[3].reason == "unsound quoting" and "delimiter" in got[4].reason
    none = spark.createDataFrame([], "raw_id long, file_name string, raw_line string")
    assert load_records(none, layouts).collect() == [] and not load_records(spark.createDataFrame(rows, none.schema), layouts.limit(0)).filter("is_valid").collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("['cs.LG', 'stat.ML']", ["cs.LG", "stat.ML"]), ('[\\"cs.LG\\", \\"stat.ML\\"]', ["cs.LG", "stat.ML"]), ("a.B|c.D | e", ["a.B", "c.D", "e"]), ("|x||y|", ["x", "y"]),
        ("x;\ny ; z;", ["x", "y", "z"]), ("('x', 'y')", ["x", "y"]), ("x\ty", ["x", "y"]), ("x / y", ["x", "y"]), ("‘a b’; “c, d”", ["a b", "c, d"]), ("['a', '', ' ', 'a']", ["a", "a"]),
        ("[\"Fetorn's class 3\", 'b']", ["Fetorn's class 3", "b"]), ("['94B23, 60T43', 'x']", ["94B23, 60T43", "x"]), ("", []), (None, []), ("[]", []), ("[' x  ']", ["x"]), ("a-b.c,d; e|f", ["a-b.c", "d", "e", "f"]),
        ("x," * 5000, ["x"] * 5000),
    ],
)
def test_packed_values(spark, text, want):
    df = spark.createDataFrame([(1, text, "t"), (2, "cs.LG, cs.AI", "t"), (3, None, "t")], "row_id long, terms string, term string")
    got = split_values(df, "row_id", ["terms"]).filter("row_id = 1").orderBy("pos").collect()
    assert [r.term for r in got] == want and [r.pos for r in got] == list(range(1, len(want) + 1))


def test_packed_values_infer_delimiters(spark):
    df = spark.createDataFrame([(k, "a;b;c", "x|y") for k in range(50)] + [(99, "a;b, c", None)], "row_id long, terms string, other string").withColumn("field_name", F.lit(0))
    got = split_values(df, "row_id", ["terms", "other"], min_values=2)
    assert {(r.field_name, r.delimiter) for r in got.filter("row_id < 50").collect()} == {("terms", ";"), ("other", "|")}
    assert [r.term for r in got.filter("row_id = 99").orderBy("pos").collect()] == ["a", "b", "c"]
    assert split_values(df.limit(0), "row_id", ["terms"]).collect() == []


def test_delimiters_are_inferred_from_the_pieces(spark):
    """Phrases stay whole between the delimiter of their source, in sources apart by their notation; words stand apart on demand."""
    rows = [(k, t) for k in range(0, 90, 3) for k, t in ((k, "machine learning; computer vision; graph theory"), (k + 1, "cs.LG cs.CV stat.ML"), (k + 2, "'deep learning, deep', 'b'"))]
    rows += [(900, "graph theory; number theory, set theory; cs.LG"), (901, "machine learning"), (902, "graph theory | set theory")]
    df = spark.createDataFrame(rows, "row_id long, terms string")
    got = {}
    for r in split_values(df, "row_id", ["terms"]).orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, (r.delimiter, []))[1].append(r.term)
    assert got[0] == (";", ["machine learning", "computer vision", "graph theory"]) and got[1] == (" ", ["cs.LG", "cs.CV", "stat.ML"])
    assert got[2] == (",", ["deep learning, deep", "b"]) and got[900][1] == ["graph theory", "number theory", "set theory", "cs.LG"]
    assert got[901] == (None, ["machine learning"]) and got[902] == ("|", ["graph theory", "set theory"])
    apart = split_values(df, "row_id", ["terms"], words_apart=True).filter("row_id in (0, 2)").orderBy("row_id", "pos").collect()
    long = spark.createDataFrame([(1, "a" * 300000 + "; b"), (2, "a " * 100000 + ".; b")], "row_id long, terms string")
    assert split_values(long, "row_id", ["terms"]).filter("row_id = 1").count() == 2
    assert [r.term for r in apart] == ["machine", "learning", "computer", "vision", "graph", "theory", "deep learning, deep", "b"]
