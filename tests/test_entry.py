import importlib.util
import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "term" in df.columns


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert importlib.util.find_spec("lymphspark.queries") is not None


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, str(DATA))
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(plain(row[names.index(c)]) for c in got.columns) for row in cur.fetchall())
    assert Counter(tuple(plain(x) for x in row) for row in got.collect()) == want
