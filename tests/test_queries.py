"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test data is not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = sorted(([str(plain(r[c])) for c in sorted(df.columns)] for r in df.collect()))
    if name not in entry.oracle_sql():
        assert rows is not None
        return
    got = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert rows == sorted([str(plain(r[i])) for i in order] for r in got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "position", "semantic_score", "rationale"]
