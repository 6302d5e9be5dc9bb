"""Every registered query against its DuckDB text on the smallest given tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _text(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return None if v is None else str(v)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(_text(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLES[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(_text(r[i]) for i in at) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, key):
    rows = QUERIES[key](spark, SF).toPandas()
    assert len(rows) and not rows.isna().all().any(), "no rows, or a column without any value"


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
