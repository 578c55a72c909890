"""Every query with an oracle gives DuckDB's rows on the smallest tables; all others run."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
CORE = [k for k, f in QUERIES.items() if ".llm." not in f.__module__]


def _norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = df.collect()
    if name not in ORACLE:
        assert cols
        return
    r = duck.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    expected = Counter(tuple(_norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert Counter(tuple(_norm(x[c]) for c in cols) for x in rows) == expected


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
