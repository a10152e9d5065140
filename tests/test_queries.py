"""Every query runs on the smallest tables; those with SQL agree with DuckDB."""

import collections
import glob
import os

import duckdb
import pytest

import __spark_entry__ as E

DIR = os.environ.get("FACTLAKE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
QUERIES, SQL = E.queries(), E.oracle_sql()
LLM = {f"p{n}_" for n in (4, 5, 8, 9, 10)}
CORE = [q for q in QUERIES if q.split("_")[0] + "_" not in LLM]


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) if not isinstance(r[c], list) else tuple(r[c]) for c in names) for r in df.collect())
    if name in SQL:
        r = con.execute(SQL[name])
        cols = [x[0] for x in r.description]
        assert sorted(cols) == names
        assert got == collections.Counter(tuple(plain(x[cols.index(c)]) for c in names) for x in r.fetchall())


def test_entry(spark):
    if DIR == "/root/testdata/sf0.001":
        assert E.entry(spark).count() > 0


def test_nothing_else_imports_the_text_operators():
    root = os.path.dirname(os.path.abspath(E.__file__))
    for p in glob.glob(f"{root}/factlake/**/*.py", recursive=True):
        if "/llm/" not in p:
            assert "factlake.llm" not in open(p).read(), p
