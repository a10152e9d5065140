import collections
import glob
import os

import duckdb
import pytest

import __spark_entry__ as E

DIR = os.environ.get("FACTLAKE_TESTDATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p4_found": [("term_id_a", "bigint"), ("term_id_b", "bigint")], "p5_found": [("page_id", "bigint"), ("kind", "string"), ("seq", "int")], "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", [q for q in E.queries() if q.split("_")[0] in ("p4", "p5", "p8", "p9", "p10")])
def test_query(spark, name):
    df = E.queries()[name](spark, DIR)
    r = df.collect()
    if name in E.oracle_sql():
        c = duckdb.connect()
        for p in glob.glob(f"{DIR}/*.parquet"):
            c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
        want = c.execute(E.oracle_sql()[name])
        at = [[x[0] for x in want.description].index(n) for n in df.columns]
        assert collections.Counter(map(tuple, r)) == collections.Counter(tuple(x[i] for i in at) for x in want.fetchall())
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
        assert len(r) == len({str(x) for x in r})
