import subprocess
import sys

import pytest

import __spark_entry__
from tests.conftest import ROOT

OWN = sorted(__spark_entry__.OWN)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_and_own_queries_need_no_session_to_import():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("name", OWN)
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    got = __spark_entry__.OWN[name](spark, d).toPandas()
    if name not in __spark_entry__.OWN_SQL:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in ("region", "supplier", "customer", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = con.execute(__spark_entry__.OWN_SQL[name]).df()
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = lambda x: sorted(map(repr, x[order].astype(object).where(x[order].notna(), None).itertuples(index=False, name=None)))
    assert [r.replace("np.int64", "").replace("np.int32", "") for r in rows(got)] == [r.replace("np.int64", "").replace("np.int32", "") for r in rows(want)]
