"""Every query of the library against its hand-written SQL in the oracle's engine."""

import os

import duckdb
import pytest

from ledgerline.plans import library

DIR = os.environ.get("LIBRARY_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    return con


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    df = library.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    if name not in library.ORACLES:
        assert got
        return
    found = oracle.execute(library.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got == want, (len(got), len(want), [x for x in zip(got, want) if x[0] != x[1]][:3])


def test_longest_narrow_run_without_such_days(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table orders as select k as o_orderkey, k as o_custkey, 'O' as o_orderstatus, 100.0::double as o_totalprice, timestamp '1995-01-01' + to_days(cast(k // 3 as int)) as o_orderdate, 'x' as o_orderpriority from range(120) t(k)")
    con.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    got = [tuple(r) for r in library.QUERIES["longest_narrow_run"](spark, str(tmp_path)).collect()]
    assert got == con.execute(library.ORACLES["longest_narrow_run"]).fetchall() == [("all", None)]
