"""Every query of the retrieval operators against its SQL."""

import glob
import math
import os

import duckdb
import pytest

from fernglas.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _key(row):
    return tuple(("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sql, name):
    out = queries.queries()[name](spark, SF)
    want = sql.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(out.columns) == sorted(names)
    got = sorted(_key(r[c] for c in names) for r in out.collect())
    want = sorted(_key(r) for r in want.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got or name in ("flt8_empty", "top1_none")
    assert not any(isinstance(v, float) and math.isnan(v) for r in out.limit(50).collect() for v in r)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
