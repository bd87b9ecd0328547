"""Every query with SQL gives that SQL's rows; all others give rows."""

import decimal

import duckdb
import pytest

from wingtally import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    assert not isinstance(v, decimal.Decimal)
    return f"{v + 0:.9g}" if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        return
    out = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(value(r[names.index(c)]) for c in columns) for r in out.fetchall())


def test_plans_hold_no_pairwise_join(spark):
    for name in ("overlap_pairs", "corrections_by_frame", "nearest_in_time", "best_partner"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
