"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _key(rows):
    f = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(str(f(v)) for v in r) for r in rows))


def _names():
    from barloom.plans.queries import Q

    return sorted(k for k, q in Q.items() if q.sql)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    from barloom.plans.queries import Q

    df = Q[name].run(spark, SF)
    rel = con.execute(Q[name].oracle())
    cols = [c[0] for c in rel.description]
    assert cols == df.columns
    assert _key(df.collect()) == _key(rel.fetchall())


def test_rounding_is_that_of_the_sql(spark, con):
    """Halves of the sixth decimal that no double holds: the text of 0.0640625 ends in 5, the double times a million is below the half."""
    import numpy as np

    from barloom.plans.queries import Query

    x = [0.0640625, 1.0328125, -0.0640625, 0.0078125, -0.0078125, 0.4734375, 0.4734374999999999, 2.5e-6, -1e-9, 0.0, 123456789.1234565, 1e15]
    x += [s * k / d for d in (640, 1280, 3200) for k in range(1, 3000, 7) for s in (1, -1)] + np.random.default_rng(5).normal(0, 1e3, 500).tolist()
    q = Query(lambda s, d: s.createDataFrame(list(enumerate(x)), "n long, x double"), "n", "x")
    got = [r.x for r in q.run(spark, SF).orderBy("n").collect()]
    want = [r[0] for r in con.execute("SELECT round(x, 6) + 0.0 FROM (SELECT unnest(range(len($x))) AS n, unnest($x::DOUBLE[]) AS x) ORDER BY n", {"x": x}).fetchall()]
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(abs(sum(r[f"to_{c}"] for c in range(1, 7)) - 1) < 1e-9 or sum(r[f"to_{c}"] for c in range(1, 7)) == 0 for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_one_shuffle(spark):
    """All windows of a contract share one exchange."""
    from barloom.operators import features
    from barloom.sources.bars import bars_from_events

    df = features.depth_impact(features.spreads(features.liquidity(features.volatility(features.returns(bars_from_events(spark, SF))))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_run(spark, tmp_path):
    from barloom.config import Settings
    from barloom.plans.run import Run
    from barloom.sources.bars import bars_from_events

    r = Run(bars_from_events(spark, SF), Settings(), 3600)
    assert r.tables()["contract_summary"].count() > 0
    with pytest.raises(ValueError):
        Run(bars_from_events(spark, SF), names=["nothing"])
