import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import Cleaning
from barloom.operators import binning, cleaning, features
from barloom.operators.resample import resample


def near(a, b, tol=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        y = None if y is None or (isinstance(y, float) and math.isnan(y)) else y
        assert (x is None) == (y is None) and (x is None or abs(x - y) < tol), (x, y)


def test_fills(bars, column):
    x = [None, 50.0, None, None, 56.0, None]
    assert column(cleaning.impute(bars(price_c=x), ["price_c"]), "price_c") == [None, 50, 50, 50, 56, 56]
    assert column(cleaning.impute(bars(price_c=x), ["price_c"], "midpoint"), "price_c") == [None, 50, 50, 50, 56, 56]
    assert column(cleaning.impute(bars(price_c=x), ["price_c"], "backward_fill"), "price_c") == [50, 50, 56, 56, 56, None]
    near(column(cleaning.impute(bars(price_c=x), ["price_c"], "linear"), "price_c"), [None, 50, 52, 54, 56, 56])
    assert column(cleaning.impute(bars(price_c=x), ["price_c"], "drop"), "price_c") == x
    q = cleaning.impute_quotes(bars(yes_bid_c=[49.0, None, 51.0], yes_ask_c=[51.0, None, 53.0]))
    assert column(q, "yes_bid_c")[1] == 49 and column(q, "yes_ask_c")[1] == 51


def test_fills_and_bins_of_rows_of_one_time(bars):
    """Four rows for each time: fills and bins take them by event id, in whatever order they come."""
    n = 120
    r = np.random.default_rng(7)
    price = [None if k % 3 else float(v) for k, v in enumerate(r.integers(20, 80, n))]
    raw = bars(event_id=list(range(n)), price_c=price, yes_bid_c=r.integers(10, 40, n).astype(float).tolist(), yes_ask_c=r.integers(41, 60, n).astype(float).tolist(), volume=r.integers(0, 90, n).tolist(), types={"event_id": "long"})
    raw = raw.withColumn("ts", F.date_trunc("day", "ts") + F.make_interval(mins=(F.col("event_id") / 4).cast("int") * 20)).coalesce(1)
    a, b = (sorted(resample(cleaning.clean(raw.sortWithinPartitions(o)), 3600).collect()) for o in (F.asc("event_id"), F.desc("event_id")))
    want = pd.Series(price).ffill()[11::12].tolist()  # three times of four rows make a bin
    assert a == b and [x.price_c for x in a] == want
    for method in ("backward_fill", "linear"):
        a, b = (sorted(cleaning.impute(raw.sortWithinPartitions(o), ["price_c"], method).select("event_id", F.coalesce("price_c", F.lit(-1.0))).collect()) for o in (F.asc("event_id"), F.desc("event_id")))
        assert a == b
    plan = resample(cleaning.clean(raw), 3600)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and plan.count("Sort [") <= 2  # none for the numbers


def test_winsorize_and_clamp(bars, column):
    x = [0.01, 0.02, -0.5, 0.03, 0.5, 0.02, None]
    got = column(cleaning.winsorize(bars(pct_return=x), ["pct_return"], 0.1, 0.1), "pct_return")
    s = pd.Series(x[:-1])
    near(got, [*s.clip(s.quantile(0.1), s.quantile(0.9)), None])
    assert cleaning.count_clipped(bars(pct_return=x), "pct_return", 0.1, 0.1).first().clipped == 2
    assert column(cleaning.clamp_prices(bars(price_c=[0.0, 100.0, 50.0, None])), "price_c") == [1, 99, 50, None]


def test_validators(bars):
    r = cleaning.validate_prices(bars(price_c=[-5.0, 50.0, 150.0])).first()
    assert (r.below, r.above) == (1, 1)
    assert cleaning.validate_spreads(bars(yes_bid_c=[20.0, 0.0, 50.0], yes_ask_c=[80.0, 5.0, 51.0]), 0.1).first().wide_spreads == 2
    bad = cleaning.validate(bars(price_c=[-5.0, 150.0], yes_bid_c=[20.0, 49.0], yes_ask_c=[80.0, 50.0])).first()
    assert not bad.is_valid and len(bad.errors) == 3
    assert cleaning.validate(bars(price_c=[50.0], yes_bid_c=[49.0], yes_ask_c=[51.0])).first().is_valid


def test_clean_and_stats(bars):
    df = bars(price_c=[50.0, None, 120.0], yes_bid_c=[49.0, None, 50.0], yes_ask_c=[51.0, 52.0, None], volume=[1, 0, 2])
    assert cleaning.clean(df).count() == 0
    assert cleaning.clean(df, Cleaning(min_observations=3)).count() == 3
    assert cleaning.clean(df, Cleaning(min_observations=1, drop_zero_volume_only=True)).count() == 2
    r = cleaning.cleaning_stats(df).first()
    assert (r.original_rows, r.final_rows, r.nulls_imputed, r.invalid_prices_fixed, r.removal_pct) == (3, 3, 3, 1, 0.0)


def test_gaps(bars, column):
    assert column(cleaning.detect_gaps(bars(step=660, price_c=[1.0, 2.0])), "gap") == [False, True]
    assert column(cleaning.detect_gaps(bars(step=600, price_c=[1.0, 2.0])), "gap") == [False, False]


def test_resample(spark):
    rows = [("A", "Sports", "2024-01-01 00:00:10", 50.0, 3), ("A", "Sports", "2024-01-01 00:00:50", None, 4), ("A", "Sports", "2024-01-01 00:03:05", 60.0, None)]
    df = spark.createDataFrame(rows, "contract_id string, category string, ts string, price_c double, volume long").withColumn("ts", F.col("ts").cast("timestamp"))
    out = resample(df).orderBy("ts").collect()
    assert [(r.ts.minute, r.price_c, r.volume, r.category) for r in out] == [(0, 50, 7, "Sports"), (1, 50, 0, "Sports"), (2, 50, 0, "Sports"), (3, 60, 0, "Sports")]
    assert resample(df.limit(0)).count() == 0


@pytest.fixture
def walk():
    r = np.random.default_rng(42)
    n = 120
    p = np.clip(50 + np.cumsum(r.normal(0, 1, n)), 2, 98).round(1)
    bid, ask = p - r.integers(1, 4, n), p + r.integers(1, 4, n)
    return {"price_c": p.tolist(), "volume": [int(v) for v in r.integers(0, 900, n)], "trade_count": [int(v) for v in r.integers(0, 5, n)], "yes_bid_c": bid.tolist(), "yes_ask_c": ask.tolist(), "price_h": (p + 1).tolist(), "price_l": (p - 1).tolist()}


def test_features_against_pandas(bars, column, walk):
    df = features.spreads(features.liquidity(features.volatility(features.returns(bars(**walk)))))
    w = pd.DataFrame(walk)
    ret = w.price_c.pct_change()
    near(column(df, "pct_return"), ret.tolist())
    near(column(df, "log_return"), np.log(w.price_c / w.price_c.shift()).tolist())
    for name, k in (("short", 5), ("medium", 15), ("long", 60)):
        near(column(df, f"volatility_{name}"), ret.rolling(k, min_periods=3).std().tolist())
    ma, sd = w.volume.rolling(20, min_periods=1).mean(), w.volume.rolling(20, min_periods=1).std()
    near(column(df, "volume_ma"), ma.tolist())
    z = ((w.volume - ma) / sd.replace(0, np.nan)).fillna(0)
    near(column(df, "volume_zscore"), z.tolist(), 1e-8)
    spread = w.yes_ask_c - w.yes_bid_c
    near(column(df, "spread_ma"), spread.rolling(20, min_periods=1).mean().tolist())
    near(column(df, "spread_tightening"), spread.diff().tolist())
    d = spread.diff()
    near(column(features.depth_resilience_share(df), "depth_resilience"), d.rolling(10).apply(lambda x: (x < 0).sum() / 10).tolist())

    def balance(x):
        n, p = (x < 0).sum(), (x > 0).sum()
        return n / (n + p) if n + p else np.nan

    near(column(features.depth_resilience_balance(df), "depth_balance"), d.rolling(10).apply(balance).tolist())
    near(column(features.depth_impact(df), "volume_spread_corr"), w.volume.rolling(60).corr(spread).tolist(), 1e-8)
    park = np.sqrt((np.log(w.price_h / w.price_l) ** 2).rolling(20).mean() / (4 * np.log(2)))
    near(column(features.parkinson(df), "parkinson_volatility"), park.tolist())


def test_zero_variance_and_missing_columns(bars, column):
    df = features.depth_impact(features.spreads(bars(yes_bid_c=[49.0] * 70, yes_ask_c=[51.0] * 70, volume=[5] * 70)))
    assert set(column(df, "volume_spread_corr")) == {None}
    plain = bars(other=[1.0, 2.0])
    assert features.returns(plain).columns == plain.columns and features.spreads(plain).columns == plain.columns and features.depth(plain).columns == plain.columns
    zero = features.spreads(bars(yes_bid_c=[-1.0, 1.0], yes_ask_c=[1.0, 0.5]))
    assert column(zero, "spread_pct")[0] is None and column(zero, "spread")[1] == -0.5


def test_calendar(spark, bars):
    df = bars(step=3600, price_c=[1.0] * 24).withColumn("event_time", F.to_timestamp(F.lit("2024-01-01 12:00:00")))
    rows = features.calendar(df, with_event=True).orderBy("ts").collect()
    assert [r.is_market_hours for r in rows].count(1) == 7 and rows[0].day_of_week == 0 and rows[9].session_start
    assert [rows[h].regime for h in (11, 12, 14, 15, 20)] == [2, 3, 3, 5, 5]


@pytest.mark.parametrize("n", [20, 50, 100])
def test_bin_edges(spark, n):
    r = [k / n for k in range(n + 1)] + [k / n + 1e-12 for k in range(n)] + [0.123, 0.999]
    df = spark.createDataFrame([(x,) for x in r], "lifecycle_ratio double")
    got = {row.lifecycle_ratio: row.lifecycle_bin for row in binning.lifecycle_bins(df, n).collect()}
    want = pd.cut(pd.Series(r), np.array([k / n for k in range(n + 1)]), labels=False, include_lowest=True)
    assert [got[x] for x in r] == [min(int(v), n - 1) if v == v else n - 1 for v in want]


def test_lifecycle(bars):
    df = bars(step=3600, price_c=[1.0] * 10)
    end = F.to_timestamp(F.lit("2024-01-01 05:00:00"))
    assert binning.lifecycle(df, settlement=end).count() == 6
    assert binning.lifecycle(df, settlement=end, exclude_post_resolution=False).count() == 10
    assert binning.lifecycle(df, settlement=F.to_timestamp(F.lit("2023-12-31"))).count() == 0
    one = binning.lifecycle(bars(price_c=[1.0])).first()
    assert (one.lifecycle_ratio, one.lifecycle_phase) == (0.0, "early")
    phases = [r.lifecycle_phase for r in binning.lifecycle(bars(price_c=[1.0] * 101)).orderBy("ts").collect()]
    assert [phases[k] for k in (0, 5, 6, 20, 21, 80, 81, 95, 96, 100)] == ["early", "early", "ramp_up", "ramp_up", "middle", "middle", "late", "late", "resolution", "resolution"]


def test_other_bins(bars):
    df = binning.lifecycle(bars(step=1800, price_c=[1.0] * 10))
    assert [r.tts_bin for r in binning.settlement_bins(df, 1, 3).orderBy("ts").collect()] == [2, 2, 2, 2, 2, 1, 1, 0, 0, 0]
    with pytest.raises(ValueError):
        binning.time_bins(df, "calendar")
    b, name = binning.time_bins(df, "lifecycle", 5)
    t = binning.aggregate_by_bins(b.withColumn("v", F.lit(2.0)), ["contract_id", name], {"v": ["mean", "std"], "absent": ["sum"]})
    assert set(t.columns) == {"contract_id", "lifecycle_bin", "v_mean", "v_std"} and t.count() == 5
    tr = binning.binned_trajectory(b.withColumn("v", F.col("lifecycle_bin").cast("double")), "v", "lifecycle_bin", "lifecycle_bin_center").orderBy("lifecycle_bin").collect()
    assert [r.p50 for r in tr] == [0.5, 1, 2, 3, 3.5]
