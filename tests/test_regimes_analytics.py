import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import Regimes
from barloom.operators import analytics, binning, charts, exports, features, normalise, regimes, trajectories

STATE = "microstructure_state"


def test_frozen(bars, column):
    v = [100, 0, 100, 100]
    assert column(regimes.states(bars(pct_return=[0.02] * 4, volume=v)), STATE)[1] == 1
    assert set(column(regimes.states(bars(pct_return=[0.0] * 4, volume=[100] * 4, spread_pct=[0.2] * 4)), STATE)) == {1}
    low = regimes.states(bars(pct_return=[0.02] * 10, volume=[1000] * 9 + [5]), Regimes(window=5))
    assert column(low, STATE)[-1] == 1
    got = column(regimes.states(bars(pct_return=[0.01, 0.0, None, 0.0, 0.01, None], volume=[100] * 6)), STATE)
    assert got[1] == got[3] == 1 and got[0] != 1 and got[4] != 1


def test_other_states(bars, column):
    thin = regimes.states(bars(pct_return=[0.01, 0.012, 0.011], volume=[100] * 3, spread_pct=[0.2, 0.2, 0.05]))
    assert column(thin, STATE) == [2, 2, 3]
    burst = regimes.states(bars(pct_return=[0.01] * 20 + [0.5], volume=[100] * 20 + [400]))
    assert column(burst, STATE)[-1] == 5 and column(burst, "microstructure_state_name")[-1] == "volatility_burst"
    active = regimes.states(bars(pct_return=[0.01] * 21, volume=[100, 101] * 10 + [400]))
    assert column(active, STATE)[-1] == 4


def test_drift_with_dense_volume(bars, column):
    n = 200
    r = np.random.default_rng(0)
    vol = [int(v) for v in r.integers(900, 1100, n)]
    ret = (r.choice([-1, 1], n) * 0.02).tolist()
    ret[-25:] = [0.001 * float(s) for s in r.choice([-1, 1], 25)]
    vol[-6:] = [600, 590, 600, 590, 600, 590]
    df = bars(pct_return=ret, volume=vol, spread_pct=[0.04] * n).transform(binning.lifecycle)
    assert 6 in column(regimes.states(df), STATE)[-6:]


def test_transitions(bars):
    df = bars(microstructure_state=[1, 1, 3, 1, 2], types={"microstructure_state": "int"})
    m = {r.from_state: r for r in regimes.transition_matrix(df).collect()}
    assert (m[1].to_1, m[1].to_3, m[1].to_2) == pytest.approx((1 / 3, 1 / 3, 1 / 3)) and m[3].to_1 == 1.0
    assert all(m[2][f"to_{c}"] == 0 for c in range(1, 7))
    assert [r.regime_transition for r in regimes.states(bars(pct_return=[0.1, 0.1], volume=[5, 5])).orderBy("ts").collect()][0] == 1


def test_entropy(bars):
    df = bars(microstructure_state=[1, 1, 3, 3], types={"microstructure_state": "int"})
    r = regimes.entropy(df).first()
    assert (r.regime_entropy, r.n_states, r.dominant_regime) == (1.0, 2, 1)
    one = regimes.entropy(bars(microstructure_state=[3, 3], types={"microstructure_state": "int"})).first()
    assert one.regime_entropy == 0.0


def test_robustness_and_bootstrap(bars):
    raw = bars(price_c=[50.0, 51.0, None, 52.0] * 10, yes_bid_c=[49.0] * 40, yes_ask_c=[52.0] * 40, volume=[100, 0, None, 50] * 10)
    out = regimes.robustness(regimes.robustness_features(raw)).collect()
    assert len(out) == 11 and all(abs(sum(r[f"pct_{c}"] for c in range(1, 7)) - 100) < 1e-9 for r in out)
    df = bars(microstructure_state=[1, 3], types={"microstructure_state": "int"}).unionByName(bars(contract="B", microstructure_state=[1, 1], types={"microstructure_state": "int"}))
    a, b = (sorted(regimes.bootstrap(df, 50).collect()) for _ in range(2))
    assert a == b and abs(sum(r["mean"] for r in a) - 100) < 1e-9
    assert regimes.bootstrap(df.limit(0)).count() == 0


def test_robustness_of_rows_of_one_time(bars):
    """Four rows for each time: they go by event id, in whatever order they come."""
    n = 160
    r = np.random.default_rng(3)
    raw = bars(event_id=list(range(n)), price_c=r.integers(20, 80, n).astype(float).tolist(), yes_bid_c=r.integers(10, 40, n).astype(float).tolist(), yes_ask_c=r.integers(41, 60, n).astype(float).tolist(), volume=r.integers(0, 90, n).tolist(), types={"event_id": "long"})
    raw = raw.withColumn("ts", F.date_trunc("hour", "ts") + F.make_interval(mins=(F.col("event_id") / 4).cast("int"))).coalesce(1)
    a, b = (sorted(regimes.robustness(regimes.robustness_features(raw.sortWithinPartitions(o))).collect()) for o in (F.asc("event_id"), F.desc("event_id")))
    assert len(a) == 11 and a == b


def test_shock_resilience(bars):
    s = [2.0] * 100
    for k in (10, 40, 70):
        s[k] = 30.0
        s[k + 1] = 20.0
    s[71:] = [25.0] * 29
    s[10], s[11] = 40.0, 2.0
    df = bars(spread=[*s])
    r = analytics.shock_resilience(df, q=0.9).first()
    w = pd.Series(s)
    hi, med = w.quantile(0.9), w.median()
    starts = [i for i in range(100) if s[i] > hi and not (i and s[i - 1] > hi)]
    back = [next((j - i for j in range(i, min(100, i + 31)) if s[j] <= med), None) for i in starts]
    ok = [b for b in back if b is not None]
    assert (r.shocks, r.recovery_rate) == (len(starts), len(ok) / len(starts)) and r.mean_recovery == pytest.approx(np.mean(ok))
    small = analytics.shock_resilience(bars(spread=[1.0] * 19)).first()
    assert (small.shocks, small.recovery_rate) == (0, None)
    assert analytics.shock_resilience(bars(spread=[1.0] * 20)).first().recovery_rate == 1.0


@pytest.mark.parametrize("n", [9, 10, 200, 350])
def test_collapse_slopes(bars, n):
    r = np.random.default_rng(n)
    x = np.linspace(0, 1, n)
    y = np.exp(1 - x) + r.random(n)
    df = bars(spread=y.tolist(), lifecycle_ratio=x.tolist())
    log_, raw = analytics.collapse_slope_log(df).first()[1], analytics.collapse_slope_raw(df).first()[1]
    if n < 10:
        assert log_ is None and raw is None
        return
    at = np.linspace(0, n - 1, 200).astype(int) if n > 200 else np.arange(n)
    assert log_ == pytest.approx(np.polyfit(x[at], np.log(y[at]), 1)[0]) and raw == pytest.approx(np.polyfit(x, y, 1)[0])


def test_contract_analysis_takes_every_row(bars):
    """The slope of ln(spread) in the wide row is that of all 350 rows; 200 evenly placed ones give another."""
    n = 350
    r = np.random.default_rng(11)
    x, y = np.linspace(0, 1, n), np.exp(r.normal(0, 1, n))
    df = bars(spread=y.tolist(), lifecycle_ratio=x.tolist(), spread_pct=[0.1] * n, volume=[1] * n, volatility_short=[0.1] * n, depth_balance=[0.5] * n, abs_return=[0.0] * n)
    got, some = analytics.contract_analysis(df).first().spread_collapse_log, analytics.collapse_slope_log(df).first()[1]
    assert got == pytest.approx(np.polyfit(x, np.log(y), 1)[0]) and got != pytest.approx(some, rel=0.01)
    few = analytics.contract_analysis(df.limit(9)).first()
    assert few.spread_collapse_log is None


def test_surges(bars):
    v = [10, 12, 11, 10, 12, 11, 500]
    r = analytics.volume_surges(bars(volume=v)).collect()
    w = pd.Series(v, dtype=float)
    assert len(r) == 1 and r[0].magnitude == pytest.approx((500 - w.mean()) / w.std()) and r[0].baseline == pytest.approx(w.mean())
    assert analytics.volatility_surges(bars(pct_return=[0.01] * 8)).count() == 0


def test_burst_intensity(bars):
    v = [1.0] * 20 + [9.0]
    s = pd.Series(v)
    want = ((9 - s.mean()) / s.std())
    assert analytics.burst_intensity(bars(volatility_short=v)).first()[1] == pytest.approx(want)
    assert analytics.burst_intensity(bars(volatility_short=[1.0] * 9)).first()[1] is None
    assert analytics.burst_intensity(bars(volatility_short=[1.0] * 12)).first()[1] == 0.0


def test_volume_resilience_and_score(bars):
    assert analytics.volume_resilience(bars(volume=[5] * 8)).first()[1] == 1.0
    assert analytics.liquidity_score(bars(volume=[5, 7, 9], spread=[1.0, 2.0, 4.0])).first()[1] == 0.0


def test_normalise(bars, column):
    x = [3.0, 1.0, 3.0, None, 2.0]
    s = pd.Series(x)

    def same(c, want):
        got = column(bars(v=x).withColumn("o", c), "o")
        assert [None if g is None else round(g, 9) for g in got] == [None if w != w else round(w, 9) for w in want]

    same(normalise.zscore("v"), (s - s.mean()) / s.std())
    same(normalise.percentile_rank("v"), s.rank(pct=True))
    same(normalise.minmax("v"), (s - 1) / 2)
    same(normalise.robust("v"), (s - s.median()) / (s.quantile(0.75) - s.quantile(0.25)))
    assert column(bars(v=[2.0, 2.0]).withColumn("o", normalise.minmax("v")), "o") == [0.5, 0.5]
    got = normalise.across_contracts(bars(v=x), "v", "percentile").orderBy("ts").collect()
    assert [r.v_norm for r in got] == [2 / 5, 0.0, 2 / 5, None, 1 / 5]
    with pytest.raises(ValueError):
        normalise.Normalizer().transform(bars(v=x))
    assert normalise.configured_method("volume_x") == "percentile" and normalise.configured_method("other") == "zscore"


def test_align_interpolates_and_masks(bars):
    from datetime import datetime

    from barloom.config import Alignment

    spark = bars(v=[1.0]).sparkSession
    event = datetime(2024, 1, 1, 2)
    rows = [("A", "S", datetime(2024, 1, 1, 1, m), float(v), event) for m, v in ((0, 0), (10, 10), (21, 32), (23, 36))]
    df = spark.createDataFrame(rows, "contract_id string, category string, ts timestamp, v double, event_time timestamp")
    out = {r.grid_min: r.value for r in trajectories.align(df, ["v"], Alignment(grid_hours_pre=1, grid_hours_post=1)).collect()}
    assert out[60] == 0 and out[55] == 5 and out[50] == 10 and out[39] == 32 and out[38] == 34 and 45 not in out and 36 not in out
    near = {r.grid_min: r.value for r in trajectories.align(df, ["v"], Alignment(grid_hours_pre=1, grid_hours_post=1), method="nearest").collect()}
    assert near[56] == 0 and near[54] == 10
    cubic = {r.grid_min: r.value for r in trajectories.align(df, ["v"], Alignment(grid_hours_pre=1, grid_hours_post=1), method="cubic").collect()}
    assert cubic[60] == pytest.approx(0) and cubic[50] == pytest.approx(10) and 45 not in cubic
    assert trajectories.align(df.limit(2), ["v"]).count() == 0


@pytest.mark.parametrize("n", [4, 5, 6, 40])
def test_spline_solves_the_dense_system(n):
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.5, 3, n)), rng.normal(size=n)
    h = np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3], a[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
    m = np.linalg.solve(a, b)
    g = np.linspace(x[0], x[-1], 101)
    k = np.clip(np.searchsorted(x, g, side="right") - 1, 0, n - 2)
    t, s = g - x[k], x[k + 1] - g
    want = (m[k] * s**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * s + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t
    assert trajectories.spline_function()(x, y, g) == pytest.approx(want)


def test_spline_of_a_cubic_is_the_cubic():
    x = np.array([0.0, 1, 2.5, 4, 7, 8, 11])
    g = np.linspace(0, 11, 45)
    assert trajectories.spline_function()(x, x**3 - 4 * x**2 + 1, g) == pytest.approx(g**3 - 4 * g**2 + 1)


def test_long_contract_takes_time_in_proportion(spark):
    """A contract of 200,000 rows: fills and alignment by every method, each within seconds."""
    import time

    from barloom.config import Alignment
    from barloom.operators import cleaning

    n = 200_000
    long = spark.range(n).select(F.lit("A").alias("contract_id"), F.lit("S").alias("category"), F.timestamp_seconds(F.col("id") * 90).alias("ts"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("price_c"))
    half = long.withColumn("event_time", F.timestamp_seconds(F.lit(n * 90 // 2)))
    long.count()
    for make in (
        lambda: cleaning.impute(long, ["price_c"], "backward_fill"), lambda: cleaning.impute(long, ["price_c"], "linear"),
        *[lambda m=m: trajectories.align(half, ["price_c"], Alignment(grid_hours_pre=2000, grid_hours_post=2000), m, 20) for m in ("linear", "nearest", "cubic")],
    ):
        began = time.time()
        assert make().agg(F.count("*")).first()[0] > 190_000
        assert time.time() - began < 10


def test_anchor_is_the_middle_of_the_grid(spark):
    from barloom.config import Alignment

    grid = Alignment(grid_hours_pre=1, grid_hours_post=1, interpolation_grid_minutes=30)
    rows = spark.createDataFrame([("A", "S", "m", g, float(v), 3) for g, v in ((-60, 2), (0, 4), (60, 6))], "contract_id string, category string, metric string, grid_min long, value double, n long")
    assert trajectories.middle_minute() == -600 and trajectories.middle_minute(grid) == 0
    assert sorted(r.value for r in trajectories.normalise_trajectories(rows, "anchor", grid).collect()) == [0.5, 1.0, 1.5]


def test_weighted_percentiles(spark):
    rows = [(c, "S", "m", 0, v, n) for c, v, n in (("a", 1.0, 1), ("b", 2.0, 1), ("c", 2.0, 3), ("d", 9.0, 5))]
    r = trajectories.aggregate(spark.createDataFrame(rows, "contract_id string, category string, metric string, grid_min long, value double, n long"), normalize=False).first()
    assert (r.p10, r.p25, r["median"], r.p75, r.p90, r["count"]) == (1.0, 2.0, 2.0, 9.0, 9.0, 4)
    assert r["mean"] == pytest.approx((1 + 2 + 6 + 45) / 10) and r["std"] == pytest.approx(np.std([1, 2, 2, 9]))


@pytest.mark.parametrize("n", [3, 4, 9, 30])
def test_student_p(spark, n):
    # against a numerical integral of the density
    from math import gamma, pi, sqrt

    x = np.linspace(0, 1.7, 20001)
    d = gamma((n + 1) / 2) / (sqrt(n * pi) * gamma(n / 2)) * (1 + x**2 / n) ** (-(n + 1) / 2)
    want = 1 - 2 * np.trapezoid(d, x)
    got = spark.range(1).select(trajectories.student_p(F.lit(1.7), F.lit(n))).first()[0]
    assert got == pytest.approx(want, abs=1e-7)


def test_compare_sides(bars):
    y = [1.0, 2.0, 3.0, 4.0, 10.0, 11.0, 12.0]
    df = bars(spread=y).withColumn("event_time", F.to_timestamp(F.lit("2024-01-01 00:04:00")))
    r = trajectories.compare_sides(trajectories.event_window(df), ("spread",)).first()
    assert (r.n_pre, r.n_post, r.ks_stat) == (4, 3, 1.0) and r.change_pct == pytest.approx((11 - 2.5) / 2.5 * 100)
    p = ((4 - 1) * np.var(y[:4], ddof=1) + 2 * np.var(y[4:], ddof=1)) / 5
    assert r.t_stat == pytest.approx((2.5 - 11) / np.sqrt(p * (1 / 4 + 1 / 3))) and 0 < r.t_pvalue < 0.01


def test_exports(spark, bars):
    rng = np.random.default_rng(1)
    parts = None
    for k in range(4):
        n = 60
        p = np.clip(50 + np.cumsum(rng.normal(0, 1, n)), 5, 95)
        b = bars(contract=f"C{k}", category=("Sports", "Politics")[k % 2], price_c=p.tolist(), volume=[int(v) for v in rng.integers(0, 50, n)], yes_bid_c=(p - 1).tolist(), yes_ask_c=(p + 2).tolist(), yes_bid_h=p.tolist(), yes_bid_l=(p - 3).tolist(), yes_ask_h=(p + 4).tolist(), yes_ask_l=p.tolist())
        parts = b if parts is None else parts.unionByName(b)
    df = features.engineer(parts)
    m = exports.contract_metrics(df)
    assert m.count() == 4 and all(abs(sum(r[f"regime_pct_{c}"] for c in range(1, 7)) - 100) < 1e-9 for r in m.collect())
    c = {r.category: r for r in exports.category_summary(m).collect()}
    want = m.groupBy("category").agg(F.avg("mean_spread").alias("x")).collect()
    assert all(c[r.category].avg_spread == pytest.approx(r.x) for r in want)
    b = exports.lifecycle_binned(df, 10)
    assert b.count() == 20
    assert exports.dataset_summary(parts).count() == 4
    assert exports.upsert(parts, parts.filter("contract_id = 'C0'").limit(3)).count() == 183
    assert exports.remove(parts, ["C1"]).count() == 180
    y = charts.states_over_lifecycle(df, 10).groupBy("lifecycle_bin").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in y)
    f = charts.category_fingerprint(df)
    assert f.count() == 10 and f.filter("value < 0 or value > 1").count() == 0
    for name, d in charts.chart_data(df).items():
        assert d.count() > 0, name


def test_empty_table(bars):
    df = features.engineer(bars(price_c=[50.0], volume=[1], yes_bid_c=[49.0], yes_ask_c=[51.0]).limit(0))
    assert exports.contract_metrics(features.depth_resilience_balance(df)).count() == 0
    assert regimes.transition_matrix(df).count() == 0
