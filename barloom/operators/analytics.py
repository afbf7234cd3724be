"""Surges, bursts, spread and liquidity measures: one row or few rows for each contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Surges
from barloom.functions.common import by_time, first_present, flag, quantile, rows, safe_div, so_far, whole

ABS_NAMES = ("abs_return", "pct_return", "log_return")


def _surge_columns(df: DataFrame, value: Column, lookback: int, to: str) -> DataFrame:
    """``to`` + _z and ``to`` + _m: the z-score and rolling mean over ``lookback`` rows, with five values at least."""
    x = value.cast("double")
    w = rows(lookback)
    enough = F.count(x).over(w) >= 5
    mean, sd = F.when(enough, F.avg(x).over(w)), F.when(enough, F.stddev_samp(x).over(w))
    return df.withColumns({f"{to}_m": mean, f"{to}_z": safe_div(x - mean, F.nullif(sd, F.lit(0.0)))})


def _surges(df: DataFrame, value: Column, kind: str, threshold: float, lookback: int) -> DataFrame:
    df = _surge_columns(df, value, lookback, "__s")
    return df.filter(flag(F.col("__s_z") > threshold)).select("contract_id", "ts", F.lit(kind).alias("type"), F.col("__s_z").alias("magnitude"), F.col("__s_m").alias("baseline"))


def volume_surges(df: DataFrame, threshold: float = 2.0, lookback: int = 30) -> DataFrame:
    """contract_id, ts, type, magnitude (z-score), baseline (rolling mean) of large volumes."""
    return _surges(df, F.col("volume"), "volume", threshold, lookback)


def volatility_surges(df: DataFrame, threshold: float = 2.0, lookback: int = 30) -> DataFrame:
    """The same for absolute returns."""
    return _surges(df, F.abs(F.col(first_present(df, ABS_NAMES))), "volatility", threshold, lookback)


def surges(df: DataFrame, settings: Surges | None = None) -> DataFrame:
    s = settings or Surges()
    return volume_surges(df, s.volume_threshold, s.lookback_window).unionByName(volatility_surges(df, s.volatility_threshold, s.lookback_window))


def surge_ratio(df: DataFrame, metric: str = "volume", lookback: int = 30) -> DataFrame:
    """surge_ratio: the value over its rolling mean."""
    w, x = rows(lookback), F.col(metric).cast("double")
    return df.withColumn("surge_ratio", F.when(F.count(x).over(w) >= 5, F.try_divide(x, F.nullif(F.avg(x).over(w), F.lit(0.0)))))


def _bursts(df: DataFrame, mult: float, least: int) -> tuple[DataFrame, Column]:
    v = F.col("volatility_short")
    df = df.withColumns({"__bm": F.avg(v).over(whole()), "__bs": F.stddev_samp(v).over(whole()), "__bn": F.count(v).over(whole())})
    high = F.avg(F.when(v > F.col("__bm") + mult * F.col("__bs"), safe_div(v - F.col("__bm"), F.nullif(F.col("__bs"), F.lit(0.0)))))
    return df, F.when(F.max("__bn") >= least, F.coalesce(high, F.lit(0.0)))


def burst_intensity(df: DataFrame, mult: float = 2.0, least: int = 10) -> DataFrame:
    """burst_intensity: mean z-score of volatilities above mean + mult deviations; 0 without any, NULL below ``least`` values."""
    df, value = _bursts(df.select("contract_id", "volatility_short"), mult, least)
    return df.groupBy("contract_id").agg(value.alias("burst_intensity"))


def _log_usable() -> Column:
    return flag((F.col("spread") > 0) & F.col("lifecycle_ratio").isNotNull())


def _log_slope(taken: Column, n: Column, least: int) -> Column:
    """Slope of ln(spread) on the lifecycle ratio over the rows ``taken``; NULL with ``n`` usable rows below ``least``."""
    x, y = F.when(taken, F.col("lifecycle_ratio")), F.when(taken, F.ln("spread"))
    return F.when((n >= least) & (F.var_pop(x) > 0), F.regr_slope(y, x))


def _thinned(df: DataFrame, points: int) -> DataFrame:
    """``__taken``: at most ``points`` evenly placed ones of the ``__k`` usable rows."""
    ok = _log_usable()
    one = F.when(ok, 1).otherwise(0)
    df = df.withColumns({"__i": F.sum(one).over(so_far()) - 1, "__k": F.sum(one).over(whole())})
    i, n = F.col("__i"), F.col("__k")
    k = F.ceil(i * (points - 1) / F.nullif(n - 1, F.lit(0)))
    return df.withColumn("__taken", ok & ((n <= points) | (F.floor(k * (n - 1) / (points - 1)) == i)))


def collapse_slope_log(df: DataFrame, points: int = 200, least: int = 10) -> DataFrame:
    """spread_collapse_log: slope of ln(spread) on the lifecycle ratio, over at most ``points`` evenly placed rows."""
    df = _thinned(df.select("contract_id", "ts", "spread", "lifecycle_ratio"), points)
    return df.groupBy("contract_id").agg(_log_slope(F.col("__taken"), F.max("__k"), least).alias("spread_collapse_log"))


def _raw_slope(least: int) -> Column:
    both = F.col("spread").isNotNull() & F.col("lifecycle_ratio").isNotNull()
    return F.when(F.count_if(both) >= least, F.regr_slope("spread", "lifecycle_ratio"))


def collapse_slope_raw(df: DataFrame, least: int = 10) -> DataFrame:
    """spread_collapse_slope: slope of the spread itself over all rows."""
    return df.groupBy("contract_id").agg(_raw_slope(least).alias("spread_collapse_slope"))


def spread_curve(df: DataFrame, step: int = 300) -> DataFrame:
    """Spreads by bins of ``step`` seconds, empty bins too: mean, std, min, max, first, last, tightening and its share."""
    at = F.timestamp_seconds(F.floor(F.unix_micros("ts") / (1_000_000 * step)) * step)
    s, order = F.col("spread"), F.when(F.col("spread").isNotNull(), F.col("ts"))
    by = df.withColumn("bin", at).groupBy("contract_id", "bin").agg(
        F.avg(s).alias("spread_mean"), F.stddev_samp(s).alias("spread_std"), F.min(s).alias("spread_min"), F.max(s).alias("spread_max"), F.min_by(s, order).alias("spread_first"), F.max_by(s, order).alias("spread_last")
    )
    ends = by.groupBy("contract_id").agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    grid = ends.select("contract_id", F.explode(F.sequence("a", "b", F.make_interval(secs=F.lit(step)))).alias("bin"))
    out = grid.join(by, ["contract_id", "bin"], "left")
    fall = F.col("spread_first") - F.col("spread_last")
    return out.withColumn("tightening", fall).withColumn("tightening_pct", F.when(F.col("spread_first") > 0, F.try_divide(fall, F.col("spread_first"))))


def spread_percentiles(df: DataFrame, percents: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """spread_p10 ... spread_p90, exact."""
    q = F.percentile("spread", F.array(*[F.lit(p) for p in percents]))
    out = df.groupBy("contract_id").agg(q.alias("q"))
    return out.select("contract_id", *[F.col("q")[i].alias(f"spread_p{round(p * 100)}") for i, p in enumerate(percents)])


def spread_by_regime(df: DataFrame) -> DataFrame:
    """Mean, std, median and count of the spread in each event regime of a contract."""
    s = F.col("spread")
    return df.groupBy("contract_id", "regime").agg(F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), quantile(s, 0.5).alias("median"), F.count(s).alias("count"))


def _shocks(df: DataFrame, q: float, window_minutes: int, least: int) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with ``__took``, minutes to recovery at each shock's start, and the aggregates over them."""
    s = F.col("spread")
    df = df.withColumns({"__q": quantile(s, q).over(whole()), "__med": quantile(s, 0.5).over(whole()), "__t": F.unix_seconds("ts"), "__n": F.count(s).over(whole())})
    df = df.withColumn("__high", s > F.col("__q"))
    before = F.last("__high", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    ahead = whole().orderBy("__t").rangeBetween(0, window_minutes * 60)
    df = df.withColumns({"__start": flag(F.col("__high")) & ~flag(before), "__back": F.min(F.when(s <= F.col("__med"), F.col("__t"))).over(ahead)})
    df = df.withColumn("__took", F.when(F.col("__start"), (F.col("__back") - F.col("__t")) / 60.0))
    enough, k = F.max("__n") >= least, F.count_if("__start")
    rate = F.when(enough, F.when(k == 0, 1.0).otherwise(F.try_divide(F.count("__took"), k)))
    out = {"shocks": F.when(enough, k).otherwise(0), "median_recovery": F.when(enough, quantile("__took", 0.5)), "mean_recovery": F.when(enough, F.avg("__took")), "recovery_rate": rate}
    return df, out


def shock_resilience(df: DataFrame, q: float = 0.95, window_minutes: int = 30, least: int = 20) -> DataFrame:
    """Spread shocks (starts above the quantile) and how they recover to the median within the window.

    shocks, median_recovery and mean_recovery in minutes, recovery_rate: 1 without shocks, NULL
    below ``least`` rows.
    """
    df, aggs = _shocks(df.select("contract_id", "ts", "spread"), q, window_minutes, least)
    return df.groupBy("contract_id").agg(*[c.alias(k) for k, c in aggs.items()])


def _z(x: Column) -> Column:
    """z-score over the contract, 0 without deviation."""
    m, d = F.avg(x).over(whole()), F.stddev_samp(x).over(whole())
    return F.when(d > 0, (x - m) / d).otherwise(0.0)


def _volume_resilience(df: DataFrame) -> tuple[DataFrame, Column]:
    return df.withColumn("__vz", _z(F.col("volume").cast("double"))), 1 - F.count_if(F.col("__vz") < -1) / F.count("*")


def volume_resilience(df: DataFrame) -> DataFrame:
    """liquidity_resilience: 1 less the share of rows with a volume one deviation below the mean."""
    df, share = _volume_resilience(df.select("contract_id", "volume"))
    return df.groupBy("contract_id").agg(share.alias("liquidity_resilience"))


def _score(df: DataFrame) -> tuple[DataFrame, Column]:
    inverse = F.try_divide(F.lit(1.0), F.nullif(F.col("spread"), F.lit(0.0)))
    df = df.withColumns({"__zv": _z(F.col("volume").cast("double")), "__zi": _z(inverse)})
    return df, F.round((F.avg("__zv") + F.avg("__zi")) / 2, 9)


def liquidity_score(df: DataFrame) -> DataFrame:
    """liquidity_score: mean of the mean z-scores of volume and of 1 / spread; 0 but for rounding."""
    df, score = _score(df.select("contract_id", "volume", "spread"))
    return df.groupBy("contract_id").agg(score.alias("liquidity_score"))


def contract_analysis(df: DataFrame, settings: Surges | None = None) -> DataFrame:
    """One wide row for each contract: levels, slopes, percentiles, shocks and surges.

    All of it is windows over the contract and one grouping by it, in one pass with one shuffle. Every row
    with a positive spread counts in spread_collapse_log, while ``collapse_slope_log`` takes some of them.
    """
    s = settings or Surges()
    keep = ("contract_id", "ts", "spread", "spread_pct", "volume", "volatility_short", "depth_balance", "lifecycle_ratio", first_present(df, ABS_NAMES))
    df = df.select(*keep)
    df = _surge_columns(df, F.col("volume"), s.lookback_window, "__sv")
    df = _surge_columns(df, F.abs(F.col(keep[-1])), s.lookback_window, "__sa")
    df, score = _score(df)
    slope = _log_slope(_log_usable(), F.count_if(_log_usable()), 10)
    df, shocks = _shocks(df, 0.95, 30, 20)
    percents = (0.1, 0.25, 0.5, 0.75, 0.9)
    q = F.percentile("spread", F.array(*[F.lit(p) for p in percents]))
    count = lambda z, t: F.count_if(flag(F.col(z) > t))
    return df.groupBy("contract_id").agg(
        F.avg("spread").alias("avg_spread"), F.avg("spread_pct").alias("avg_spread_pct"), F.avg("volume").alias("avg_volume"), F.avg("volatility_short").alias("volatility"),
        F.avg("depth_balance").alias("depth_resilience"), score.alias("liquidity_score"), slope.alias("spread_collapse_log"), *[q[i].alias(f"spread_p{round(p * 100)}") for i, p in enumerate(percents)],
        *[c.alias(k) for k, c in shocks.items()], count("__sv_z", s.volume_threshold).alias("volume_surge_count"), count("__sa_z", s.volatility_threshold).alias("volatility_surge_count"),
    ).withColumn("surge_count", F.col("volume_surge_count") + F.col("volatility_surge_count"))


def full_analysis(df: DataFrame, contract_id: str) -> DataFrame:
    return contract_analysis(df.filter(F.col("contract_id") == contract_id))


def category_aggregates(df: DataFrame) -> DataFrame:
    """Pooled observations of each category."""
    return df.groupBy("category").agg(
        F.countDistinct("contract_id").alias("n_contracts"), F.avg("spread").alias("mean_spread"), quantile("spread", 0.5).alias("median_spread"),
        F.avg("volume").alias("mean_volume"), F.sum("volume").alias("total_volume"), F.avg("volatility_short").alias("mean_volatility"),
    )
