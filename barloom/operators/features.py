"""Row features and rolling windows over one contract's bars."""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import Features
from barloom.functions.common import by_time, clip, first_present, flag, gate, minutes, rows, safe_div, so_far

PRICE_NAMES = ("price_c", "price", "close", "last_price")
BID_NAMES, ASK_NAMES = ("yes_bid_c", "bid_c", "bid"), ("yes_ask_c", "ask_c", "ask")


def returns(df: DataFrame, price: str | None = None) -> DataFrame:
    """pct_return, log_return, logit_return, abs_return of the filled price."""
    price = price or first_present(df, PRICE_NAMES)
    if price is None:
        return df
    df = df.withColumn("__p", F.last(price, ignorenulls=True).over(so_far()))
    p, q = F.col("__p"), F.lag("__p").over(by_time())
    share = lambda x: clip(x / 100, 0.001, 0.999)
    logit = lambda x: F.ln(share(x) / (1 - share(x)))
    df = df.withColumns({"pct_return": safe_div(p, q) - 1, "log_return": F.ln(safe_div(p, q)), "logit_return": logit(p) - logit(q)})
    return df.withColumn("abs_return", F.abs("pct_return")).drop("__p")


def volatility(df: DataFrame, settings: Features | None = None) -> DataFrame:
    """Rolling deviations of returns, annualised too, realized_variance, price_range."""
    s = settings or Features()
    out: dict[str, Column] = {}
    for name in ("short", "medium", "long"):
        v = gate("pct_return", F.stddev_samp, getattr(s.rolling, name), s.min_periods)
        out[f"volatility_{name}"] = v
        out[f"volatility_{name}_ann"] = v * (float(s.annualization_factor) ** 0.5)
    out["realized_variance"] = F.col("pct_return") * F.col("pct_return")
    if {"price_h", "price_l"} <= set(df.columns):
        out["price_range"] = F.col("price_h") - F.col("price_l")
    return df.withColumns(out)


def parkinson(df: DataFrame, high: str = "price_h", low: str = "price_l", window: int = 20) -> DataFrame:
    """parkinson_volatility: a full window of logarithms of high over low."""
    ratio = safe_div(high, low)
    return df.withColumn("__x", F.pow(F.ln(F.when(ratio > 0, ratio)), 2)).withColumn("parkinson_volatility", F.sqrt(gate("__x", F.avg, window, window) / (4 * log(2)))).drop("__x")


def liquidity(df: DataFrame, window: int = 20) -> DataFrame:
    """Rolling mean, deviation and z-score of volume, running total, surge, trade size, logarithm."""
    v = F.col("volume").cast("double")
    ma, sd = F.avg(v).over(rows(window)), F.stddev_samp(v).over(rows(window))
    out = {"volume_ma": ma, "volume_std": sd, "volume_zscore": F.when(sd > 0, (v - ma) / sd).otherwise(0.0), "cumulative_volume": F.sum("volume").over(so_far())}
    out |= {"volume_surge": safe_div(v, ma), "log_volume": F.log1p(v)}
    if "trade_count" in df.columns:
        out["avg_trade_size"] = F.when(F.col("trade_count") > 0, safe_div(v, "trade_count"))
    return df.withColumns(out)


def spreads(df: DataFrame, window: int = 20) -> DataFrame:
    """spread, midpoint, spread_pct, spread_bps, spread_ma, spread_tightening, effective_spread; crossed quotes stay negative."""
    bid, ask = first_present(df, BID_NAMES), first_present(df, ASK_NAMES)
    if bid is None or ask is None:
        return df
    df = df.withColumn("spread", F.col(ask) - F.col(bid)).withColumn("midpoint", (F.col(ask) + F.col(bid)) / 2)
    pct = F.when(F.col("midpoint") > 0, F.try_divide("spread", "midpoint"))
    price = first_present(df, PRICE_NAMES)
    effective = 2 * F.abs(F.col(price) - F.col("midpoint")) if price else F.lit(None).cast("double")
    return df.withColumns(
        {"spread_pct": pct, "spread_bps": pct * 10_000, "spread_ma": F.avg("spread").over(rows(window)), "spread_tightening": F.col("spread") - F.lag("spread").over(by_time()), "effective_spread": effective}
    )


def depth(df: DataFrame) -> DataFrame:
    """bid_range, ask_range and their mean book_thinning."""
    if not {"yes_bid_h", "yes_bid_l", "yes_ask_h", "yes_ask_l"} <= set(df.columns):
        return df
    bid, ask = F.col("yes_bid_h") - F.col("yes_bid_l"), F.col("yes_ask_h") - F.col("yes_ask_l")
    return df.withColumns({"bid_range": bid, "ask_range": ask, "book_thinning": (bid + ask) / 2})


def _change(df: DataFrame) -> DataFrame:
    return df.withColumn("__d", F.col("spread") - F.lag("spread").over(by_time()))


def depth_resilience_share(df: DataFrame, window: int = 10) -> DataFrame:
    """depth_resilience: falls of the spread among the last ``window`` changes, as a share of the window."""
    return _change(df).withColumn("depth_resilience", F.when(F.count("__d").over(rows(window)) >= window, F.sum(F.when(F.col("__d") < 0, 1).otherwise(0)).over(rows(window)) / window)).drop("__d")


def depth_resilience_balance(df: DataFrame, window: int = 10) -> DataFrame:
    """depth_balance: falls among the falls and rises of the last ``window`` changes."""
    w = rows(window)
    n, p = (F.sum(F.when(c, 1).otherwise(0)).over(w) for c in (F.col("__d") < 0, F.col("__d") > 0))
    return _change(df).withColumn("depth_balance", F.when((F.count("__d").over(w) >= window) & (n + p > 0), F.try_divide(n, n + p))).drop("__d")


def depth_impact(df: DataFrame, window: int = 60, large: float = 2.0) -> DataFrame:
    """volume_spread_corr over a full window, and post_large_spread behind rows of large volume."""
    w, v = rows(window), F.col("volume").cast("double")
    both = F.when(v.isNotNull() & F.col("spread").isNotNull(), 1)
    corr = safe_div(F.covar_samp(v, F.col("spread")).over(w), F.stddev_samp(F.when(both == 1, v)).over(w) * F.stddev_samp(F.when(both == 1, F.col("spread"))).over(w))
    big = flag(v > large * F.avg(v).over(rows(20)))
    df = df.withColumn("__big", big).withColumn("volume_spread_corr", F.when(F.count(both).over(w) >= window, corr))
    return df.withColumn("post_large_spread", F.when(F.lag("__big").over(by_time()), F.col("spread"))).drop("__big")


def event_regime_code(to_event: Column, pregame_hours: float = 24, ingame_hours: float = 3) -> Column:
    """PREGAME 2, IN_GAME 3, POST_EVENT 5, UNKNOWN 7, from minutes to the event."""
    code = F.when((to_event > 0) & (to_event <= pregame_hours * 60), 2).when((to_event <= 0) & (to_event > -ingame_hours * 60), 3).when(to_event <= -ingame_hours * 60, 5)
    return code.otherwise(7)


def calendar(df: DataFrame, with_event: bool = False, zone: str = "UTC") -> DataFrame:
    """Hour, weekday (Monday 0), weekend, market hours and session marks; minutes to the event and its regime if asked."""
    local = F.col("ts") if zone == "UTC" else F.from_utc_timestamp("ts", zone)
    h, m, d = F.hour(local), F.minute(local), F.weekday(local)
    df = df.withColumns(
        {
            "hour_of_day": h, "day_of_week": d, "is_weekend": (d >= 5).cast("int"), "is_market_hours": ((h >= 9) & (h < 16)).cast("int"),
            "session_start": (h == 9) & (m < 5), "session_end": (h == 15) & (m >= 55),
        }
    )
    if with_event:
        df = df.withColumn("minutes_to_event", minutes(F.col("event_time"), F.col("ts"))).withColumn("regime", event_regime_code(F.col("minutes_to_event")))
    return df


def engineer(df: DataFrame, extractors: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All features in order; pass ``extractors`` to choose or to add one's own."""
    from barloom.operators.binning import lifecycle
    from barloom.operators.regimes import states

    for f in extractors or [returns, volatility, liquidity, spreads, depth, depth_resilience_share, calendar, lifecycle, states]:
        df = df.transform(f)
    return df


def feature_names(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c not in before.columns]
