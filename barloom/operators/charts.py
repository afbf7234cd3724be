"""Data behind the charts, and tables on states over the lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.common import by_time, hours, quantile, whole
from barloom.operators.binning import lifecycle_bins
from barloom.operators.regimes import entropy, state_shares, transition_probabilities


def liquidity_heatmap(df: DataFrame, metric: str = "volume", columns: int = 48) -> DataFrame:
    """Hourly sums of each contract over the first ``columns`` hours of the table: contract_id, slot, hour, value."""
    per = df.groupBy("contract_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum(metric).alias("value"))
    slots = per.select("hour").distinct().orderBy("hour").limit(columns)
    slots = slots.withColumn("slot", F.row_number().over(Window.orderBy("hour")) - 1)
    return per.join(F.broadcast(slots), "hour").select("contract_id", "slot", "hour", "value")


def category_totals(df: DataFrame, metric: str = "volume") -> DataFrame:
    return df.groupBy("category").agg(F.sum(metric).alias("total"))


def stacked_series(df: DataFrame, metric: str = "volume", unit: str = "day") -> DataFrame:
    """Sums by day and category, 0 where a category has none that day."""
    per = df.groupBy(F.date_trunc(unit, "ts").alias("period"), "category").agg(F.sum(metric).alias("value"))
    grid = per.select("period").distinct().crossJoin(F.broadcast(per.select("category").distinct()))
    return grid.join(per, ["period", "category"], "left").na.fill(0, ["value"])


def series(df: DataFrame, contract_id: str, columns: list[str]) -> DataFrame:
    """Chosen columns of one contract in order of time."""
    return df.filter(F.col("contract_id") == contract_id).select("ts", *[c for c in columns if c in df.columns]).orderBy("ts")


def spread_evolution(df: DataFrame, window: int = 20) -> DataFrame:
    """Rolling means over full windows of spread and spread_pct in percent."""
    w = by_time().rowsBetween(-(window - 1), 0)
    full = lambda c: F.when(F.count(c).over(w) >= window, F.avg(c).over(w))
    return df.select("contract_id", "ts", full("spread").alias("spread_ma"), (full("spread_pct") * 100).alias("spread_pct_ma"))


def _bin_medians(df: DataFrame, metric: str, n: int, more_than: int = 5) -> DataFrame:
    per = lifecycle_bins(df, n).groupBy("category", "contract_id", "lifecycle_bin").agg(quantile(metric, 0.5).alias("v")).filter("v is not null")
    return per.withColumn("__k", F.count("*").over(whole())).filter(F.col("__k") > more_than).drop("__k")


def _bands(per: DataFrame) -> DataFrame:
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    out = per.groupBy("category", "lifecycle_bin").agg(q.alias("q"), F.count("v").alias("n"))
    return out.select("category", "lifecycle_bin", F.col("q")[0].alias("median"), F.col("q")[1].alias("q25"), F.col("q")[2].alias("q75"), "n")


def spread_tightening(df: DataFrame, n: int = 50) -> DataFrame:
    """Bin medians of the spread scaled to 0..1 in each contract with more than five bins, then quartiles by category."""
    a, b = F.min("v").over(whole()), F.max("v").over(whole())
    per = _bin_medians(df, "spread", n).withColumn("v", F.when(b > a, (F.col("v") - a) / (b - a)).otherwise(0.5))
    return _bands(per)


def liquidity_trajectory(df: DataFrame, metric: str = "volume", n: int = 50, scaled: bool = True) -> DataFrame:
    """The same with z-scores; ``scaled=False`` for raw medians (depth)."""
    per = _bin_medians(df, metric, n)
    if scaled:
        m, s = F.avg("v").over(whole()), F.stddev_samp("v").over(whole())
        per = per.withColumn("v", F.when(s > 0, (F.col("v") - m) / s).otherwise(0.0))
    return _bands(per)


def volatility_bursts(df: DataFrame, n: int = 20) -> DataFrame:
    """By category and bin: mean volatility of bursts (above mean + 2 deviations of the contract) and their share of rows."""
    v = F.col("volatility_short")
    m, s = F.avg(v).over(whole()), F.stddev_samp(v).over(whole())
    rows = lifecycle_bins(df.withColumn("__b", F.coalesce((s > 0) & (v > m + 2 * s), F.lit(False))), n)
    by = rows.groupBy("category", "lifecycle_bin").agg(F.sum(F.when(F.col("__b"), v)).alias("total"), F.count_if("__b").alias("bursts"), F.count("*").alias("n"))
    grid = df.select("category").distinct().select("category", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("lifecycle_bin"))
    out = grid.join(by, ["category", "lifecycle_bin"], "left")
    return out.select("category", "lifecycle_bin", F.coalesce(F.try_divide(F.col("total"), F.col("bursts")), F.lit(0.0)).alias("intensity"), F.coalesce(F.try_divide(F.col("bursts"), F.col("n")), F.lit(0.0)).alias("frequency"))


def regime_occupancy(df: DataFrame) -> DataFrame:
    """Percent of all rows of a category in each state."""
    s = state_shares(df, ("category",))
    return s.select("category", "microstructure_state", (F.col("share") * 100).alias("percent"))


def category_fingerprint(df: DataFrame, metrics: tuple[str, ...] = ("spread", "volume", "volatility_short", "depth_resilience", "book_thinning")) -> DataFrame:
    """Medians over contracts of contract medians, scaled to 0..1 across categories; missing is 0. Long form."""
    metrics = tuple(m for m in metrics if m in df.columns)
    if len(metrics) < 3:
        return df.sparkSession.createDataFrame([], "category string, metric string, value double")
    per = df.groupBy("category", "contract_id").agg(*[quantile(m, 0.5).alias(m) for m in metrics])
    by = per.groupBy("category").agg(*[quantile(m, 0.5).alias(m) for m in metrics])
    long = by.select("category", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select("category", "x.*")
    w = Window.partitionBy("metric")
    a, b = F.min("v").over(w), F.max("v").over(w)
    return long.select("category", "metric", F.coalesce(F.when(b > a, (F.col("v") - a) / (b - a)).otherwise(F.when(F.col("v").isNotNull(), 0.5)), F.lit(0.0)).alias("value"))


def states_over_lifecycle(df: DataFrame, n: int = 50, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows in each state within each lifecycle bin."""
    return state_shares(lifecycle_bins(df, n), (*keys, "lifecycle_bin"))


def entropy_distribution(df: DataFrame, n: int = 10) -> DataFrame:
    """Contracts by bin of regime entropy (n bins of 0..1), by category."""
    e = entropy(df, ("category", "contract_id"))
    b = F.least(F.floor(F.col("regime_entropy") * n), F.lit(n - 1)).cast("int")
    return e.groupBy("category", b.alias("entropy_bin")).agg(F.count("*").alias("n_contracts"), quantile("regime_entropy", 0.5).alias("median_entropy"))


def category_transitions(df: DataFrame) -> DataFrame:
    """Transition probabilities within each category."""
    return transition_probabilities(df, ("category",))


def median_durations(df: DataFrame) -> DataFrame:
    """Median duration in hours of a category's contracts."""
    per = df.groupBy("category", "contract_id").agg(hours(F.max("ts"), F.min("ts")).alias("h"))
    return per.groupBy("category").agg(quantile("h", 0.5).alias("median_duration_hours"), F.count("*").alias("n_contracts"))


def chart_data(df: DataFrame) -> dict[str, DataFrame]:
    """All data sets of the atlas."""
    return {
        "liquidity_heatmap": liquidity_heatmap(df), "category_totals": category_totals(df), "stacked_series": stacked_series(df), "spread_evolution": spread_evolution(df),
        "spread_tightening": spread_tightening(df), "liquidity_trajectory": liquidity_trajectory(df), "volatility_bursts": volatility_bursts(df), "regime_occupancy": regime_occupancy(df),
        "category_fingerprint": category_fingerprint(df), "category_transitions": category_transitions(df), "states_over_lifecycle": states_over_lifecycle(df),
    }
