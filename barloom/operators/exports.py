"""Summary tables: contracts, categories, lifecycle bins, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.common import hours, quantile, whole
from barloom.operators.analytics import _bursts, _raw_slope, _volume_resilience
from barloom.operators.binning import lifecycle_bins
from barloom.operators.regimes import CODES, transition_matrix
from barloom.sources.bars import detect_frequency

LIFECYCLE_METRICS = ("spread", "volume", "volatility_short", "depth_resilience")
QUARTERS = ("early", "mid_early", "mid_late", "late")


def dataset_summary(bars: DataFrame) -> DataFrame:
    """A row for each contract: rows, frequency, first and last time, volume, mean price."""
    n = bars.groupBy("contract_id", "category").agg(F.count("*").alias("n_observations"), F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), F.sum("volume").alias("total_volume"), F.avg("price_c").alias("mean_price"))
    return n.join(detect_frequency(bars), "contract_id")


def upsert(bars: DataFrame, other: DataFrame) -> DataFrame:
    """``other`` replaces the contracts that it has."""
    return bars.join(other.select("contract_id").distinct(), "contract_id", "left_anti").unionByName(other)


def remove(bars: DataFrame, contract_ids: list[str]) -> DataFrame:
    return bars.filter(~F.col("contract_id").isin(contract_ids))


def by_category(bars: DataFrame, category: str) -> DataFrame:
    return bars.filter(F.col("category") == category)


def contracts(bars: DataFrame) -> DataFrame:
    return bars.select("contract_id", "category").distinct()


def _quarters() -> list[Column]:
    r = F.col("lifecycle_ratio")
    out = []
    for k, name in enumerate(QUARTERS):
        own = (r >= k / 4) & (r < (k + 1) / 4)
        out += [quantile(F.when(own, F.col(m)), 0.5).alias(f"lifecycle_{name}_{m}") for m in ("spread", "volume", "volatility_short")]
    return out


def lifecycle_quarters(df: DataFrame) -> DataFrame:
    """Medians of spread, volume and volatility_short in four equal quarters, closed on the left; ratio 1 is in none."""
    return df.groupBy("contract_id").agg(*_quarters())


def contract_metrics(df: DataFrame) -> DataFrame:
    """One row for each contract with all summary measures and fixed columns for states and quarters.

    Windows over the contract and one grouping by it: one pass, one shuffle. Entropy follows from the counts.
    """
    df, resilience = _volume_resilience(df)
    df, bursts = _bursts(df, 2.0, 10)
    n_of = lambda c: F.count_if(F.col("microstructure_state") == c)
    base = df.groupBy("contract_id", "category").agg(
        F.count("*").alias("n_observations"), hours(F.max("ts"), F.min("ts")).alias("duration_hours"), F.avg("spread").alias("mean_spread"), F.avg("spread_pct").alias("mean_spread_pct"),
        F.avg("volume").alias("mean_volume"), F.sum("volume").alias("total_volume"), F.avg("volatility_short").alias("mean_volatility"), F.max("volatility_short").alias("max_volatility"),
        F.avg("depth_resilience").alias("mean_depth_resilience"), _raw_slope(10).alias("spread_collapse_slope"), resilience.alias("liquidity_resilience"), bursts.alias("burst_intensity"),
        *_quarters(), *[n_of(c).alias(f"__n{c}") for c in CODES],
    )
    n = F.col("n_observations")
    share = lambda c: F.col(f"__n{c}") / n
    seen = reduce(lambda a, b: a + b, [F.when(F.col(f"__n{c}") > 0, 1).otherwise(0) for c in CODES])
    h = reduce(lambda a, b: a + b, [F.coalesce(-share(c) * F.log2(F.nullif(share(c), F.lit(0.0))), F.lit(0.0)) for c in CODES])
    top = F.greatest(*[F.struct(F.col(f"__n{c}").alias("n"), F.lit(-c).alias("c")) for c in CODES])["c"]
    out = base.withColumns({"regime_entropy": F.when(seen > 1, h / F.log2(F.nullif(seen, F.lit(1)).cast("double"))).otherwise(0.0), "dominant_regime": -top})
    return out.withColumns({f"regime_pct_{c}": share(c) * 100.0 for c in CODES}).drop(*[f"__n{c}" for c in CODES])


def category_summary(metrics: DataFrame) -> DataFrame:
    """Unweighted means of contract measures; the first four are NULL if any contract lacks them."""
    strict = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c))
    return metrics.groupBy("category").agg(
        F.count("*").alias("n_contracts"), F.sum("n_observations").alias("total_observations"), strict("mean_spread").alias("avg_spread"), strict("mean_spread_pct").alias("avg_spread_pct"),
        strict("mean_volume").alias("avg_volume"), strict("mean_volatility").alias("avg_volatility"), F.avg("mean_depth_resilience").alias("avg_depth_resilience"),
        F.avg("spread_collapse_slope").alias("avg_spread_collapse_slope"), F.avg("liquidity_resilience").alias("avg_liquidity_resilience"), F.avg("burst_intensity").alias("avg_burst_intensity"),
        F.avg("regime_entropy").alias("avg_regime_entropy"), *[F.avg(f"regime_pct_{c}").alias(f"regime_pct_{c}") for c in CODES],
    )


def lifecycle_binned(df: DataFrame, n: int = 50, metrics: tuple[str, ...] = LIFECYCLE_METRICS) -> DataFrame:
    """For every category and bin: statistics over the contracts' medians; std is of the population; empty bins have n = 0."""
    metrics = tuple(m for m in metrics if m in df.columns)
    binned = lifecycle_bins(df, n)
    per = binned.groupBy("category", "contract_id", "lifecycle_bin").agg(*[quantile(m, 0.5).alias(m) for m in metrics])
    aggs = []
    for m in metrics:
        q = F.percentile(F.col(m), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
        aggs += [q[0].alias(f"{m}_median"), F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), q[1].alias(f"{m}_p25"), q[2].alias(f"{m}_p75"), F.count(m).alias(f"{m}_n")]
    stats = per.groupBy("category", "lifecycle_bin").agg(*aggs)
    grid = df.select("category").distinct().select("category", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("lifecycle_bin"))
    out = grid.join(stats, ["category", "lifecycle_bin"], "left").na.fill(0, [f"{m}_n" for m in metrics])
    return out.withColumn("lifecycle_ratio", F.col("lifecycle_bin") / float(n) + 0.5 / n)


def lifecycle_figure(binned: DataFrame) -> DataFrame:
    """Means over categories of the binned table, for a chart by lifecycle ratio."""
    means = {"spread_median": "spread_median", "volume_p75": "volume_p75", "volatility_short_p75": "volatility_short_p75"}
    return binned.groupBy("lifecycle_bin").agg(F.min("lifecycle_ratio").alias("lifecycle_ratio"), *[F.avg(c).alias(k) for k, c in means.items()])


def export_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The four tables of an export."""
    m = contract_metrics(df)
    return {"contract_summary": m, "category_summary": category_summary(m), "lifecycle_binned_metrics": lifecycle_binned(df), "regime_transitions": transition_matrix(df)}


def run_summary(df: DataFrame, surges: DataFrame) -> DataFrame:
    """Console figures: contracts, mean spread and volume, surges, by category."""
    n = surges.groupBy("contract_id").agg(F.count("*").alias("surge_count"))
    per = df.groupBy("contract_id", "category").agg(F.avg("spread").alias("s"), F.avg("volume").alias("v")).join(n, "contract_id", "left")
    return per.groupBy("category").agg(F.count("*").alias("n_contracts"), F.avg("s").alias("mean_spread"), F.avg("v").alias("mean_volume"), F.sum(F.coalesce("surge_count", F.lit(0))).alias("surge_count"))


def with_length(bars: DataFrame) -> DataFrame:
    """n_observations beside every row, for filters."""
    return bars.withColumn("n_observations", F.count(F.lit(1)).over(whole()))
