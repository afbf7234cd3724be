"""Registered queries over bars made from the events table, each with its DuckDB SQL.

Numbers are rounded to six decimals on both sides, in one way; times are seconds since the epoch. Bars are
put on an hourly grid here, because the events of a contract are hours apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import Alignment, Cleaning
from barloom.operators import analytics, binning, charts, cleaning, exports, features, normalise, regimes, trajectories
from barloom.operators.resample import resample
from barloom.plans import sql as S
from barloom.sources import bars as source

HOUR = 3600


def _six(c: Column) -> Column:
    """Six decimals as DuckDB's round gives them: of the double times a million. F.round(c, 6) goes by the shortest text and rounds 0.0640625 up."""
    return F.round(c * 1e6) / 1e6


@dataclass
class Query:
    make: Callable[[SparkSession, str], DataFrame]
    exact: str
    real: str = ""
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.make(spark, sf_dir)
        types = dict(df.dtypes)
        exact = [(F.unix_seconds(c) if types[c] == "timestamp" else F.col(c)).alias(c) for c in self.exact.split()]
        return df.select(*exact, *[(_six(F.col(c).cast("double")) + 0.0).alias(c) for c in self.real.split()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        times = {"ts", "bin", "start_date", "end_date", "hour", "period", "event_time"}
        cols = [f"CAST(floor(epoch({c})) AS BIGINT) AS {c}" if c in times else c for c in self.exact.split()]
        cols += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in self.real.split()]
        return f"{S.with_needed(self.sql)} SELECT {', '.join(cols)} FROM ({self.sql}) AS result"


def bars(spark: SparkSession, d: str) -> DataFrame:
    return source.bars_from_events(spark, d)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean(bars(spark, d))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return resample(cleaned(spark, d), HOUR)


def table(spark: SparkSession, d: str) -> DataFrame:
    """The feature table; Catalyst drops what a query does not use."""
    return features.depth_resilience_balance(features.engineer(hourly(spark, d)))


def _with_event(df: DataFrame) -> DataFrame:
    """An event in the middle of each contract's life, at a full hour."""
    mid = F.timestamp_seconds(F.floor((F.unix_seconds(F.min("ts").over(_whole())) + F.unix_seconds(F.max("ts").over(_whole()))) / 2 / HOUR) * HOUR)
    return df.withColumn("event_time", mid)


def _whole():
    from barloom.functions.common import whole

    return whole()


GRID = Alignment(grid_hours_pre=24, grid_hours_post=24, interpolation_grid_minutes=60)


def _aligned(spark: SparkSession, d: str, **kw) -> DataFrame:
    return trajectories.align(_with_event(table(spark, d)), ["spread", "volume"], GRID, max_gap=kw.pop("max_gap", 600), **kw)


def _sides(spark: SparkSession, d: str) -> DataFrame:
    return trajectories.compare_sides(trajectories.event_window(_with_event(table(spark, d)), 1440, 1440), ("spread", "volume"))


def _validated(spark, d):
    v = cleaning.validate(bars(spark, d), Cleaning(max_spread_pct=0.5))
    return v.select("contract_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


def _linear(spark, d):
    return cleaning.impute(bars(spark, d), ["price_c"], "linear")


def _fitted(spark, d):
    h = features.spreads(hourly(spark, d))
    return normalise.Normalizer("robust").fit_transform(h, ["volume", "spread"])


def _ids(spark, d):
    f = spark.createDataFrame([("nfl",), (" Politics",), ("Sports",), ("some-other cat",), ("BTC",), ("climate",)], "raw string")
    return f.select("raw", source.canonical_category(F.col("raw")).alias("category"), source.valid_contract_id(F.col("raw")).alias("valid_id"), source.status_code(F.col("raw")).alias("status"))


def _panel(spark, d):
    b = exports.by_category(source.at_least(bars(spark, d), 60), "Sports")
    return b.select("contract_id", "category", "ts", "volume", "price_c")


Q: dict[str, Query] = {}

_F = "contract_id ts"
Q["s_bars_adapter"] = Query(bars, "contract_id category ts event_id volume trade_count", "price_c price_h price_l yes_bid_c yes_bid_h yes_bid_l yes_ask_c yes_ask_h yes_ask_l", "SELECT * FROM bars")
Q["s_load_min_observations"] = Query(_panel, "contract_id category ts volume", "price_c", "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY contract_id) AS n FROM bars) WHERE n >= 60 AND category = 'Sports'")
Q["i_identity"] = Query(_ids, "raw category valid_id status", "", S.IDENTITY)
Q["i_detect_frequency"] = Query(lambda s, d: source.detect_frequency(bars(s, d)), "contract_id frequency", "", S.FREQUENCY)
Q["i_event_time"] = Query(lambda s, d: source.with_event_time(bars(s, d)).select("contract_id", "event_time").distinct(), "contract_id event_time", "", "SELECT contract_id, CASE WHEN category = 'Sports' THEN min(ts) ELSE max(ts) END AS event_time FROM bars GROUP BY contract_id, category")
Q["c_validate_prices"] = Query(lambda s, d: cleaning.validate_prices(bars(s, d), 5, 95), "contract_id field below above", "", S.VALIDATE_PRICES)
Q["c_validate_spreads"] = Query(lambda s, d: cleaning.validate_spreads(bars(s, d), 0.5), "contract_id wide_spreads", "", "SELECT contract_id, count(*) FILTER (WHERE CASE WHEN yes_bid_c = 0 THEN yes_ask_c > 0 ELSE (yes_ask_c - yes_bid_c) / yes_bid_c > 0.5 END) AS wide_spreads FROM bars GROUP BY 1")
Q["c_validate_times"] = Query(lambda s, d: cleaning.validate_times(bars(s, d), "event_id"), "contract_id null_times backward_times", "", "SELECT contract_id, count(*) FILTER (WHERE ts IS NULL) AS null_times, count(*) FILTER (WHERE ts < p) AS backward_times FROM (SELECT *, lag(ts) OVER (PARTITION BY contract_id ORDER BY event_id) AS p FROM bars) GROUP BY 1")
Q["c_validate"] = Query(_validated, "contract_id is_valid errors", "", S.VALIDATE)
Q["c_impute_forward"] = Query(lambda s, d: cleaning.impute(bars(s, d), ["price_c"]), "contract_id ts", "price_c", "SELECT contract_id, ts, last_value(price_c IGNORE NULLS) OVER (PARTITION BY contract_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS price_c FROM bars")
Q["c_impute_backward"] = Query(lambda s, d: cleaning.impute(bars(s, d), ["price_c"], "backward_fill"), "contract_id ts", "price_c", "SELECT contract_id, ts, first_value(price_c IGNORE NULLS) OVER (PARTITION BY contract_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price_c FROM bars")
Q["c_impute_linear"] = Query(_linear, "contract_id ts", "price_c", S.LINEAR)
Q["c_winsorize"] = Query(lambda s, d: cleaning.winsorize(bars(s, d), ["price_c"], 0.1, 0.1), "contract_id ts", "price_c", "SELECT contract_id, ts, CASE WHEN price_c IS NOT NULL THEN least(greatest(price_c, lo), hi) END AS price_c FROM (SELECT *, quantile_cont(price_c, 0.1) OVER (PARTITION BY contract_id) AS lo, quantile_cont(price_c, 0.9) OVER (PARTITION BY contract_id) AS hi FROM bars)")
Q["c_clean"] = Query(cleaned, "contract_id category ts volume trade_count", "price_c price_h price_l yes_bid_c yes_ask_c yes_bid_h yes_ask_l", "SELECT * FROM cl")
Q["c_cleaning_stats"] = Query(lambda s, d: cleaning.cleaning_stats(bars(s, d)), "contract_id original_rows final_rows rows_removed nulls_imputed outliers_winsorized invalid_prices_fixed", "removal_pct", S.STATS)
Q["c_detect_gaps"] = Query(lambda s, d: cleaning.detect_gaps(bars(s, d), 600), "contract_id ts gap", "", "SELECT contract_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY contract_id ORDER BY ts) > 36000000000, false) AS gap FROM bars")
Q["e_resample"] = Query(hourly, "contract_id category ts volume trade_count", "price_c price_h price_l yes_bid_c yes_bid_h yes_bid_l yes_ask_c yes_ask_h yes_ask_l", "SELECT * FROM hr")
Q["e_returns"] = Query(lambda s, d: features.returns(hourly(s, d)), _F, "pct_return log_return logit_return abs_return", "SELECT * FROM f")
Q["e_volatility"] = Query(lambda s, d: features.volatility(features.returns(hourly(s, d))), _F, "volatility_short volatility_medium volatility_long volatility_short_ann realized_variance price_range", "SELECT * FROM f")
Q["e_parkinson"] = Query(lambda s, d: features.parkinson(hourly(s, d)), _F, "parkinson_volatility", S.PARKINSON)
Q["e_liquidity"] = Query(lambda s, d: features.liquidity(hourly(s, d)), "contract_id ts cumulative_volume", "volume_ma volume_std volume_zscore volume_surge avg_trade_size log_volume", "SELECT * FROM f")
Q["e_spreads"] = Query(lambda s, d: features.spreads(hourly(s, d)), _F, "spread midpoint spread_pct spread_bps spread_ma spread_tightening effective_spread", "SELECT * FROM f")
Q["e_depth"] = Query(lambda s, d: features.depth(hourly(s, d)), _F, "bid_range ask_range book_thinning", "SELECT * FROM f")
Q["e_depth_resilience_share"] = Query(lambda s, d: features.depth_resilience_share(features.spreads(hourly(s, d))), _F, "depth_resilience", "SELECT * FROM f")
Q["e_depth_resilience_balance"] = Query(lambda s, d: features.depth_resilience_balance(features.spreads(hourly(s, d))), _F, "depth_balance", "SELECT * FROM f")
Q["e_depth_impact"] = Query(lambda s, d: features.depth_impact(features.spreads(hourly(s, d))), _F, "volume_spread_corr post_large_spread", S.IMPACT)
Q["e_calendar"] = Query(lambda s, d: features.calendar(_with_event(hourly(s, d)), with_event=True), "contract_id ts hour_of_day day_of_week is_weekend is_market_hours session_start session_end regime", "minutes_to_event", S.CALENDAR)
Q["b_lifecycle"] = Query(lambda s, d: binning.lifecycle(hourly(s, d)), "contract_id ts lifecycle_phase", "tsl_hours tts_hours lifecycle_ratio", "SELECT * FROM f")
Q["b_lifecycle_settlement"] = Query(lambda s, d: binning.lifecycle(_with_event(hourly(s, d)), event=F.col("event_time")), "contract_id ts lifecycle_phase", "tsl_hours tts_hours lifecycle_ratio", S.SETTLEMENT)
Q["b_lifecycle_bins"] = Query(lambda s, d: binning.lifecycle_bins(binning.lifecycle(hourly(s, d)), 20), "contract_id ts lifecycle_bin", "lifecycle_bin_center", "SELECT *, lb20 AS lifecycle_bin, lb20 / 20.0 + 0.025 AS lifecycle_bin_center FROM f")
Q["b_nonlinear_bins"] = Query(lambda s, d: binning.lifecycle_bins(binning.lifecycle(hourly(s, d)), nonlinear=True), "contract_id ts lifecycle_bin", "lifecycle_bin_center", S.NONLINEAR)
Q["b_settlement_bins"] = Query(lambda s, d: binning.time_bins(hourly(s, d), "tts_hours", hours_pre=48)[0], "contract_id ts tts_bin", "tts_bin_hours", "SELECT *, tts_bin + 0.5 AS tts_bin_hours FROM (SELECT *, greatest(0, least(47, CAST(ceil(least(greatest(tts_hours, 0), 48)) - 1 AS INT))) AS tts_bin FROM f)")
Q["b_event_bins"] = Query(lambda s, d: binning.event_bins(_with_event(hourly(s, d)), 60, 24, 4), "contract_id ts event_bin", "minutes_to_event event_bin_minutes", S.EVENT_BINS)
Q["b_aggregate_by_bins"] = Query(
    lambda s, d: binning.aggregate_by_bins(binning.lifecycle_bins(features.spreads(binning.lifecycle(hourly(s, d))), 20), ["contract_id", "lifecycle_bin"], {"spread": ["mean", "median", "std", "first", "last"], "volume": ["sum", "max", "count"], "absent": ["mean"]}),
    "contract_id lifecycle_bin volume_sum volume_max volume_count", "spread_mean spread_median spread_std spread_first spread_last", S.BY_BINS,
)
Q["b_binned_trajectory"] = Query(lambda s, d: binning.binned_trajectory(binning.lifecycle_bins(features.spreads(binning.lifecycle(hourly(s, d))), 20), "spread", "lifecycle_bin", "lifecycle_bin_center", ("category",)), "category lifecycle_bin count", "center p10 p25 p50 p75 p90", S.TRAJECTORY)
Q["r_states"] = Query(table, "contract_id ts microstructure_state microstructure_state_name regime_transition", "", S.STATES)
Q["r_burst_mask"] = Query(lambda s, d: regimes.burst_mask(features.returns(hourly(s, d))), "contract_id ts volatility_burst", "", "SELECT contract_id, ts, coalesce(abs(pct_return) > 2.5 * sigma, false) AND coalesce(volume > 1.5 * volume_ma, false) AS volatility_burst FROM f")
Q["r_transition_counts"] = Query(lambda s, d: regimes.transition_counts(table(s, d)), "from_state to_state n", "", S.TRANSITIONS)
Q["r_transition_matrix"] = Query(lambda s, d: regimes.transition_matrix(table(s, d)), "from_state", "to_1 to_2 to_3 to_4 to_5 to_6", S.MATRIX)
Q["r_entropy"] = Query(lambda s, d: regimes.entropy(table(s, d)), "contract_id n_states dominant_regime", "regime_entropy", S.ENTROPY)
Q["r_robustness"] = Query(lambda s, d: regimes.robustness(regimes.robustness_features(bars(s, d))), "spec contract_id n", "pct_1 pct_2 pct_3 pct_4 pct_5 pct_6", S.robustness(regimes.SPECS))
Q["r_bootstrap"] = Query(lambda s, d: regimes.bootstrap(table(s, d)), "state", "mean std low high")
Q["k_volume_surges"] = Query(lambda s, d: analytics.volume_surges(hourly(s, d)), "contract_id ts type", "magnitude baseline", S.surge("volume", "volume"))
Q["k_volatility_surges"] = Query(lambda s, d: analytics.volatility_surges(features.returns(hourly(s, d))), "contract_id ts type", "magnitude baseline", S.surge("abs_return", "volatility"))
Q["k_surge_ratio"] = Query(lambda s, d: analytics.surge_ratio(hourly(s, d)), _F, "surge_ratio", "SELECT contract_id, ts, CASE WHEN count(volume) OVER w >= 5 THEN volume / nullif(avg(CAST(volume AS DOUBLE)) OVER w, 0) END AS surge_ratio FROM hr WINDOW w AS (PARTITION BY contract_id ORDER BY ts ROWS 29 PRECEDING)")
Q["k_burst_intensity"] = Query(lambda s, d: analytics.burst_intensity(table(s, d)), "contract_id", "burst_intensity", S.INTENSITY)
Q["k_collapse_slope_log"] = Query(lambda s, d: analytics.collapse_slope_log(table(s, d)), "contract_id", "spread_collapse_log", S.SLOPE_LOG)
Q["k_collapse_slope_raw"] = Query(lambda s, d: analytics.collapse_slope_raw(table(s, d)), "contract_id", "spread_collapse_slope", "SELECT contract_id, CASE WHEN count(*) >= 10 THEN regr_slope(spread, lifecycle_ratio) END AS spread_collapse_slope FROM f WHERE spread IS NOT NULL GROUP BY 1")
Q["k_spread_curve"] = Query(lambda s, d: analytics.spread_curve(features.spreads(hourly(s, d)), 4 * HOUR), "contract_id bin", "spread_mean spread_std spread_min spread_max spread_first spread_last tightening tightening_pct", S.CURVE)
Q["k_spread_percentiles"] = Query(lambda s, d: analytics.spread_percentiles(features.spreads(hourly(s, d))), "contract_id", "spread_p10 spread_p25 spread_p50 spread_p75 spread_p90", "SELECT contract_id, " + ", ".join(f"quantile_cont(spread, {p / 100}) AS spread_p{p}" for p in (10, 25, 50, 75, 90)) + " FROM f GROUP BY 1")
Q["k_spread_by_regime"] = Query(lambda s, d: analytics.spread_by_regime(features.calendar(_with_event(features.spreads(hourly(s, d))), True)), "contract_id regime count", "mean std median", S.BY_REGIME)
Q["k_shock_resilience"] = Query(lambda s, d: analytics.shock_resilience(features.spreads(hourly(s, d)), window_minutes=360), "contract_id shocks", "median_recovery mean_recovery recovery_rate", S.SHOCKS)
Q["k_volume_resilience"] = Query(lambda s, d: analytics.volume_resilience(hourly(s, d)), "contract_id", "liquidity_resilience", "SELECT contract_id, 1 - count(*) FILTER (WHERE CASE WHEN s > 0 THEN (volume - m) / s ELSE 0 END < -1) / count(*) AS liquidity_resilience FROM (SELECT *, avg(CAST(volume AS DOUBLE)) OVER (PARTITION BY contract_id) AS m, stddev_samp(volume) OVER (PARTITION BY contract_id) AS s FROM hr) GROUP BY 1")
Q["k_contract_analysis"] = Query(
    lambda s, d: analytics.contract_analysis(table(s, d)), "contract_id volume_surge_count volatility_surge_count surge_count shocks",
    "avg_spread avg_spread_pct avg_volume volatility depth_resilience spread_collapse_log spread_p10 spread_p25 spread_p50 spread_p75 spread_p90 median_recovery mean_recovery recovery_rate", S.ANALYSIS,
)
Q["k_category_aggregates"] = Query(lambda s, d: analytics.category_aggregates(table(s, d)), "category n_contracts total_volume", "mean_spread median_spread mean_volume mean_volatility", "SELECT category, count(DISTINCT contract_id) AS n_contracts, CAST(sum(volume) AS BIGINT) AS total_volume, avg(spread) AS mean_spread, quantile_cont(spread, 0.5) AS median_spread, avg(volume) AS mean_volume, avg(volatility_short) AS mean_volatility FROM f GROUP BY 1")
Q["l_align_linear"] = Query(_aligned, "contract_id category metric grid_min n", "value", S.ALIGN)
Q["l_align_nearest"] = Query(lambda s, d: _aligned(s, d, method="nearest"), "contract_id category metric grid_min n", "value", S.ALIGN)
Q["l_align_cubic"] = Query(lambda s, d: _aligned(s, d, method="cubic"), "contract_id category metric grid_min n", "value", S.ALIGN)
Q["l_align_sparse"] = Query(lambda s, d: trajectories.align(_with_event(cleaned(s, d)), ["price_c", "volume"], GRID, max_gap=600), "contract_id category metric grid_min n", "value", S.ALIGN_SPARSE)
Q["l_normalise"] = Query(lambda s, d: trajectories.normalise_trajectories(_aligned(s, d)), "contract_id metric grid_min", "value", f"SELECT contract_id, metric, grid_min, CASE WHEN count(*) OVER w < 2 THEN value WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS value FROM ({S.ALIGN}) WINDOW w AS (PARTITION BY contract_id, metric)")
Q["l_aggregate_overall"] = Query(lambda s, d: trajectories.aggregate(_aligned(s, d), False, normalize=False), "metric category grid_min count", "median mean p10 p25 p75 p90 std", S.weighted("'overall'"))
Q["l_aggregate_category"] = Query(lambda s, d: trajectories.aggregate(_aligned(s, d), True, normalize=False), "metric category grid_min count", "median mean p10 p25 p75 p90 std", S.weighted("category"))
Q["l_signatures"] = Query(lambda s, d: trajectories.signatures(_with_event(table(s, d)), GRID), "metric category grid_min count", "median mean p10 p25 p75 p90 std", S.SIGNATURES)
Q["l_event_window"] = Query(lambda s, d: trajectories.event_window(_with_event(hourly(s, d)), 1440, 720), "contract_id ts side", "", S.WINDOW)
Q["l_median_trajectory"] = Query(lambda s, d: trajectories.median_trajectory(trajectories.normalise_to_event(trajectories.event_window(_with_event(hourly(s, d)), 1440, 720))), "count", "x median q25 q75 std", S.MEDIAN)
Q["l_compare_sides"] = Query(_sides, "contract_id metric n_pre n_post", "mean_pre mean_post std_pre std_post change_pct t_stat ks_stat", S.SIDES)
Q["n_zscore"] = Query(lambda s, d: normalise.normalise_columns(hourly(s, d), ["volume"], "zscore"), _F, "volume_norm", "SELECT contract_id, ts, CASE WHEN stddev_samp(volume) OVER w > 0 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w ELSE 0 END AS volume_norm FROM hr WINDOW w AS (PARTITION BY contract_id)")
Q["n_zscore_rolling"] = Query(lambda s, d: hourly(s, d).withColumn("volume_norm", normalise.zscore("volume", 20)), _F, "volume_norm", "SELECT contract_id, ts, (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) AS volume_norm FROM hr WINDOW w AS (PARTITION BY contract_id ORDER BY ts ROWS 19 PRECEDING)")
Q["n_percentile"] = Query(lambda s, d: normalise.normalise_columns(hourly(s, d), ["volume"]), _F, "volume_norm", "SELECT contract_id, ts, (rank() OVER (PARTITION BY contract_id ORDER BY volume) + (count(*) OVER (PARTITION BY contract_id, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY contract_id) AS volume_norm FROM hr")
Q["n_minmax"] = Query(lambda s, d: normalise.normalise_columns(hourly(s, d), ["volume"], {"volume": "minmax"}), _F, "volume_norm", "SELECT contract_id, ts, CASE WHEN max(volume) OVER w > min(volume) OVER w THEN (volume - min(volume) OVER w) / (max(volume) OVER w - min(volume) OVER w) ELSE 0.5 END AS volume_norm FROM hr WINDOW w AS (PARTITION BY contract_id)")
Q["n_robust"] = Query(lambda s, d: normalise.normalise_columns(bars(s, d), ["volume"], "robust"), _F, "volume_norm", "SELECT contract_id, ts, CASE WHEN h > l THEN (volume - m) / (h - l) ELSE 0 END AS volume_norm FROM (SELECT *, quantile_cont(volume, 0.5) OVER w AS m, quantile_cont(volume, 0.25) OVER w AS l, quantile_cont(volume, 0.75) OVER w AS h FROM bars WINDOW w AS (PARTITION BY contract_id))")
Q["n_across_zscore"] = Query(lambda s, d: normalise.across_contracts(hourly(s, d), "volume"), _F, "volume_norm", "SELECT contract_id, ts, (volume - avg(volume) OVER ()) / stddev_samp(volume) OVER () AS volume_norm FROM hr")
Q["n_across_percentile"] = Query(lambda s, d: normalise.across_contracts(hourly(s, d), "volume", "percentile"), _F, "volume_norm", "SELECT contract_id, ts, (rank() OVER (ORDER BY volume) - 1) / count(*) OVER () AS volume_norm FROM hr")
Q["n_normalizer"] = Query(_fitted, _F, "volume_norm spread_norm", "SELECT contract_id, ts, CASE WHEN vh > vl THEN (volume - vm) / (vh - vl) ELSE 0 END AS volume_norm, CASE WHEN sh > sl THEN (spread - sm) / (sh - sl) ELSE 0 END AS spread_norm FROM f, (SELECT quantile_cont(volume, 0.5) AS vm, quantile_cont(volume, 0.25) AS vl, quantile_cont(volume, 0.75) AS vh, quantile_cont(spread, 0.5) AS sm, quantile_cont(spread, 0.25) AS sl, quantile_cont(spread, 0.75) AS sh FROM f)")
Q["x_dataset_summary"] = Query(lambda s, d: exports.dataset_summary(bars(s, d)), "contract_id category n_observations start_date end_date total_volume frequency", "mean_price", S.SUMMARY)
Q["x_contract_metrics"] = Query(
    lambda s, d: exports.contract_metrics(table(s, d)), "contract_id category n_observations total_volume dominant_regime",
    "duration_hours mean_spread mean_spread_pct mean_volume mean_volatility max_volatility mean_depth_resilience spread_collapse_slope liquidity_resilience burst_intensity regime_entropy regime_pct_1 regime_pct_2 regime_pct_3 regime_pct_4 regime_pct_5 regime_pct_6 "
    + " ".join(f"lifecycle_{n}_{m}" for n in exports.QUARTERS for m in ("spread", "volume", "volatility_short")), S.METRICS,
)
Q["x_category_summary"] = Query(
    lambda s, d: exports.category_summary(exports.contract_metrics(table(s, d))), "category n_contracts total_observations",
    "avg_spread avg_spread_pct avg_volume avg_volatility avg_depth_resilience avg_spread_collapse_slope avg_liquidity_resilience avg_burst_intensity avg_regime_entropy regime_pct_1 regime_pct_2 regime_pct_3 regime_pct_4 regime_pct_5 regime_pct_6", S.CATEGORY,
)
Q["x_lifecycle_binned"] = Query(lambda s, d: exports.lifecycle_binned(table(s, d), 20), "category lifecycle_bin spread_n volume_n", "lifecycle_ratio spread_median spread_mean spread_std spread_p25 spread_p75 volume_median volume_mean volume_std volatility_short_median depth_resilience_mean", S.BINNED)
Q["x_lifecycle_figure"] = Query(lambda s, d: exports.lifecycle_figure(exports.lifecycle_binned(table(s, d), 20)), "lifecycle_bin", "lifecycle_ratio spread_median volume_p75 volatility_short_p75", S.FIGURE)
Q["x_run_summary"] = Query(lambda s, d: exports.run_summary(table(s, d), analytics.volume_surges(hourly(s, d))), "category n_contracts surge_count", "mean_spread mean_volume", S.RUN_SUMMARY)
Q["v_liquidity_heatmap"] = Query(lambda s, d: charts.liquidity_heatmap(hourly(s, d)), "contract_id slot value", "", "SELECT contract_id, slot, CAST(value AS BIGINT) AS value FROM (SELECT contract_id, ts, sum(volume) AS value, dense_rank() OVER (ORDER BY ts) - 1 AS slot FROM hr GROUP BY 1, 2) WHERE slot < 48")
Q["v_category_totals"] = Query(lambda s, d: charts.category_totals(hourly(s, d)), "category total", "", "SELECT category, CAST(sum(volume) AS BIGINT) AS total FROM hr GROUP BY 1")
Q["v_stacked_series"] = Query(lambda s, d: charts.stacked_series(hourly(s, d)), "period category value", "", "SELECT p.period, c.category, CAST(coalesce(v.value, 0) AS BIGINT) AS value FROM (SELECT DISTINCT date_trunc('day', ts) AS period FROM hr) p CROSS JOIN (SELECT DISTINCT category FROM hr) c LEFT JOIN (SELECT date_trunc('day', ts) AS period, category, sum(volume) AS value FROM hr GROUP BY 1, 2) v ON v.period = p.period AND v.category = c.category")
Q["v_series"] = Query(lambda s, d: charts.series(features.spreads(hourly(s, d)), "U7", ["price_c", "volume", "spread"]), "ts volume", "price_c spread", "SELECT * FROM f WHERE contract_id = 'U7'")
Q["v_spread_evolution"] = Query(lambda s, d: charts.spread_evolution(features.spreads(hourly(s, d))), _F, "spread_ma spread_pct_ma", "SELECT contract_id, ts, CASE WHEN count(spread) OVER w >= 20 THEN avg(spread) OVER w END AS spread_ma, CASE WHEN count(spread_pct) OVER w >= 20 THEN avg(spread_pct) OVER w END * 100 AS spread_pct_ma FROM f WINDOW w AS (PARTITION BY contract_id ORDER BY ts ROWS 19 PRECEDING)")
Q["v_spread_tightening"] = Query(lambda s, d: charts.spread_tightening(table(s, d), 20), "category lifecycle_bin n", "median q25 q75", S.bands("spread", "CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0.5 END"))
Q["v_liquidity_trajectory"] = Query(lambda s, d: charts.liquidity_trajectory(table(s, d), "volume", 20), "category lifecycle_bin n", "median q25 q75", S.bands("volume", "CASE WHEN stddev_samp(v) OVER w > 0 THEN (v - avg(v) OVER w) / stddev_samp(v) OVER w ELSE 0 END"))
Q["v_volatility_bursts"] = Query(lambda s, d: charts.volatility_bursts(table(s, d), 20), "category lifecycle_bin", "intensity frequency", S.BURSTS)
Q["v_regime_occupancy"] = Query(lambda s, d: charts.regime_occupancy(table(s, d)), "category microstructure_state", "percent", "SELECT category, state AS microstructure_state, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY category) AS percent FROM st GROUP BY 1, 2")
Q["v_category_fingerprint"] = Query(lambda s, d: charts.category_fingerprint(table(s, d)), "category metric", "value", S.FINGERPRINT)
Q["y_states_over_lifecycle"] = Query(lambda s, d: charts.states_over_lifecycle(table(s, d), 20, ("category",)), "category lifecycle_bin microstructure_state n", "share", "SELECT category, lb20 AS lifecycle_bin, state AS microstructure_state, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY category, lb20) AS share FROM st GROUP BY 1, 2, 3")
Q["y_entropy_distribution"] = Query(lambda s, d: charts.entropy_distribution(table(s, d)), "category entropy_bin n_contracts", "median_entropy", S.ENTROPY_BINS)
Q["y_category_transitions"] = Query(lambda s, d: charts.category_transitions(table(s, d)), "category from_state to_state n", "probability", S.CATEGORY_TRANSITIONS)
Q["y_median_durations"] = Query(lambda s, d: charts.median_durations(hourly(s, d)), "category n_contracts", "median_duration_hours", "SELECT category, count(*) AS n_contracts, quantile_cont(h, 0.5) AS median_duration_hours FROM (SELECT category, contract_id, (epoch(max(ts)) - epoch(min(ts))) / 3600 AS h FROM hr GROUP BY 1, 2) GROUP BY 1")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.oracle() for k, q in Q.items() if q.sql is not None}
