"""DuckDB SQL of the registered queries: shared tables first, then one text for each query."""

from __future__ import annotations

from barloom.config import Regimes
from barloom.sources.bars import ALIASES, BARS_SQL, CANONICAL, STATUSES

W = "PARTITION BY contract_id ORDER BY ts"
P = "PARTITION BY contract_id"
QUOTES = ["yes_bid_c", "yes_bid_h", "yes_bid_l", "yes_ask_c", "yes_ask_h", "yes_ask_l"]
PRICES = ["price_c", "price_h", "price_l"]


def rolling(agg: str, x: str, k: int, least: int = 1, order: str = W) -> str:
    over = f"OVER ({order} ROWS {k - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {agg}({x}) {over} END"


def state(s: Regimes) -> str:
    """The state of a row with r, v, pct, ratio, sigma, vbar, vstd, vq, sq, gq."""
    return (
        f"CASE WHEN coalesce(v = 0, false) OR coalesce(v < {s.frozen_volume} * vbar, false) OR coalesce(r = 0, false) THEN 1 "
        f"WHEN abs(r) > {s.burst_k} * sigma AND v > {s.burst_volume} * vbar THEN 5 "
        f"WHEN ratio > {s.drift_ratio} AND pct < greatest(sq, {s.drift_spread}) AND v < vq AND sigma < gq THEN 6 "
        f"WHEN CASE WHEN vstd > 0 THEN (v - vbar) / vstd ELSE 0 END > {s.active_zscore} THEN 4 WHEN pct > {s.thin_spread} THEN 2 ELSE 3 END"
    )


def state_input(source: str, window: int, extra: str = "") -> str:
    """``source`` with pct_return, volume, spread_pct and lifecycle_ratio, plus what ``state`` compares."""
    s = Regimes()
    return f"""SELECT *, quantile_cont(sigma, {s.drift_volatility_quantile}) OVER ({P}) AS gq FROM (
      SELECT contract_id, category, ts, pct_return AS r, CAST(volume AS DOUBLE) AS v, spread_pct AS pct, lifecycle_ratio AS ratio{extra},
        {rolling("avg", "abs(pct_return)", window, 3)} AS sigma, avg(CAST(volume AS DOUBLE)) OVER ({W} ROWS {window - 1} PRECEDING) AS vbar,
        stddev_samp(CAST(volume AS DOUBLE)) OVER ({W} ROWS {window - 1} PRECEDING) AS vstd,
        quantile_cont(CAST(volume AS DOUBLE), {s.drift_volume_quantile}) OVER ({P}) AS vq, quantile_cont(spread_pct, {s.drift_spread_quantile}) OVER ({P}) AS sq
      FROM {source})"""


_LAST = lambda c: f"last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)"
_CLAMP = lambda c: f"CASE WHEN {c} IS NOT NULL THEN least(99.0, greatest(1.0, {c})) END"
_EDGE = lambda c: f"arg_max({c}, ts) FILTER (WHERE {c} IS NOT NULL) AS {c}"

TABLES = {
    "bars": BARS_SQL.strip(),
    "ff": f"SELECT contract_id, category, ts, event_id, volume, trade_count, {', '.join(f'{_LAST(c)} AS {c}' for c in PRICES + QUOTES)} FROM bars",
    "cl": f"SELECT * FROM (SELECT contract_id, category, ts, event_id, volume, trade_count, {', '.join(f'{_CLAMP(c)} AS {c}' for c in PRICES)}, {', '.join(QUOTES)}, count(*) OVER ({P}) AS n_rows FROM ff) WHERE n_rows >= 50",
    "b1": f"""SELECT contract_id, date_trunc('hour', ts) AS h, min(category) AS category, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count,
      {_EDGE("price_c")}, {_EDGE("yes_bid_c")}, {_EDGE("yes_ask_c")}, max(price_h) AS price_h, min(price_l) AS price_l, max(yes_bid_h) AS yes_bid_h, min(yes_bid_l) AS yes_bid_l,
      max(yes_ask_h) AS yes_ask_h, min(yes_ask_l) AS yes_ask_l FROM cl GROUP BY 1, 2""",
    "g": "SELECT contract_id, min(category) AS category, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS ts FROM b1 GROUP BY 1",
    "j": f"SELECT g.contract_id, g.category, g.ts, coalesce(volume, 0) AS volume, coalesce(trade_count, 0) AS trade_count, {', '.join(PRICES + QUOTES)} FROM g LEFT JOIN b1 ON b1.contract_id = g.contract_id AND b1.h = g.ts",
    "hr": f"SELECT contract_id, category, ts, volume, trade_count, {', '.join(f'{_LAST(c)} AS {c}' for c in PRICES + QUOTES)} FROM j",
    "f1": f"""SELECT *, lag(price_c) OVER ({W}) AS p0, yes_ask_c - yes_bid_c AS spread, (yes_ask_c + yes_bid_c) / 2 AS midpoint,
      CAST(volume AS DOUBLE) AS v, (epoch(ts) - epoch(min(ts) OVER ({P}))) / 3600 AS tsl_hours, (epoch(max(ts) OVER ({P})) - epoch(ts)) / 3600 AS tts_hours FROM hr""",
    "f2": f"""SELECT *, price_c / p0 - 1 AS pct_return, abs(price_c / p0 - 1) AS abs_return, ln(price_c / p0) AS log_return,
      CASE WHEN price_c IS NOT NULL AND p0 IS NOT NULL THEN ln(least(greatest(price_c / 100, 0.001), 0.999) / (1 - least(greatest(price_c / 100, 0.001), 0.999))) - ln(least(greatest(p0 / 100, 0.001), 0.999) / (1 - least(greatest(p0 / 100, 0.001), 0.999))) END AS logit_return,
      CASE WHEN midpoint > 0 THEN spread / midpoint END AS spread_pct, spread - lag(spread) OVER ({W}) AS spread_tightening,
      CASE WHEN tsl_hours + tts_hours > 0 THEN least(greatest(tsl_hours / (tsl_hours + tts_hours), 0.0), 1.0) ELSE 0.0 END AS lifecycle_ratio FROM f1""",
    "f": f"""SELECT *, {rolling("stddev_samp", "pct_return", 5, 3)} AS volatility_short, {rolling("stddev_samp", "pct_return", 15, 3)} AS volatility_medium, {rolling("stddev_samp", "pct_return", 60, 3)} AS volatility_long,
      {rolling("stddev_samp", "pct_return", 5, 3)} * sqrt(525600.0) AS volatility_short_ann, pct_return * pct_return AS realized_variance, price_h - price_l AS price_range,
      {rolling("avg", "abs(pct_return)", 20, 3)} AS sigma, avg(v) OVER w20 AS volume_ma, stddev_samp(v) OVER w20 AS volume_std, CASE WHEN stddev_samp(v) OVER w20 > 0 THEN (v - avg(v) OVER w20) / stddev_samp(v) OVER w20 ELSE 0 END AS volume_zscore,
      CAST(sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_volume, CASE WHEN avg(v) OVER w20 <> 0 THEN v / avg(v) OVER w20 END AS volume_surge, ln(1 + v) AS log_volume,
      CASE WHEN trade_count > 0 THEN v / trade_count END AS avg_trade_size, spread_pct * 10000 AS spread_bps, avg(spread) OVER w20 AS spread_ma, 2 * abs(price_c - midpoint) AS effective_spread,
      yes_bid_h - yes_bid_l AS bid_range, yes_ask_h - yes_ask_l AS ask_range, (yes_bid_h - yes_bid_l + yes_ask_h - yes_ask_l) / 2 AS book_thinning,
      CASE WHEN count(spread_tightening) OVER w10 >= 10 THEN count(*) FILTER (WHERE spread_tightening < 0) OVER w10 / 10 END AS depth_resilience,
      CASE WHEN count(spread_tightening) OVER w10 >= 10 THEN count(*) FILTER (WHERE spread_tightening < 0) OVER w10 / nullif(count(*) FILTER (WHERE spread_tightening <> 0) OVER w10, 0) END AS depth_balance,
      CASE WHEN lifecycle_ratio <= 0.05 THEN 'early' WHEN lifecycle_ratio <= 0.2 THEN 'ramp_up' WHEN lifecycle_ratio <= 0.8 THEN 'middle' WHEN lifecycle_ratio <= 0.95 THEN 'late' ELSE 'resolution' END AS lifecycle_phase,
      CAST(greatest(0, least(19, (SELECT count(*) FILTER (WHERE lifecycle_ratio > k / 20.0) FROM range(1, 20) AS t(k)))) AS INT) AS lb20
      FROM f2 WINDOW w20 AS ({W} ROWS 19 PRECEDING), w10 AS ({W} ROWS 9 PRECEDING)""",
    "st": f"SELECT *, {state(Regimes())} AS state FROM ({state_input('f', 20, ', lb20, spread')})",
    "mid": f"SELECT contract_id, make_timestamp(CAST(floor((epoch(min(ts)) + epoch(max(ts))) / 2 / 3600) * 3600 AS BIGINT) * 1000000) AS event_time FROM hr GROUP BY 1",
    "ev": "SELECT hr.*, event_time, (epoch(event_time) - epoch(ts)) / 60 AS minutes_to_event FROM hr JOIN mid USING (contract_id)",
}


def with_needed(sql: str) -> str:
    """The shared tables that a text uses, directly or by others."""
    import re

    need, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\b(?:FROM|JOIN|,)\s+([a-z][a-z0-9]*)\b", todo.pop()))
        for t in words & set(TABLES) - need:
            need.add(t)
            todo.append(TABLES[t])
    parts = [f"{t} AS ({TABLES[t]})" for t in TABLES if t in need]
    return "WITH " + ", ".join(parts) if parts else ""


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda p: upper(p[1:1]) || lower(p[2:])), '')"


_ALIAS = " ".join(f"WHEN lower(trim(raw)) IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in ALIASES.items())
IDENTITY = f"""SELECT raw, CASE WHEN raw IN ({', '.join(repr(c) for c in CANONICAL)}) THEN raw {_ALIAS} ELSE {_title('raw')} END AS category,
  regexp_full_match(raw, '[a-zA-Z0-9_\\-]+') AS valid_id, CASE WHEN lower(trim(raw)) IN ({', '.join(repr(x) for x in STATUSES)}) THEN upper(trim(raw)) ELSE 'UNKNOWN' END AS status
  FROM (VALUES ('nfl'), (' Politics'), ('Sports'), ('some-other cat'), ('BTC'), ('climate')) AS v(raw)"""
FREQUENCY = f"""SELECT contract_id, CASE WHEN m IS NULL THEN 'MINUTE' WHEN m <= 1.5 THEN 'SECOND' WHEN m <= 90 THEN 'MINUTE' WHEN m <= 5400 THEN 'HOUR' ELSE 'DAY' END AS frequency
  FROM (SELECT contract_id, quantile_cont(d, 0.5) AS m FROM (SELECT contract_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({W})) / 1e6 AS d FROM bars) GROUP BY 1)"""
_RANGES = lambda lo, hi: " UNION ALL ".join(f"SELECT contract_id, '{c}' AS field, count(*) FILTER (WHERE {c} < {lo}) AS below, count(*) FILTER (WHERE {c} > {hi}) AS above FROM bars GROUP BY 1" for c in PRICES)
VALIDATE_PRICES = f"SELECT * FROM ({_RANGES(5, 95)})"
VALIDATE = f"""SELECT i.contract_id, e.errors IS NULL AS is_valid, coalesce(e.errors, '') AS errors FROM (SELECT DISTINCT contract_id FROM bars) i LEFT JOIN (
  SELECT contract_id, string_agg(e, '; ' ORDER BY e) AS errors FROM (
    SELECT contract_id, field || ' below range: ' || below AS e FROM ({_RANGES(1, 99)}) WHERE below > 0
    UNION ALL SELECT contract_id, field || ' above range: ' || above FROM ({_RANGES(1, 99)}) WHERE above > 0
    UNION ALL SELECT contract_id, 'wide spreads: ' || count(*) FROM bars WHERE CASE WHEN yes_bid_c = 0 THEN yes_ask_c > 0 ELSE (yes_ask_c - yes_bid_c) / yes_bid_c > 0.5 END GROUP BY 1) GROUP BY 1) e ON e.contract_id = i.contract_id"""
LINEAR = f"""SELECT contract_id, ts, CASE WHEN a IS NULL THEN NULL WHEN b IS NULL OR a.n = b.n THEN a.p ELSE a.p + (b.p - a.p) * (n - a.n) / (b.n - a.n) END AS price_c FROM (
  SELECT *, last_value(x IGNORE NULLS) OVER (ORDER BY contract_id, n ROWS UNBOUNDED PRECEDING) AS a0, last_value(x IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS a,
    first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM (SELECT contract_id, ts, n, CASE WHEN price_c IS NOT NULL THEN {{'n': n, 'p': price_c}} END AS x FROM (SELECT *, row_number() OVER ({W}) AS n FROM bars)))"""
STATS = f"""SELECT b.contract_id, b.n AS original_rows, a.n AS final_rows, b.n - a.n AS rows_removed, (b.n - a.n) * 100.0 / b.n AS removal_pct, CAST(b.nulls - a.nulls AS BIGINT) AS nulls_imputed,
  CAST(0 AS BIGINT) AS outliers_winsorized, CAST(a.fixed AS BIGINT) AS invalid_prices_fixed
  FROM (SELECT contract_id, count(*) AS n, sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in PRICES)}) AS nulls FROM bars GROUP BY 1) b
  JOIN (SELECT contract_id, count(*) AS n, sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in PRICES)}) AS nulls, sum({' + '.join(f'CAST(coalesce({c} < 1 OR {c} > 99, false) AS INT)' for c in PRICES)}) AS fixed FROM ff GROUP BY 1) a ON a.contract_id = b.contract_id"""
PARKINSON = f"SELECT contract_id, ts, sqrt(CASE WHEN count(x) OVER w >= 20 THEN avg(x) OVER w END / (4 * ln(2))) AS parkinson_volatility FROM (SELECT *, CASE WHEN price_l <> 0 AND price_h / price_l > 0 THEN pow(ln(price_h / price_l), 2) END AS x FROM hr) WINDOW w AS ({W} ROWS 19 PRECEDING)"
IMPACT = f"""SELECT contract_id, ts, CASE WHEN n >= 60 AND sv * ss <> 0 THEN c / (sv * ss) END AS volume_spread_corr, CASE WHEN lag(big) OVER ({W}) THEN spread END AS post_large_spread FROM (
  SELECT *, count(spread) OVER w AS n, covar_samp(v, spread) OVER w AS c, stddev_samp(v) OVER w AS sv, stddev_samp(spread) OVER w AS ss, v > 2 * volume_ma AS big FROM f WINDOW w AS ({W} ROWS 59 PRECEDING))"""
_REGIME = "CASE WHEN minutes_to_event > 0 AND minutes_to_event <= 1440 THEN 2 WHEN minutes_to_event <= 0 AND minutes_to_event > -180 THEN 3 WHEN minutes_to_event <= -180 THEN 5 ELSE 7 END"
CALENDAR = f"""SELECT contract_id, ts, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(hour(ts) >= 9 AND hour(ts) < 16 AS INT) AS is_market_hours,
  hour(ts) = 9 AND minute(ts) < 5 AS session_start, hour(ts) = 15 AND minute(ts) >= 55 AS session_end, {_REGIME} AS regime, minutes_to_event FROM ev"""
SETTLEMENT = f"""SELECT contract_id, ts, tsl AS tsl_hours, tts AS tts_hours, ratio AS lifecycle_ratio,
  CASE WHEN ratio <= 0.05 THEN 'early' WHEN ratio <= 0.2 THEN 'ramp_up' WHEN ratio <= 0.8 THEN 'middle' WHEN ratio <= 0.95 THEN 'late' ELSE 'resolution' END AS lifecycle_phase FROM (
  SELECT *, CASE WHEN tot > 0 THEN least(greatest(tsl / tot, 0.0), 1.0) ELSE 0.0 END AS ratio FROM (
    SELECT contract_id, ts, (epoch(ts) - epoch(min(ts) OVER ({P}))) / 3600 AS tsl, (epoch(event_time) - epoch(ts)) / 3600 AS tts, (epoch(event_time) - epoch(min(ts) OVER ({P}))) / 3600 AS tot FROM ev)) WHERE tts >= 0"""
NONLINEAR = """SELECT contract_id, ts, CASE lifecycle_phase WHEN 'early' THEN 0 WHEN 'ramp_up' THEN 1 WHEN 'middle' THEN 2 WHEN 'late' THEN 3 ELSE 4 END AS lifecycle_bin,
  CASE lifecycle_phase WHEN 'early' THEN 0.025 WHEN 'ramp_up' THEN 0.125 WHEN 'middle' THEN 0.5 WHEN 'late' THEN 0.875 ELSE 0.975 END AS lifecycle_bin_center FROM f"""
EVENT_BINS = "SELECT contract_id, ts, minutes_to_event, k AS event_bin, -240 + (k + 0.5) * 60 AS event_bin_minutes FROM (SELECT *, greatest(0, least(27, CAST(ceil((least(greatest(minutes_to_event, -240), 1440) + 240) / 60) - 1 AS INT))) AS k FROM ev)"
BY_BINS = """SELECT contract_id, lb20 AS lifecycle_bin, avg(spread) AS spread_mean, quantile_cont(spread, 0.5) AS spread_median, stddev_samp(spread) AS spread_std, arg_min(spread, ts) AS spread_first, arg_max(spread, ts) AS spread_last,
  CAST(sum(volume) AS BIGINT) AS volume_sum, max(volume) AS volume_max, count(volume) AS volume_count FROM f GROUP BY 1, 2"""
_PS = (10, 25, 50, 75, 90)
TRAJECTORY = f"""SELECT category, lifecycle_bin, count, center, {', '.join(f'quantile_cont(q{p}, 0.5) OVER w AS p{p}' for p in _PS)} FROM (
  SELECT category, lb20 AS lifecycle_bin, count(spread) AS count, lb20 / 20.0 + 0.025 AS center, {', '.join(f'quantile_cont(spread, {p / 100}) AS q{p}' for p in _PS)} FROM f GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY category ORDER BY lifecycle_bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""
_NAMES = "CASE state WHEN 1 THEN 'frozen' WHEN 2 THEN 'thin' WHEN 3 THEN 'normal' WHEN 4 THEN 'active_info' WHEN 5 THEN 'volatility_burst' ELSE 'resolution_drift' END"
STATES = f"SELECT contract_id, ts, state AS microstructure_state, {_NAMES} AS microstructure_state_name, CASE WHEN lag(state) OVER ({W}) IS NULL OR lag(state) OVER ({W}) <> state THEN 1 ELSE 0 END AS regime_transition FROM st"
_PAIRS = f"(SELECT category, state AS from_state, lead(state) OVER ({W}) AS to_state FROM st)"
TRANSITIONS = f"SELECT from_state, to_state, count(*) AS n FROM {_PAIRS} WHERE to_state IS NOT NULL GROUP BY 1, 2"
CATEGORY_TRANSITIONS = f"SELECT category, from_state, to_state, n, n / sum(n) OVER (PARTITION BY category, from_state) AS probability FROM (SELECT category, from_state, to_state, count(*) AS n FROM {_PAIRS} WHERE to_state IS NOT NULL GROUP BY 1, 2, 3)"
MATRIX = f"SELECT from_state, {', '.join(f'coalesce(count(*) FILTER (WHERE to_state = {c}) / nullif(count(to_state), 0), 0) AS to_{c}' for c in range(1, 7))} FROM {_PAIRS} GROUP BY 1"
_SHARES = "SELECT category, contract_id, state, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY contract_id) AS share FROM st GROUP BY 1, 2, 3"
_ENTROPY = f"SELECT category, contract_id, count(*) AS n_states, CASE WHEN count(*) > 1 THEN -sum(share * log2(share)) / log2(count(*)) ELSE 0 END AS regime_entropy, arg_max(state, n * 10 - state) AS dominant_regime FROM ({_SHARES}) GROUP BY 1, 2"
ENTROPY = f"SELECT * FROM ({_ENTROPY})"
ENTROPY_BINS = f"SELECT category, CAST(least(9, floor(regime_entropy * 10)) AS INT) AS entropy_bin, count(*) AS n_contracts, quantile_cont(regime_entropy, 0.5) AS median_entropy FROM ({_ENTROPY}) GROUP BY 1, 2"
_RAW = f"""(SELECT contract_id, category, ts, volume, coalesce(p / lag(p) OVER ({W}) - 1, 0) AS pct_return, CASE WHEN spread / nullif(mid, 0) IS NOT NULL THEN least(greatest(spread / nullif(mid, 0), 0.0), 1.0) END AS spread_pct,
  coalesce((epoch_us(ts) - min(epoch_us(ts)) OVER ({P})) / nullif(max(epoch_us(ts)) OVER ({P}) - min(epoch_us(ts)) OVER ({P}), 0), 0.5) AS lifecycle_ratio
  FROM (SELECT contract_id, category, ts, coalesce(volume, 0) AS volume, greatest(yes_ask_c - yes_bid_c, 0) AS spread, (yes_ask_c + yes_bid_c) / 2 AS mid, {_LAST("price_c")} AS p FROM bars))"""


def robustness(specs: dict[str, dict]) -> str:
    parts = []
    for name, change in specs.items():
        s = Regimes(**change)
        pct = ", ".join(f"count(*) FILTER (WHERE state = {c}) * 100.0 / count(*) AS pct_{c}" for c in range(1, 7))
        parts.append(f"SELECT '{name}' AS spec, contract_id, count(*) AS n, {pct} FROM (SELECT *, {state(s)} AS state FROM ({state_input(_RAW, s.window)})) GROUP BY 2")
    return " UNION ALL ".join(parts)


def surge(x: str, kind: str) -> str:
    return f"""SELECT contract_id, ts, '{kind}' AS type, (x - m) / s AS magnitude, m AS baseline FROM (
      SELECT contract_id, ts, CAST({x} AS DOUBLE) AS x, {rolling("avg", f"CAST({x} AS DOUBLE)", 30, 5)} AS m, nullif({rolling("stddev_samp", f"CAST({x} AS DOUBLE)", 30, 5)}, 0) AS s FROM f) WHERE (x - m) / s > 2"""


INTENSITY = f"""SELECT contract_id, CASE WHEN n < 10 THEN NULL ELSE coalesce(avg((x - m) / nullif(s, 0)) FILTER (WHERE x > m + 2 * s), 0) END AS burst_intensity FROM (
  SELECT contract_id, volatility_short AS x, avg(volatility_short) OVER ({P}) AS m, stddev_samp(volatility_short) OVER ({P}) AS s, count(volatility_short) OVER ({P}) AS n FROM f) GROUP BY contract_id, n"""
SLOPE_LOG = f"""SELECT contract_id, CASE WHEN max(n) >= 10 AND var_pop(lifecycle_ratio) > 0 THEN regr_slope(ln(spread), lifecycle_ratio) END AS spread_collapse_log FROM (
  SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER ({P}) AS n FROM f WHERE spread > 0)
  WHERE n <= 200 OR list_contains(list_transform(range(0, 200), lambda k: CAST(k * (n - 1) // 199 AS BIGINT)), i) GROUP BY 1"""
_SLOPE_ALL = "SELECT contract_id, CASE WHEN count(*) >= 10 AND var_pop(lifecycle_ratio) > 0 THEN regr_slope(ln(spread), lifecycle_ratio) END AS spread_collapse_log FROM f WHERE spread > 0 GROUP BY 1"
CURVE = """SELECT q.contract_id, q.bin, m AS spread_mean, s AS spread_std, a AS spread_min, b AS spread_max, c AS spread_first, d AS spread_last, c - d AS tightening, CASE WHEN c > 0 THEN (c - d) / c END AS tightening_pct FROM (
  SELECT contract_id, unnest(generate_series(min(bin), max(bin), INTERVAL 4 HOUR)) AS bin FROM (SELECT contract_id, make_timestamp(CAST(epoch(ts) AS BIGINT) // 14400 * 14400 * 1000000) AS bin FROM f) GROUP BY 1) q
  LEFT JOIN (SELECT contract_id, make_timestamp(CAST(epoch(ts) AS BIGINT) // 14400 * 14400 * 1000000) AS bin, avg(spread) AS m, stddev_samp(spread) AS s, min(spread) AS a, max(spread) AS b, arg_min(spread, ts) AS c, arg_max(spread, ts) AS d FROM f GROUP BY 1, 2) x
  ON x.contract_id = q.contract_id AND x.bin = q.bin"""
BY_REGIME = f"SELECT contract_id, regime, avg(spread) AS mean, stddev_samp(spread) AS std, quantile_cont(spread, 0.5) AS median, count(spread) AS count FROM (SELECT contract_id, yes_ask_c - yes_bid_c AS spread, {_REGIME} AS regime FROM ev) GROUP BY 1, 2"
_SHOCKS = f"""SELECT contract_id, k AS shocks, CASE WHEN n >= 20 THEN med END AS median_recovery, CASE WHEN n >= 20 THEN avg_r END AS mean_recovery, CASE WHEN n >= 20 THEN CASE WHEN k = 0 THEN 1 ELSE r / k END END AS recovery_rate FROM (
  SELECT contract_id, max(n) AS n, count(*) FILTER (WHERE start) AS k, count(took) AS r, quantile_cont(took, 0.5) AS med, avg(took) AS avg_r FROM (
    SELECT *, CASE WHEN start THEN (back - t) / 60.0 END AS took FROM (
      SELECT contract_id, t, n, spread > hi AND NOT coalesce(lag(spread > hi) OVER (PARTITION BY contract_id ORDER BY t), false) AS start,
        min(CASE WHEN spread <= med THEN t END) OVER (PARTITION BY contract_id ORDER BY t RANGE BETWEEN CURRENT ROW AND %d FOLLOWING) AS back
      FROM (SELECT contract_id, CAST(epoch(ts) AS BIGINT) AS t, spread, quantile_cont(spread, 0.95) OVER ({P}) AS hi, quantile_cont(spread, 0.5) OVER ({P}) AS med, count(*) OVER ({P}) AS n FROM f))) GROUP BY 1)"""
SHOCKS = _SHOCKS % (360 * 60)
ANALYSIS = f"""SELECT b.*, coalesce(s1.n, 0) AS volume_surge_count, coalesce(s2.n, 0) AS volatility_surge_count, coalesce(s1.n, 0) + coalesce(s2.n, 0) AS surge_count, sl.spread_collapse_log, sh.shocks, sh.median_recovery, sh.mean_recovery, sh.recovery_rate FROM (
  SELECT contract_id, avg(spread) AS avg_spread, avg(spread_pct) AS avg_spread_pct, avg(volume) AS avg_volume, avg(volatility_short) AS volatility, avg(depth_balance) AS depth_resilience, {', '.join(f'quantile_cont(spread, {p / 100}) AS spread_p{p}' for p in (10, 25, 50, 75, 90))} FROM f GROUP BY 1) b
  LEFT JOIN (SELECT contract_id, count(*) AS n FROM ({surge("volume", "volume")}) GROUP BY 1) s1 ON s1.contract_id = b.contract_id
  LEFT JOIN (SELECT contract_id, count(*) AS n FROM ({surge("abs_return", "volatility")}) GROUP BY 1) s2 ON s2.contract_id = b.contract_id
  LEFT JOIN ({_SLOPE_ALL}) sl ON sl.contract_id = b.contract_id LEFT JOIN ({_SHOCKS % 1800}) sh ON sh.contract_id = b.contract_id"""
ALIGN = f"""SELECT contract_id, category, metric, CAST(x AS BIGINT) AS grid_min, y AS value, n FROM (
  SELECT *, count(y) OVER (PARTITION BY contract_id, metric) AS n FROM (
    SELECT contract_id, category, minutes_to_event AS x, 'spread' AS metric, yes_ask_c - yes_bid_c AS y FROM ev UNION ALL SELECT contract_id, category, minutes_to_event, 'volume', CAST(volume AS DOUBLE) FROM ev) WHERE y IS NOT NULL)
  WHERE n >= 3 AND x BETWEEN -1440 AND 1440"""
ALIGN_SPARSE = """WITH e AS (SELECT contract_id, CAST(floor((CAST(epoch(min(ts)) AS BIGINT) + CAST(epoch(max(ts)) AS BIGINT)) / 2 / 3600) AS BIGINT) * 3600000000 AS e FROM (SELECT contract_id, date_trunc('second', ts) AS ts FROM cl) GROUP BY 1),
  pt AS (SELECT contract_id, category, metric, (e - us) / 6e7 AS x, y FROM (
    SELECT contract_id, category, epoch_us(ts) AS us, 'price_c' AS metric, price_c AS y FROM cl UNION ALL SELECT contract_id, category, epoch_us(ts), 'volume', CAST(volume AS DOUBLE) FROM cl) JOIN e USING (contract_id) WHERE y IS NOT NULL),
  n AS (SELECT contract_id, category, metric, count(*) AS n, min(x) AS lo, max(x) AS hi FROM pt GROUP BY 1, 2, 3),
  gr AS (SELECT contract_id, category, metric, n, CAST(unnest(range(-24, 25)) * 60 AS DOUBLE) AS pos, lo, hi FROM n WHERE n >= 3),
  a AS (SELECT gr.*, p.x AS ax, p.y AS ay FROM gr ASOF JOIN pt p ON p.contract_id = gr.contract_id AND p.metric = gr.metric AND gr.pos >= p.x),
  b AS (SELECT a.*, p.x AS bx, p.y AS by_ FROM a ASOF JOIN pt p ON p.contract_id = a.contract_id AND p.metric = a.metric AND a.pos <= p.x)
  SELECT contract_id, category, metric, CAST(pos AS BIGINT) AS grid_min, n, CASE WHEN ax = pos THEN ay ELSE ay + (by_ - ay) * (pos - ax) / (bx - ax) END AS value FROM b
  WHERE NOT (ax < pos AND bx > pos AND bx - ax > 600)"""


def weighted(category: str, aligned: str | None = None) -> str:
    aligned = aligned or ALIGN
    q = ", ".join(f"coalesce(arg_min(value, cw) FILTER (WHERE cw >= {p} - 1e-12), max(value)) AS {name}" for p, name in ((0.5, "median"), (0.1, "p10"), (0.25, "p25"), (0.75, "p75"), (0.9, "p90")))
    return f"""SELECT metric, category, grid_min, count(*) AS count, {q}, sum(n * value) / sum(n) AS mean, stddev_pop(value) AS std FROM (
      SELECT metric, category, grid_min, n, value, sum(n) OVER (PARTITION BY metric, category, grid_min ORDER BY value, contract_id ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY metric, category, grid_min) AS cw
      FROM (SELECT contract_id, metric, {category} AS category, grid_min, n, value FROM ({aligned}))) GROUP BY 1, 2, 3"""


_SIGNATURES = ("midpoint", "spread", "spread_pct", "volatility_short", "volume_zscore", "depth_resilience")
_POINTS = " UNION ALL ".join(f"SELECT f.contract_id, f.category, (epoch(event_time) - epoch(ts)) / 60 AS x, '{m}' AS metric, CAST({m} AS DOUBLE) AS y FROM f JOIN mid ON mid.contract_id = f.contract_id" for m in _SIGNATURES)
_SIGNED = f"""SELECT contract_id, category, metric, CAST(x AS BIGINT) AS grid_min, y AS value, n FROM (
  SELECT *, count(y) OVER (PARTITION BY contract_id, metric) AS n FROM ({_POINTS}) WHERE y IS NOT NULL) WHERE n >= 3 AND x BETWEEN -1440 AND 1440"""
_SCALED = f"""SELECT contract_id, category, metric, grid_min, n, CASE WHEN count(*) OVER w < 2 THEN value WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END AS value
  FROM ({_SIGNED}) WINDOW w AS (PARTITION BY contract_id, metric)"""
SIGNATURES = f"{weighted(repr('overall'), _SCALED)} UNION ALL {weighted('category', _SCALED)}"
WINDOW = "SELECT contract_id, ts, CASE WHEN minutes_to_event > 0 THEN 'pre' ELSE 'post' END AS side FROM ev WHERE minutes_to_event BETWEEN -720 AND 1440"
MEDIAN = f"""SELECT x, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, stddev_samp(value) AS std, count(value) AS count FROM (
  SELECT x, price_c / nullif(CASE WHEN near IS NULL OR near = 0 THEN first ELSE near END, 0) AS value FROM (
    SELECT contract_id, -minutes_to_event AS x, price_c, first_value(price_c) OVER (PARTITION BY contract_id ORDER BY abs(minutes_to_event), ts) AS near, first_value(price_c) OVER ({W}) AS first FROM ev WHERE minutes_to_event BETWEEN -720 AND 1440)) GROUP BY 1"""
SIDES = """WITH r AS (SELECT contract_id, metric, pre, y FROM (
    SELECT contract_id, minutes_to_event > 0 AS pre, 'spread' AS metric, yes_ask_c - yes_bid_c AS y FROM ev WHERE abs(minutes_to_event) <= 1440
    UNION ALL SELECT contract_id, minutes_to_event > 0, 'volume', CAST(volume AS DOUBLE) FROM ev WHERE abs(minutes_to_event) <= 1440) WHERE y IS NOT NULL),
  s AS (SELECT contract_id, metric, count(*) FILTER (WHERE pre) AS n_pre, count(*) FILTER (WHERE NOT pre) AS n_post, avg(y) FILTER (WHERE pre) AS mean_pre, avg(y) FILTER (WHERE NOT pre) AS mean_post,
    stddev_samp(y) FILTER (WHERE pre) AS std_pre, stddev_samp(y) FILTER (WHERE NOT pre) AS std_post FROM r GROUP BY 1, 2),
  c AS (SELECT contract_id, metric, count(*) FILTER (WHERE pre) OVER w AS a, count(*) FILTER (WHERE NOT pre) OVER w AS b FROM r WINDOW w AS (PARTITION BY contract_id, metric ORDER BY y RANGE UNBOUNDED PRECEDING)),
  k AS (SELECT c.contract_id, c.metric, max(abs(a / n_pre - b / n_post)) AS ks_stat FROM c JOIN s ON s.contract_id = c.contract_id AND s.metric = c.metric GROUP BY 1, 2)
  SELECT s.*, ks_stat, (mean_post - mean_pre) / nullif(abs(mean_pre), 0) * 100 AS change_pct,
    (mean_pre - mean_post) / nullif(sqrt(((n_pre - 1) * pow(std_pre, 2) + (n_post - 1) * pow(std_post, 2)) / (n_pre + n_post - 2) * (1 / n_pre + 1 / n_post)), 0) AS t_stat
  FROM s JOIN k ON s.contract_id = k.contract_id AND s.metric = k.metric WHERE n_pre >= 3 AND n_post >= 3"""
SUMMARY = f"""SELECT b.*, fr.frequency FROM (SELECT contract_id, category, count(*) AS n_observations, min(ts) AS start_date, max(ts) AS end_date, CAST(sum(volume) AS BIGINT) AS total_volume, avg(price_c) AS mean_price FROM bars GROUP BY 1, 2) b
  JOIN ({FREQUENCY}) fr ON fr.contract_id = b.contract_id"""
_QUARTERS = ", ".join(
    f"quantile_cont({m}, 0.5) FILTER (WHERE lifecycle_ratio >= {k / 4} AND lifecycle_ratio < {(k + 1) / 4}) AS lifecycle_{n}_{m}" for k, n in enumerate(("early", "mid_early", "mid_late", "late")) for m in ("spread", "volume", "volatility_short")
)
METRICS = f"""SELECT b.*, sl.spread_collapse_slope, lr.liquidity_resilience, bi.burst_intensity, en.regime_entropy, en.dominant_regime, rp.* EXCLUDE (contract_id) FROM (
  SELECT contract_id, category, count(*) AS n_observations, (epoch(max(ts)) - epoch(min(ts))) / 3600 AS duration_hours, avg(spread) AS mean_spread, avg(spread_pct) AS mean_spread_pct, avg(volume) AS mean_volume,
    CAST(sum(volume) AS BIGINT) AS total_volume, avg(volatility_short) AS mean_volatility, max(volatility_short) AS max_volatility, avg(depth_resilience) AS mean_depth_resilience, {_QUARTERS} FROM f GROUP BY 1, 2) b
  JOIN (SELECT contract_id, {', '.join(f'count(*) FILTER (WHERE state = {c}) * 100.0 / count(*) AS regime_pct_{c}' for c in range(1, 7))} FROM st GROUP BY 1) rp ON rp.contract_id = b.contract_id
  LEFT JOIN (SELECT contract_id, CASE WHEN count(*) >= 10 THEN regr_slope(spread, lifecycle_ratio) END AS spread_collapse_slope FROM f WHERE spread IS NOT NULL GROUP BY 1) sl ON sl.contract_id = b.contract_id
  LEFT JOIN (SELECT contract_id, 1 - count(*) FILTER (WHERE CASE WHEN s > 0 THEN (volume - m) / s ELSE 0 END < -1) / count(*) AS liquidity_resilience FROM (
    SELECT contract_id, volume, avg(CAST(volume AS DOUBLE)) OVER ({P}) AS m, stddev_samp(volume) OVER ({P}) AS s FROM hr) GROUP BY 1) lr ON lr.contract_id = b.contract_id
  LEFT JOIN ({INTENSITY}) bi ON bi.contract_id = b.contract_id LEFT JOIN ({_ENTROPY}) en ON en.contract_id = b.contract_id"""
_STRICT = lambda c: f"CASE WHEN count({c}) = count(*) THEN avg({c}) END"
CATEGORY = f"""SELECT category, count(*) AS n_contracts, CAST(sum(n_observations) AS BIGINT) AS total_observations, {_STRICT("mean_spread")} AS avg_spread, {_STRICT("mean_spread_pct")} AS avg_spread_pct, {_STRICT("mean_volume")} AS avg_volume,
  {_STRICT("mean_volatility")} AS avg_volatility, avg(mean_depth_resilience) AS avg_depth_resilience, avg(spread_collapse_slope) AS avg_spread_collapse_slope, avg(liquidity_resilience) AS avg_liquidity_resilience,
  avg(burst_intensity) AS avg_burst_intensity, avg(regime_entropy) AS avg_regime_entropy, {', '.join(f'avg(regime_pct_{c}) AS regime_pct_{c}' for c in range(1, 7))} FROM ({METRICS}) GROUP BY 1"""
_LM = ("spread", "volume", "volatility_short", "depth_resilience")
_BIN = ", ".join(f"quantile_cont({m}, 0.5) AS {m}_median, avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std, quantile_cont({m}, 0.25) AS {m}_p25, quantile_cont({m}, 0.75) AS {m}_p75, count({m}) AS {m}_n" for m in _LM)
BINNED = f"""SELECT q.category, q.lifecycle_bin, q.lifecycle_bin / 20.0 + 0.025 AS lifecycle_ratio, x.* REPLACE (coalesce(spread_n, 0) AS spread_n, coalesce(volume_n, 0) AS volume_n) EXCLUDE (category, lifecycle_bin) FROM (
  SELECT DISTINCT category, b AS lifecycle_bin FROM f, range(0, 20) AS t(b)) q LEFT JOIN (
  SELECT category, lb20 AS lifecycle_bin, {_BIN} FROM (SELECT category, contract_id, lb20, {', '.join(f'quantile_cont({m}, 0.5) AS {m}' for m in _LM)} FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2) x ON x.category = q.category AND x.lifecycle_bin = q.lifecycle_bin"""
BINNED = BINNED.replace("x.* REPLACE (coalesce(spread_n, 0) AS spread_n, coalesce(volume_n, 0) AS volume_n) EXCLUDE (category, lifecycle_bin)", "x.* EXCLUDE (category, lifecycle_bin)")
FIGURE = f"SELECT lifecycle_bin, min(lifecycle_ratio) AS lifecycle_ratio, avg(spread_median) AS spread_median, avg(volume_p75) AS volume_p75, avg(volatility_short_p75) AS volatility_short_p75 FROM ({BINNED}) GROUP BY 1"
RUN_SUMMARY = f"""SELECT category, count(*) AS n_contracts, CAST(sum(coalesce(n, 0)) AS BIGINT) AS surge_count, avg(s) AS mean_spread, avg(v) AS mean_volume FROM (SELECT contract_id, category, avg(spread) AS s, avg(volume) AS v FROM f GROUP BY 1, 2) b
  LEFT JOIN (SELECT contract_id, count(*) AS n FROM ({surge("volume", "volume")}) GROUP BY 1) x ON x.contract_id = b.contract_id GROUP BY 1"""


def bands(metric: str, scaled: str) -> str:
    return f"""SELECT category, lifecycle_bin, count(s) AS n, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.25) AS q25, quantile_cont(s, 0.75) AS q75 FROM (
      SELECT category, lifecycle_bin, {scaled} AS s FROM (
        SELECT *, count(*) OVER ({P}) AS k FROM (SELECT category, contract_id, lb20 AS lifecycle_bin, quantile_cont({metric}, 0.5) AS v FROM f GROUP BY 1, 2, 3) WHERE v IS NOT NULL) WHERE k > 5 WINDOW w AS ({P})) GROUP BY 1, 2"""


BURSTS = f"""SELECT q.category, q.lifecycle_bin, coalesce(total / nullif(bursts, 0), 0) AS intensity, coalesce(bursts / n, 0) AS frequency FROM (SELECT DISTINCT category, b AS lifecycle_bin FROM f, range(0, 20) AS t(b)) q LEFT JOIN (
  SELECT category, lb20 AS lifecycle_bin, sum(x) FILTER (WHERE s > 0 AND x > m + 2 * s) AS total, count(*) FILTER (WHERE s > 0 AND x > m + 2 * s) AS bursts, count(*) AS n FROM (
    SELECT category, lb20, volatility_short AS x, avg(volatility_short) OVER ({P}) AS m, stddev_samp(volatility_short) OVER ({P}) AS s FROM f) GROUP BY 1, 2) y ON y.category = q.category AND y.lifecycle_bin = q.lifecycle_bin"""
_FM = ("spread", "volume", "volatility_short", "depth_resilience", "book_thinning")
FINGERPRINT = f"""SELECT category, metric, coalesce(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) WHEN v IS NOT NULL THEN 0.5 END, 0) AS value FROM (
  {' UNION ALL '.join(f"SELECT category, '{m}' AS metric, quantile_cont(x, 0.5) AS v FROM (SELECT category, contract_id, quantile_cont({m}, 0.5) AS x FROM f GROUP BY 1, 2) GROUP BY 1" for m in _FM)}) WINDOW w AS (PARTITION BY metric)"""
