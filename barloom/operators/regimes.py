"""Six trading states, their transitions and entropy, and sweeps over thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Regimes
from barloom.functions.common import by_time, flag, gate, quantile, rows, safe_div, so_far, ties, whole

NAMES = {1: "frozen", 2: "thin", 3: "normal", 4: "active_info", 5: "volatility_burst", 6: "resolution_drift", 7: "unknown"}
CODES = [1, 2, 3, 4, 5, 6]


def _windows(df: DataFrame, s: Regimes) -> DataFrame:
    """What the rules compare: rolling return and volume levels, and the contract's own quantiles."""
    have, more = set(df.columns), ties(df)
    out: dict[str, Column] = {}
    if "pct_return" in have:
        out["__sigma"] = gate(F.abs("pct_return"), F.avg, s.window, 3, more)
    if "volume" in have:
        v = F.col("volume").cast("double")
        out |= {"__vbar": F.avg(v).over(rows(s.window, more)), "__vstd": F.stddev_samp(v).over(rows(s.window, more)), "__vq": quantile(v, s.drift_volume_quantile).over(whole())}
    if "spread_pct" in have:
        out["__sq"] = quantile("spread_pct", s.drift_spread_quantile).over(whole())
    df = df.withColumns(out) if out else df
    return df.withColumn("__gq", quantile("__sigma", s.drift_volatility_quantile).over(whole())) if "__sigma" in df.columns else df


def _state(df: DataFrame, s: Regimes) -> Column:
    have = set(df.columns)
    c, v = F.col, F.col("volume").cast("double") if "volume" in have else None
    frozen = []
    if v is not None:
        frozen += [v == 0, v < s.frozen_volume * c("__vbar")]
    if "pct_return" in have and s.frozen_on_zero_return:
        frozen.append(c("pct_return") == 0)
    no = F.lit(False)
    frozen = reduce(lambda a, b: a | b, [flag(x) for x in frozen], no)
    burst = drift = active = thin = no
    if "pct_return" in have:
        burst = flag(F.abs("pct_return") > s.burst_k * c("__sigma"))
        if v is not None:
            burst = burst & flag(v > s.burst_volume * c("__vbar"))
    if "lifecycle_ratio" in have:
        drift = flag(c("lifecycle_ratio") > s.drift_ratio)
        if "spread_pct" in have:
            drift = drift & flag(c("spread_pct") < F.greatest(c("__sq"), F.lit(s.drift_spread)))
        if v is not None:
            drift = drift & flag(v < c("__vq"))
        if "pct_return" in have:
            drift = drift & flag(c("__sigma") < c("__gq"))
    if v is not None:
        z = F.when(c("__vstd") > 0, (v - c("__vbar")) / c("__vstd")).otherwise(0.0)
        active = flag(z > s.active_zscore)
    if "spread_pct" in have:
        thin = flag(c("spread_pct") > s.thin_spread)
    return F.when(frozen, 1).when(burst, 5).when(drift, 6).when(active, 4).when(thin, 2).otherwise(3)


def states(df: DataFrame, settings: Regimes | None = None) -> DataFrame:
    """microstructure_state, its name, and regime_transition (1 on each contract's first row)."""
    s = settings or Regimes()
    df = _windows(df, s)
    df = df.withColumn("microstructure_state", _state(df, s)).drop("__sigma", "__vbar", "__vstd", "__vq", "__sq", "__gq")
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    before = F.lag("microstructure_state").over(by_time(ties(df)))
    return df.withColumns({"microstructure_state_name": names[F.col("microstructure_state")], "regime_transition": F.when(before.isNull() | (before != F.col("microstructure_state")), 1).otherwise(0)})


def burst_mask(df: DataFrame, k: float = 2.5, m: float = 1.5, window: int = 20) -> DataFrame:
    """volatility_burst: large return and large volume (the return alone without a volume)."""
    big = flag(F.abs("pct_return") > k * gate(F.abs("pct_return"), F.avg, window, 3))
    if "volume" in df.columns:
        v = F.col("volume").cast("double")
        big = big & flag(v > m * F.avg(v).over(rows(window)))
    return df.withColumn("volatility_burst", big)


def transition_counts(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """from_state, to_state, n: neighbouring rows of one contract, pooled (within ``keys``)."""
    pairs = df.select(*keys, F.col("microstructure_state").alias("from_state"), F.lead("microstructure_state").over(by_time()).alias("to_state"))
    return pairs.filter("to_state is not null").groupBy(*keys, "from_state", "to_state").agg(F.count("*").alias("n"))


def transition_probabilities(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Long form: from_state, to_state, n, probability among the transitions out of from_state."""
    n = transition_counts(df, keys)
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "from_state")))


def transition_matrix(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each state that occurs, a column for each state; a state never left has zeros."""
    pairs = df.select(*keys, F.col("microstructure_state").alias("from_state"), F.lead("microstructure_state").over(by_time()).alias("to_state"))
    share = lambda c: F.coalesce(F.try_divide(F.count_if(F.col("to_state") == c), F.count("to_state")), F.lit(0.0))
    return pairs.groupBy(*keys, "from_state").agg(*[share(c).alias(f"to_{c}") for c in CODES])


def state_shares(df: DataFrame, keys: tuple[str, ...] = ("contract_id",)) -> DataFrame:
    """keys, microstructure_state, n, share."""
    n = df.groupBy(*keys, "microstructure_state").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(keys or (F.lit(0),)))))


def entropy(df: DataFrame, keys: tuple[str, ...] = ("contract_id",)) -> DataFrame:
    """regime_entropy over the states that occur, scaled to 0..1; n_states; dominant_regime (ties: lowest)."""
    s = state_shares(df, keys)
    h, n = -F.sum(F.col("share") * F.log2("share")), F.count("*")
    top = F.max_by("microstructure_state", F.struct("n", -F.col("microstructure_state")))
    return s.groupBy(*keys).agg(F.when(n > 1, h / F.log2(n.cast("double"))).otherwise(0.0).alias("regime_entropy"), n.alias("n_states"), top.alias("dominant_regime"))


def robustness_features(df: DataFrame) -> DataFrame:
    """Features for the sweep, on raw rows: spreads clipped, prices filled, first return 0. Rows of one time go by event id."""
    more = ties(df)
    df = df.filter("ts is not null").withColumns({"spread": F.greatest(F.col("yes_ask_c") - F.col("yes_bid_c"), F.lit(0.0)), "__mid": F.nullif((F.col("yes_ask_c") + F.col("yes_bid_c")) / 2, F.lit(0.0))})
    pct = F.try_divide("spread", "__mid")
    df = df.withColumns({"spread_pct": F.when(pct.isNotNull(), F.least(F.greatest(pct, F.lit(0.0)), F.lit(1.0))), "volume": F.coalesce("volume", F.lit(0)), "__p": F.last("price_c", ignorenulls=True).over(so_far(more))})
    df = df.withColumn("pct_return", F.coalesce(safe_div("__p", F.lag("__p").over(by_time(more))) - 1, F.lit(0.0)))
    a, b, t = F.unix_micros(F.min("ts").over(whole())), F.unix_micros(F.max("ts").over(whole())), F.unix_micros("ts")
    return df.withColumn("lifecycle_ratio", F.coalesce(F.try_divide(t - a, b - a), F.lit(0.5))).drop("__mid", "__p")


#: one threshold at a time
SPECS: dict[str, dict] = {
    "baseline": {}, "frozen_volume=0.05": {"frozen_volume": 0.05}, "frozen_volume=0.15": {"frozen_volume": 0.15}, "thin_spread=0.075": {"thin_spread": 0.075},
    "thin_spread=0.225": {"thin_spread": 0.225}, "active_zscore=1": {"active_zscore": 1.0}, "active_zscore=2": {"active_zscore": 2.0}, "burst_k=1.5": {"burst_k": 1.5},
    "burst_k=3.5": {"burst_k": 3.5}, "window=10": {"window": 10}, "window=30": {"window": 30},
}


def robustness(df: DataFrame, specs: dict[str, dict] = SPECS) -> DataFrame:
    """spec, contract_id, n and percent of rows in each state: windows of equal length are computed once."""
    out = None
    for w in sorted({Regimes(**v).window for v in specs.values()}):
        ready = _windows(df, Regimes(window=w))
        mine = {k: v for k, v in specs.items() if Regimes(**v).window == w}
        wide = ready.select("contract_id", F.array(*[F.struct(F.lit(k).alias("spec"), _state(ready, Regimes(**v)).alias("state")) for k, v in mine.items()]).alias("x"))
        part = wide.select("contract_id", F.explode("x").alias("x")).groupBy("x.spec", "contract_id")
        part = part.agg(F.count("*").alias("n"), *[(F.count_if(F.col("x.state") == c) * 100.0 / F.count("*")).alias(f"pct_{c}") for c in CODES])
        out = part if out is None else out.unionByName(part)
    return out


def bootstrap(df: DataFrame, draws: int = 100, seed: int = 42) -> DataFrame:
    """state, mean, std (population), low and high (2.5 and 97.5 percent) of state shares over resampled contracts.

    States are counted once for each contract; draws of contracts are rows of a range, so a
    larger table only makes the counts longer.
    """
    counts = df.groupBy("contract_id").agg(*[F.count_if(F.col("microstructure_state") == c).alias(f"n_{c}") for c in CODES])
    n = counts.count()
    if not n:
        return df.sparkSession.createDataFrame([], "state int, mean double, std double, low double, high double")
    spans = counts.withColumn("__part", F.pmod(F.xxhash64("contract_id"), F.lit(4096)))  # numbered in buckets of ids: a retry numbers them alike
    spans = spans.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy("contract_id")))
    size = spans.groupBy("__part").agg(F.count("*").alias("k"))  # at most as many rows as buckets
    size = size.withColumn("__before", F.coalesce(F.sum("k").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = spans.join(size.select("__part", "__before"), "__part").withColumn("ordinal", F.col("__before") + F.col("__in") - 1)
    picks = df.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("ordinal"))
    sums = picks.join(numbered, "ordinal").groupBy("draw").agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in CODES])
    total = reduce(lambda a, b: a + b, [F.col(f"n_{c}") for c in CODES])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("state"), (100.0 * F.col(f"n_{c}") / total).alias("share")) for c in CODES])).alias("x")).select("x.*")
    q = F.percentile("share", F.array(F.lit(0.025), F.lit(0.975)))
    drawn = long.groupBy("state").agg(F.sort_array(F.collect_list("share")).alias("all"), q.alias("q"))  # one number for each draw, added up in order
    mean = lambda f: F.aggregate("all", F.lit(0.0), lambda s, x: s + f(x)) / F.size("all")
    drawn = drawn.withColumn("mean", mean(lambda x: x))
    return drawn.select("state", "mean", F.sqrt(mean(lambda x: F.pow(x - F.col("mean"), 2))).alias("std"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
