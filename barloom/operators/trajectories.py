"""Contracts on a common axis of minutes to their event, and summaries over contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Alignment
from barloom.functions.common import minutes, safe_div, whole

DEFAULT_METRICS = ("price_c", "midpoint", "spread", "spread_pct", "volume", "volume_zscore", "volatility_short", "depth_resilience", "book_thinning")
SIGNATURES = ("midpoint", "spread", "spread_pct", "volatility_short", "volume_zscore", "depth_resilience")


def melt(df: DataFrame, metrics: list[str], corrected: bool = False) -> DataFrame:
    """contract_id, category, metric, x (minutes from the row to the event; the other way round if corrected), y."""
    event = F.coalesce("event_time", F.max("ts").over(whole())) if "event_time" in df.columns else F.max("ts").over(whole())
    x = minutes(F.col("__e"), F.col("ts")) * (-1 if corrected else 1)
    rows = df.withColumn("__e", event).withColumn("x", x)
    items = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics if m in df.columns])).alias("i")
    return rows.select("contract_id", "category", "x", items).select("contract_id", "category", "i.metric", "x", "i.y").filter("y is not null and x is not null")


def align(df: DataFrame, metrics: list[str] | tuple[str, ...] = DEFAULT_METRICS, settings: Alignment | None = None, method: str = "linear", max_gap: float = 10, least: int = 3, corrected: bool = False) -> DataFrame:
    """contract_id, category, metric, grid_min, value, n: each contract's metrics on the grid.

    linear or nearest between the neighbouring values, NULL outside them and strictly inside gaps longer than
    ``max_gap`` minutes; cubic through all values (in pandas, by contract and metric). Contracts
    with fewer than ``least`` values of a metric are left out. ``n`` counts the values.
    """
    s = settings or Alignment()
    step = s.interpolation_grid_minutes
    points = melt(df, list(metrics), corrected)
    key = ["contract_id", "metric"]
    points = points.groupBy(*key, "category", "x").agg(F.avg("y").alias("y"))
    low, high = -s.grid_hours_pre * 60 // step, s.grid_hours_post * 60 // step
    if method == "cubic":
        return _cubic(points, step, low, high, max_gap, least)
    # every value serves the grid points from its own place up to the next value
    w = Window.partitionBy(*key)
    rows = points.withColumns({"n": F.count("*").over(w), "next": F.lead(F.struct("x", "y")).over(w.orderBy("x"))}).filter(F.col("n") >= least)
    own = F.floor(F.col("x") / step)
    until = F.when(F.col("next").isNull() | (F.col("next.x") - F.col("x") > max_gap), own).otherwise(F.ceil(F.col("next.x") / step) - 1)
    rows = rows.withColumns({"g0": F.greatest(F.ceil(F.col("x") / step), F.lit(low)), "g1": F.least(until, F.lit(high))}).filter("g0 <= g1")
    rows = rows.withColumn("g", F.explode(F.sequence("g0", "g1"))).withColumn("grid_min", F.col("g") * step)
    at = F.col("grid_min").cast("double")
    if method == "nearest":
        value = F.when(F.col("next").isNull() | (at - F.col("x") <= F.col("next.x") - at), F.col("y")).otherwise(F.col("next.y"))
    else:
        slope = F.col("y") + (F.col("next.y") - F.col("y")) * safe_div(at - F.col("x"), F.col("next.x") - F.col("x"))
        value = F.when(F.col("x") == at, F.col("y")).otherwise(slope)
    return rows.select("contract_id", "category", "metric", "grid_min", value.alias("value"), "n").filter("value is not null")


def _cubic(points: DataFrame, step: int, low: int, high: int, max_gap: float, least: int) -> DataFrame:
    not_a_knot = spline_function()

    def spline(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("x")
        x, y, n = rows["x"].to_numpy(), rows["y"].to_numpy(), len(rows)
        g = step * np.arange(max(np.ceil(x[0] / step), low), min(np.floor(x[-1] / step), high) + 1) if n >= least else np.zeros(0)
        v = not_a_knot(x, y, g) if len(g) else g
        i = np.clip(np.searchsorted(x, g, side="right") - 1, 0, n - 1)
        j = np.clip(i + 1, 0, n - 1)
        out = pd.DataFrame({"grid_min": g.astype("int64"), "value": v}).assign(**{c: rows[c].iloc[0] for c in ("contract_id", "category", "metric")}, n=n)
        return out[~((x[i] < g) & (g < x[j]) & (x[j] - x[i] > max_gap))][["contract_id", "category", "metric", "grid_min", "value", "n"]]

    return points.groupBy("contract_id", "metric").applyInPandas(spline, "contract_id string, category string, metric string, grid_min long, value double, n long")


def spline_function():
    """The spline as a local function: it travels to the workers by value."""

    def not_a_knot(x, y, g):
        """A cubic spline whose third derivative is continuous at the second and the last but one point.

        Both conditions give an end's second derivative by its two neighbours; what is left is tridiagonal and is
        eliminated in one pass.
        """
        import numpy as np

        n = len(x)
        if n < 4:
            return np.polyval(np.polyfit(x, y, n - 1), g) if n > 1 else np.full(len(g), y[0] if n else np.nan)
        h, slopes = np.diff(x), np.diff(y) / np.diff(x)
        below, above = h[:-1].copy(), h[1:].copy()
        middle, right = 2 * (below + above), 6 * np.diff(slopes)
        middle[0] += h[0] * (h[0] + h[1]) / h[1]
        above[0] -= h[0] ** 2 / h[1]
        middle[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
        below[-1] -= h[-1] ** 2 / h[-2]
        below, middle, above, right = below.tolist(), middle.tolist(), above.tolist(), right.tolist()
        for i in range(1, n - 2):
            k = below[i] / middle[i - 1]
            middle[i] -= k * above[i - 1]
            right[i] -= k * right[i - 1]
        right[-1] /= middle[-1]
        for i in range(n - 4, -1, -1):
            right[i] = (right[i] - above[i] * right[i + 1]) / middle[i]
        inner = np.array(right)
        first = ((h[0] + h[1]) * inner[0] - h[0] * inner[1]) / h[1]
        last = ((h[-2] + h[-1]) * inner[-1] - h[-1] * inner[-2]) / h[-2]
        m = np.concatenate([[first], inner, [last]])
        k = np.clip(np.searchsorted(x, g, side="right") - 1, 0, n - 2)
        t, s = g - x[k], x[k + 1] - g
        return (m[k] * s**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * s + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t

    return not_a_knot


def middle_minute(settings: Alignment | None = None) -> int:
    """The minute of the grid's middle point."""
    s = settings or Alignment()
    low, high = -s.grid_hours_pre * 60 // s.interpolation_grid_minutes, s.grid_hours_post * 60 // s.interpolation_grid_minutes
    return (low + (high - low + 1) // 2) * s.interpolation_grid_minutes


def normalise_trajectories(aligned: DataFrame, method: str = "zscore", settings: Alignment | None = None) -> DataFrame:
    """Each trajectory by zscore (population), minmax (0.5 if flat), anchor (value at the middle of the settings' grid); others stay."""
    w = Window.partitionBy("contract_id", "metric")
    v, n = F.col("value"), F.count("value").over(w)
    if method == "zscore":
        s = F.stddev_pop(v).over(w)
        new = F.when(s > 0, (v - F.avg(v).over(w)) / s).otherwise(0.0)
    elif method == "minmax":
        a, b = F.min(v).over(w), F.max(v).over(w)
        new = F.when(b > a, (v - a) / (b - a)).otherwise(0.5)
    elif method == "anchor":
        middle = F.max(F.when(F.col("grid_min") == middle_minute(settings), v)).over(w)
        new = F.when(middle.isNotNull() & (middle != 0), v / middle).otherwise(v)
    else:
        return aligned
    return aligned.withColumn("value", F.when(n < 2, v).otherwise(new))


def aggregate(aligned: DataFrame, by_category: bool = True, normalize: bool = True, method: str = "zscore", settings: Alignment | None = None) -> DataFrame:
    """Weighted median, mean and percentiles (10, 25, 75, 90) of each grid point; std (population) and count without weights.

    Weights are each trajectory's number of values; a percentile is the smallest value whose
    running weight reaches it. Without ``by_category`` all categories are pooled.
    """
    if normalize:
        aligned = normalise_trajectories(aligned, method, settings)
    if not by_category:
        aligned = aligned.withColumn("category", F.lit("overall"))
    key = ["metric", "category", "grid_min"]
    w = Window.partitionBy(*key)
    run = F.sum("n").over(w.orderBy("value", "contract_id").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)
    rows = aligned.withColumn("cw", run)

    def weighted(p: float) -> Column:
        reached = F.when(F.col("cw") >= p - 1e-12, F.struct("cw", "contract_id"))
        return F.coalesce(F.min_by("value", reached), F.max("value"))

    return rows.groupBy(*key).agg(
        weighted(0.5).alias("median"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"), weighted(0.1).alias("p10"), weighted(0.25).alias("p25"), weighted(0.75).alias("p75"),
        weighted(0.9).alias("p90"), F.stddev_pop("value").alias("std"), F.count("value").alias("count"),
    )


def signatures(df: DataFrame, settings: Alignment | None = None, method: str = "zscore") -> DataFrame:
    """Aggregated trajectories of the signature metrics, overall and by category."""
    aligned = align(df, [m for m in SIGNATURES if m in df.columns], settings)
    return aggregate(aligned, False, method=method, settings=settings).unionByName(aggregate(aligned, True, method=method, settings=settings))


def event_window(df: DataFrame, pre: float = 60, post: float = 30) -> DataFrame:
    """Rows within [event - pre, event + post] minutes, with ``side`` pre (before the event) or post."""
    x = minutes(F.col("ts"), F.col("event_time"))
    side = F.when((x >= -pre) & (x < 0), "pre").when((x >= 0) & (x <= post), "post")
    return df.withColumn("side", side).filter("side is not null")


def normalise_to_event(df: DataFrame, c: str = "price_c") -> DataFrame:
    """x (minutes since the event) and the value over the one nearest to the event (over the first one if that is missing or 0)."""
    df = df.withColumn("x", minutes(F.col("ts"), F.col("event_time")))
    near = F.min_by(F.col(c), F.struct(F.abs("x"), F.col("ts"))).over(whole())
    first = F.min_by(F.col(c), F.col("ts")).over(whole())
    base = F.when(near.isNull() | (near == 0), first).otherwise(near)
    return df.select("contract_id", "x", safe_div(F.col(c), F.nullif(base, F.lit(0.0))).alias("value"))


def median_trajectory(rows: DataFrame) -> DataFrame:
    """Over (contract_id, x, value): median, quartiles, std and count at each x."""
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    out = rows.groupBy("x").agg(q.alias("q"), F.stddev_samp("value").alias("std"), F.count("value").alias("count"))
    return out.select("x", F.col("q")[0].alias("median"), F.col("q")[1].alias("q25"), F.col("q")[2].alias("q75"), "std", "count")


def compare_sides(windowed: DataFrame, metrics: tuple[str, ...] = ("spread", "volume", "volatility_short")) -> DataFrame:
    """Before against behind the event, for each contract and metric with three values on either side.

    Means, sample deviations, change in percent, pooled-variance t statistic and its two-sided
    p-value, Kolmogorov-Smirnov statistic and its asymptotic p-value.
    """
    items = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in metrics if m in windowed.columns])).alias("i")
    rows = windowed.select("contract_id", "side", items).select("contract_id", "side", "i.metric", "i.y").filter("y is not null")
    key = ["contract_id", "metric"]
    pre, post = F.col("side") == "pre", F.col("side") == "post"
    y = lambda c: F.when(c, F.col("y"))
    stats = rows.groupBy(*key).agg(
        F.count(y(pre)).alias("n_pre"), F.count(y(post)).alias("n_post"), F.avg(y(pre)).alias("mean_pre"), F.avg(y(post)).alias("mean_post"), F.stddev_samp(y(pre)).alias("std_pre"), F.stddev_samp(y(post)).alias("std_post")
    )
    stats = stats.filter("n_pre >= 3 and n_post >= 3")
    w = Window.partitionBy(*key).orderBy("y")  # with ties: a range frame
    cdf = rows.withColumns({"a": F.count(y(pre)).over(w), "b": F.count(y(post)).over(w)})
    cdf = cdf.join(stats.select(*key, "n_pre", "n_post"), key)
    ks = cdf.groupBy(*key).agg(F.max(F.abs(F.col("a") / F.col("n_pre") - F.col("b") / F.col("n_post"))).alias("ks_stat"))
    df_ = F.col("n_pre") + F.col("n_post") - 2
    pooled = ((F.col("n_pre") - 1) * F.pow("std_pre", 2) + (F.col("n_post") - 1) * F.pow("std_post", 2)) / df_
    t = safe_div(F.col("mean_pre") - F.col("mean_post"), F.nullif(F.sqrt(pooled * (1 / F.col("n_pre") + 1 / F.col("n_post"))), F.lit(0.0)))
    out = stats.join(ks, key).withColumn("t_stat", t).withColumn("change_pct", safe_div(F.col("mean_post") - F.col("mean_pre"), F.nullif(F.abs("mean_pre"), F.lit(0.0))) * 100)
    n = F.col("n_pre") * F.col("n_post") / (F.col("n_pre") + F.col("n_post"))
    return out.withColumn("t_pvalue", student_p(F.col("t_stat"), df_)).withColumn("ks_pvalue", kolmogorov_p(F.col("ks_stat"), n))


def student_p(t: Column, df_: Column) -> Column:
    """Two-sided p-value of Student's t: for n degrees a finite sum over cosines of atan(t / sqrt(n))."""
    theta = F.atan(F.abs(t) / F.sqrt(df_.cast("double")))
    c2 = F.pow(F.cos(theta), 2)
    odd = df_ % 2 == 1
    # terms of Abramowitz and Stegun 26.7.3 and 26.7.4
    steps = F.when(odd, (df_ - 3) / 2).otherwise((df_ - 2) / 2).cast("int")
    ks = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))

    def add(s: Column, k: Column) -> Column:
        ratio = F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
        term = s["term"] * ratio * c2
        return F.struct((s["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(ks, F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")), add)["sum"]
    a_odd = F.when(df_ == 1, theta * 2 / F.pi()).otherwise((theta + F.sin(theta) * F.cos(theta) * series) * 2 / F.pi())
    return F.greatest(F.lit(0.0), 1 - F.when(odd, a_odd).otherwise(F.sin(theta) * series))


def kolmogorov_p(d: Column, n: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the two-sample statistic with effective size ``n``."""
    lam = F.sqrt(n) * d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0)))
