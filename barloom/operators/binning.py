"""Lifecycle position, time bins, and aggregation by bin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.common import hours, minutes, whole

#: right-closed edges of the phases; 0 belongs to the first
PHASES = ((0.05, "early"), (0.20, "ramp_up"), (0.80, "middle"), (0.95, "late"), (1.0, "resolution"))


def lifecycle(df: DataFrame, listing: Column | None = None, settlement: Column | None = None, event: Column | None = None, exclude_post_resolution: bool = True) -> DataFrame:
    """tsl_hours, tts_hours, lifecycle_ratio, lifecycle_phase; rows behind the settlement go unless asked for.

    An explicit settlement comes before an event time, and both before the last row.
    """
    start = F.coalesce(listing, F.min("ts").over(whole())) if listing is not None else F.min("ts").over(whole())
    ends = [c for c in (settlement, event) if c is not None]
    end = F.coalesce(*ends, F.max("ts").over(whole()))
    df = df.withColumn("__a", start).withColumn("__b", end)
    length = hours(F.col("__b"), F.col("__a"))
    ratio = F.when(length > 0, F.least(F.greatest(hours(F.col("ts"), F.col("__a")) / F.nullif(length, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    df = df.withColumns({"tsl_hours": hours(F.col("ts"), F.col("__a")), "tts_hours": hours(F.col("__b"), F.col("ts")), "lifecycle_ratio": ratio}).drop("__a", "__b")
    phase = F.when(F.col("lifecycle_ratio") <= PHASES[0][0], PHASES[0][1])
    for edge, name in PHASES[1:]:
        phase = phase.when(F.col("lifecycle_ratio") <= edge, name)
    df = df.withColumn("lifecycle_phase", phase)
    return df.filter("tts_hours >= 0") if exclude_post_resolution else df


def right_closed(x: Column, n: int, width: float = 1.0, low: float = 0.0) -> Column:
    """The bin, from 0, of ``x`` in n right-closed bins that start at ``low``; exact at edges."""
    b = F.ceil((x - low) / width) - 1
    b = F.when(x <= low + b * width, b - 1).when(x > low + (b + 1) * width, b + 1).otherwise(b)
    return F.least(F.greatest(b, F.lit(0)), F.lit(n - 1)).cast("int")


def lifecycle_bins(df: DataFrame, n: int = 50, nonlinear: bool = False) -> DataFrame:
    """lifecycle_bin and lifecycle_bin_center; nonlinear: the five phases as bins with their middles."""
    r = F.col("lifecycle_ratio")
    if nonlinear:
        edges = [0.0, *[e for e, _ in PHASES]]
        b = F.when(r <= edges[1], 0)
        for k in range(2, len(edges)):
            b = b.when(r <= edges[k], k - 1)
        middles = F.array(*[F.lit((edges[k] + edges[k + 1]) / 2) for k in range(len(edges) - 1)])
        return df.withColumn("lifecycle_bin", b).withColumn("lifecycle_bin_center", middles[F.col("lifecycle_bin")])
    k = F.ceil(r * n) - 1
    k = F.when(r <= k / n, k - 1).when(r > (k + 1) / n, k + 1).otherwise(k)
    df = df.withColumn("lifecycle_bin", F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)).cast("int"))
    return df.withColumn("lifecycle_bin_center", F.col("lifecycle_bin") / float(n) + 0.5 / n)


def settlement_bins(df: DataFrame, bin_hours: float = 1, max_hours: float = 48) -> DataFrame:
    """tts_bin and its middle in hours; what lies outside joins the outer bins."""
    n = int(max_hours / bin_hours)
    x = F.least(F.greatest(F.col("tts_hours"), F.lit(0.0)), F.lit(float(max_hours)))
    df = df.withColumn("tts_bin", right_closed(x, n, bin_hours))
    return df.withColumn("tts_bin_hours", (F.col("tts_bin") + 0.5) * float(bin_hours))


def event_bins(df: DataFrame, bin_minutes: float = 5, hours_pre: float = 24, hours_post: float = 4) -> DataFrame:
    """minutes_to_event (positive before it), event_bin and the bin's middle in minutes."""
    df = df.withColumn("minutes_to_event", minutes(F.col("event_time"), F.col("ts")))
    low, high = -hours_post * 60.0, hours_pre * 60.0
    x = F.least(F.greatest(F.col("minutes_to_event"), F.lit(low)), F.lit(high))
    n = int((high - low) / bin_minutes)
    df = df.withColumn("event_bin", right_closed(x, n, bin_minutes, low))
    return df.withColumn("event_bin_minutes", low + (F.col("event_bin") + 0.5) * float(bin_minutes))


def time_bins(df: DataFrame, mode: str = "lifecycle", n: int = 50, hours_pre: float = 24, hours_post: float = 4) -> tuple[DataFrame, str]:
    """(df with bins, name of the bin column) by lifecycle, tts_hours (or tts) or event_aligned."""
    if mode == "event_aligned":
        return event_bins(df, hours_pre=hours_pre, hours_post=hours_post), "event_bin"
    if "lifecycle_ratio" not in df.columns:
        df = lifecycle(df)
    if mode == "lifecycle":
        return lifecycle_bins(df, n), "lifecycle_bin"
    if mode in ("tts_hours", "tts"):
        return settlement_bins(df, max_hours=hours_pre), "tts_bin"
    raise ValueError(f"no such mode: {mode}")


AGGREGATES: dict[str, Callable[[str], Column]] = {
    "mean": F.avg, "median": lambda c: F.percentile(F.col(c), F.lit(0.5)), "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count,
    "first": lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))), "last": lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))),
}


def aggregate_by_bins(df: DataFrame, keys: list[str], how: dict[str, list[str]]) -> DataFrame:
    """Aggregates named column_function for each group of ``keys``; columns that are not there are left out."""
    aggs = [AGGREGATES[f](c).alias(f"{c}_{f}") for c, fs in how.items() if c in df.columns for f in fs]
    return df.groupBy(*keys).agg(*aggs)


def binned_trajectory(df: DataFrame, value: str, bin_col: str, center_col: str | None = None, keys: tuple[str, ...] = (), percentiles: tuple[int, ...] = (10, 25, 50, 75, 90), smooth: int = 3) -> DataFrame:
    """Percentiles by bin, then their centred rolling medians over the bins that are there; counts and centers."""
    q = F.percentile(F.col(value), F.array(*[F.lit(p / 100) for p in percentiles]))
    center = [F.max(center_col).alias("center")] if center_col else []
    by = df.groupBy(*keys, bin_col).agg(q.alias("__q"), F.count(value).alias("count"), *center)
    by = by.select(*keys, bin_col, "count", *(["center"] if center_col else []), *[F.col("__q")[i].alias(f"p{p}") for i, p in enumerate(percentiles)])
    half = smooth // 2
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(bin_col).rowsBetween(-half, half)
    return by.withColumns({f"p{p}": F.percentile(F.col(f"p{p}"), F.lit(0.5)).over(w) for p in percentiles})
