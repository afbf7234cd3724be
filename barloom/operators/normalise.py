"""Normalisation of one contract's values and across contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Normalization
from barloom.functions.common import quantile, rows, whole

METHODS = ("zscore", "percentile", "minmax", "robust")


def zscore(c: str, window: int | None = None) -> Column:
    """Over the contract (0 without deviation) or over the last ``window`` rows (NULL without)."""
    x = F.col(c).cast("double")
    w = whole() if window is None else rows(window)
    m, s = F.avg(x).over(w), F.stddev_samp(x).over(w)
    if window is not None:
        return F.try_divide(x - m, F.nullif(s, F.lit(0.0)))
    return F.when(x.isNotNull(), F.when(s > 0, (x - m) / s).otherwise(0.0))


def percentile_rank(c: str) -> Column:
    """Mean rank of ties over the number of values."""
    x = F.col(c)
    w = Window.partitionBy("contract_id").orderBy(x.asc_nulls_last())
    ties = F.count(x).over(Window.partitionBy("contract_id", x))
    return F.when(x.isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / F.count(x).over(whole()))


def minmax(c: str, low: float = 0.0, high: float = 1.0) -> Column:
    """Onto low..high; the middle if all values are equal."""
    x = F.col(c).cast("double")
    a, b = F.min(x).over(whole()), F.max(x).over(whole())
    return F.when(x.isNotNull(), F.when(b > a, low + (x - a) / (b - a) * (high - low)).otherwise((low + high) / 2))


def robust(c: str, low: float = 25, high: float = 75) -> Column:
    """From the median, in interquartile ranges; 0 without a range."""
    x = F.col(c).cast("double")
    q = F.percentile(x, F.array(F.lit(0.5), F.lit(low / 100), F.lit(high / 100))).over(whole())
    return F.when(x.isNotNull(), F.when(q[2] > q[1], (x - q[0]) / (q[2] - q[1])).otherwise(0.0))


def normalise(c: str, method: str = "zscore") -> Column:
    """Unknown methods are z-scores."""
    return {"percentile": percentile_rank, "minmax": minmax, "robust": robust}.get(method, zscore)(c)


def clipped(df: DataFrame, c: str, lower: float, upper: float) -> DataFrame:
    """``c`` between its own percentiles, before a percentile or minmax normalisation."""
    q = F.percentile(F.col(c), F.array(F.lit(lower / 100), F.lit(upper / 100))).over(whole())
    return df.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), q[0]), q[1])))


def configured_method(c: str, settings: Normalization | None = None) -> str:
    s = settings or Normalization()
    return next((getattr(s, k) for k in ("spread", "volume", "depth", "volatility", "price") if k in c), s.default)


def normalise_columns(df: DataFrame, columns: list[str], method: str | dict | None = None, suffix: str = "_norm", settings: Normalization | None = None) -> DataFrame:
    """One method for all, one for each by a dict, or those of the settings."""

    def of(c: str) -> str:
        if isinstance(method, dict):
            return method.get(c, "zscore")
        return method or configured_method(c, settings)

    return df.withColumns({c + suffix: normalise(c, of(c)) for c in columns if c in df.columns})


def across_contracts(df: DataFrame, c: str, method: str = "zscore") -> DataFrame:
    """``c`` against all contracts: zscore, minmax, or percentile (share of all rows strictly below).

    Ranks come from counts by distinct value, in two levels: a running sum inside a bucket of values and one over
    the buckets, so no task sees all rows. Buckets are cut by value alone, evenly and by logarithm at once, so
    that a retried task puts every value where its first attempt did.
    """
    x = F.col(c).cast("double")
    out = f"{c}_norm"
    stats = df.agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"), F.min(x).alias("__a"), F.max(x).alias("__b"), F.count("*").alias("__all"))
    if method != "percentile":
        value = F.when(F.col("__s") > 0, (x - F.col("__m")) / F.col("__s")).otherwise(0.0) if method == "zscore" else F.when(F.col("__b") > F.col("__a"), (x - F.col("__a")) / (F.col("__b") - F.col("__a"))).otherwise(0.5)
        return df.crossJoin(F.broadcast(stats)).withColumn(out, F.when(x.isNotNull(), value)).drop("__m", "__s", "__a", "__b", "__all")
    v = F.col("__v")
    even = F.floor(F.try_divide(v - F.col("__a"), F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0))) * 4096)
    bucket = F.struct((F.signum(v) * F.floor(F.log1p(F.abs(v)) * 64)).alias("log"), F.coalesce(even, F.lit(0)).alias("even"))
    counts = df.groupBy(x.alias("__v")).agg(F.count("*").alias("__n")).filter("__v is not null")
    counts = counts.crossJoin(F.broadcast(stats.select("__a", "__b", "__all"))).withColumn("__part", bucket)
    inner = Window.partitionBy("__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    values = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    parts = counts.groupBy("__part").agg(F.sum("__n").alias("__k"))  # a bounded number of buckets
    parts = parts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__k").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    below = values.join(parts, values["__part"] == parts["__p"]).select("__v", ((F.col("__before") + F.col("__in")) / F.col("__all")).alias(out))
    return df.join(below, x == F.col("__v"), "left").drop("__v")


class Normalizer:
    """Parameters fitted on one table and applied to others: zscore, minmax or robust."""

    def __init__(self, method: str = "zscore"):
        if method not in ("zscore", "minmax", "robust"):
            raise ValueError(f"no such method: {method}")
        self.method, self.columns, self.params = method, [], None

    def fit(self, df: DataFrame, columns: list[str]) -> Normalizer:
        self.columns = columns
        aggs = []
        for c in columns:
            x = F.col(c).cast("double")
            mid, width = {
                "zscore": (F.avg(x), F.stddev_samp(x)), "minmax": (F.min(x), F.max(x) - F.min(x)), "robust": (quantile(x, 0.5), quantile(x, 0.75) - quantile(x, 0.25)),
            }[self.method]
            aggs += [mid.alias(f"__m_{c}"), width.alias(f"__w_{c}")]
        self.params = df.agg(*aggs)
        return self

    def transform(self, df: DataFrame, suffix: str = "_norm") -> DataFrame:
        if self.params is None:
            raise ValueError("transform before fit")
        flat = 0.5 if self.method == "minmax" else 0.0
        x = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(f"__w_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__w_{c}")).otherwise(flat))
        out = df.crossJoin(F.broadcast(self.params)).withColumns({c + suffix: x(c) for c in self.columns})
        return out.drop(*[f"__{k}_{c}" for c in self.columns for k in "mw"])

    def fit_transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)
