"""Bars onto a regular grid of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.common import by_time, ties


def _edge(c: str, pick, order: str) -> Column:
    """The first or last non-null value of a bin: max_by and min_by leave rows with a null order out."""
    return pick(F.col(c), F.when(F.col(c).isNotNull() & F.col("ts").isNotNull(), F.col(order)))


def resample(df: DataFrame, seconds: int = 60, keep: tuple[str, ...] = ("category",)) -> DataFrame:
    """Bins of ``seconds``, closed and labelled on the left, from each contract's first to its last.

    Volumes and trade counts are sums and 0 in empty bins; first, highest, lowest and last prices
    and quotes are taken by name and filled forward. ``keep`` are constants of a contract.
    Rows of one time go by event id, where there is one. Other columns go.
    """
    names, order = set(df.columns), "ts"
    if ties(df):  # a number in the window's own order: max_by a struct would cost a sort of its own
        df, order = df.withColumn("__at", F.row_number().over(by_time(ties(df)))), "__at"
    bin_ = F.timestamp_micros(F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * (seconds * 1_000_000))
    aggs: dict[str, Column] = {}
    for c in ("volume", "trade_count"):
        if c in names:
            aggs[c] = F.coalesce(F.sum(c), F.lit(0))
    for c, f in (("price_o", F.min_by), ("price_c", F.max_by), ("yes_bid_c", F.max_by), ("yes_ask_c", F.max_by)):
        if c in names:
            aggs[c] = _edge(c, f, order)
    for c, f in (("price_h", F.max), ("yes_bid_h", F.max), ("yes_ask_h", F.max), ("price_l", F.min), ("yes_bid_l", F.min), ("yes_ask_l", F.min)):
        if c in names:
            aggs[c] = f(c)
    keep = tuple(k for k in keep if k in names)
    bins = df.withColumn("__bin", bin_).groupBy("contract_id", "__bin").agg(*[v.alias(k) for k, v in aggs.items()], *[F.min(k).alias(k) for k in keep])
    w = Window.partitionBy("contract_id").orderBy("__bin")
    step = F.make_interval(secs=F.lit(seconds))
    values = [c for c in aggs if c not in ("volume", "trade_count")]
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, ignorenulls=True).over(past) for c in values}
    constant = {k: F.min(k).over(Window.partitionBy("contract_id")) for k in keep}
    bins = bins.withColumns({**filled, **constant, "__next": F.coalesce(F.lead("__bin").over(w) - step, F.col("__bin"))})
    # each bin repeats up to the next one: no calendar to join, and no second reading of the bars
    full = bins.withColumn("ts", F.explode(F.sequence("__bin", "__next", step)))
    own = F.col("ts") == F.col("__bin")
    sums = {c: F.when(own, F.col(c)).otherwise(F.lit(0)) for c in ("volume", "trade_count") if c in aggs}
    return (full.withColumns(sums) if sums else full).select("contract_id", *keep, "ts", *aggs)
