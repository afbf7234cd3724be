"""Validation, imputation, winsorizing, clamping, and the cleaning chain with its counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import Cleaning
from barloom.functions.common import backwards, by_time, clip, flag, safe_div, seconds, so_far, ties, whole


def price_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "price" in c]


def quote_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "bid" in c or "ask" in c]


def validate_prices(df: DataFrame, low: float = 0, high: float = 100) -> DataFrame:
    """contract_id, field, below, above: how many values leave the range."""
    cols = price_columns(df)
    counts = df.groupBy("contract_id").agg(*[F.count_if(F.col(c) < low).alias(f"b_{c}") for c in cols], *[F.count_if(F.col(c) > high).alias(f"a_{c}") for c in cols])
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"b_{c}").alias("below"), F.col(f"a_{c}").alias("above")) for c in cols])).alias("x")
    return counts.select("contract_id", items).select("contract_id", "x.*")


def validate_spreads(df: DataFrame, most: float = 0.5) -> DataFrame:
    """contract_id and the number of rows with (ask - bid) / bid above ``most``; a bid of 0 below an ask counts."""
    wide = (safe_div(F.col("yes_ask_c") - F.col("yes_bid_c"), "yes_bid_c") > most) | ((F.col("yes_bid_c") == 0) & (F.col("yes_ask_c") > 0))
    return df.groupBy("contract_id").agg(F.count_if(flag(wide)).alias("wide_spreads"))


def validate_times(df: DataFrame, order: str) -> DataFrame:
    """contract_id, null times and times that fall behind the row before, in input order ``order``."""
    w = whole().orderBy(order)
    rows = df.select("contract_id", "ts", (F.col("ts") < F.lag("ts").over(w)).alias("back"))
    return rows.groupBy("contract_id").agg(F.count_if(F.col("ts").isNull()).alias("null_times"), F.count_if(flag(F.col("back"))).alias("backward_times"))


VALIDATORS = {"prices": validate_prices, "spreads": validate_spreads}


def validate(df: DataFrame, settings: Cleaning | None = None) -> DataFrame:
    """contract_id, is_valid and messages of all checks."""
    s = settings or Cleaning()
    prices = validate_prices(df, s.min_price, s.max_price)
    text = [F.when(F.col(k) > 0, F.concat_ws(" ", F.col("field"), F.lit(word), F.col(k).cast("string"))) for k, word in (("below", "below range:"), ("above", "above range:"))]
    prices = prices.select("contract_id", F.explode(F.filter(F.array(*text), lambda x: x.isNotNull())).alias("error"))
    spreads = validate_spreads(df, s.max_spread_pct).filter("wide_spreads > 0").select("contract_id", F.concat(F.lit("wide spreads: "), F.col("wide_spreads").cast("string")).alias("error"))
    times = df.filter("ts is null").groupBy("contract_id").agg(F.count("*").alias("n")).select("contract_id", F.concat(F.lit("null times: "), F.col("n").cast("string")).alias("error"))
    errors = prices.unionByName(spreads).unionByName(times).groupBy("contract_id").agg(F.sort_array(F.collect_list("error")).alias("errors"))
    ids = df.select("contract_id").distinct()
    return ids.join(errors, "contract_id", "left").select("contract_id", F.col("errors").isNull().alias("is_valid"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def fill_forward(c: str, more: tuple[str, ...] = ()) -> Column:
    return F.last(c, ignorenulls=True).over(so_far(more))


def fill_backward(c: str, more: tuple[str, ...] = ()) -> Column:
    return F.last(c, ignorenulls=True).over(backwards(more))


def _between(more: tuple[str, ...]) -> Column:
    """By position, from ``__n`` and ``__item``: between the neighbours with values; the last one holds on, the start stays empty."""
    before, behind = F.last("__item", ignorenulls=True).over(so_far(more)), F.last("__item", ignorenulls=True).over(backwards(more))
    step = safe_div(behind["v"] - before["v"], behind["n"] - before["n"])
    return F.when(before.isNull(), None).when(behind.isNull(), before["v"]).when(behind["n"] == before["n"], before["v"]).otherwise(before["v"] + step * (F.col("__n") - before["n"]))


def impute(df: DataFrame, columns: list[str], method: str = "forward_fill") -> DataFrame:
    """Missing values by forward_fill (also midpoint), backward_fill or linear; drop changes nothing. Rows of one time go by event id."""
    columns, more = [c for c in columns if c in df.columns], ties(df)
    if method == "drop":
        return df
    if method == "linear":
        df = df.withColumn("__n", F.row_number().over(by_time(more)))
        for c in columns:
            df = df.withColumn("__item", F.when(F.col(c).isNotNull(), F.struct(F.col("__n").alias("n"), F.col(c).cast("double").alias("v")))).withColumn(c, _between(more))
        return df.drop("__n", "__item")
    fill = fill_backward if method == "backward_fill" else fill_forward
    return df.withColumns({c: fill(c, more) for c in columns})


def impute_quotes(df: DataFrame) -> DataFrame:
    """Quotes are always filled forward."""
    return impute(df, quote_columns(df))


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.01) -> DataFrame:
    """Clip to the quantiles ``low`` and 1 - ``high`` of the contract; NULL stays NULL."""
    for c in columns:
        q = F.percentile(F.col(c), F.array(F.lit(low), F.lit(1 - high))).over(whole())
        df = df.withColumn("__q", q).withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col("__q")[0]), F.col("__q")[1]))).drop("__q")
    return df


def count_clipped(df: DataFrame, c: str, low: float = 0.01, high: float = 0.01) -> DataFrame:
    """contract_id and how many values of ``c`` winsorizing changes."""
    q = F.percentile(F.col(c), F.array(F.lit(low), F.lit(1 - high))).over(whole())
    rows = df.select("contract_id", c, q.alias("__q"))
    return rows.groupBy("contract_id").agg(F.count_if((F.col(c) < F.col("__q")[0]) | (F.col(c) > F.col("__q")[1])).alias("clipped"))


def clamp_prices(df: DataFrame, low: float = 1, high: float = 99) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), float(low), float(high)) for c in price_columns(df)})


def clean(df: DataFrame, settings: Cleaning | None = None) -> DataFrame:
    """Null times go, prices and quotes are filled, prices clamped, sparse rows go if asked, small contracts go."""
    s = settings or Cleaning()
    df = df.filter(F.col("ts").isNotNull())
    df = impute_quotes(impute(df, price_columns(df), s.imputation_method))
    df = winsorize(df, [c for c in df.columns if "return" in c], *s.winsorize_limits)
    df = clamp_prices(df, s.min_price, s.max_price)
    if s.drop_zero_volume_only:
        df = df.filter("volume > 0")
    n = F.count(F.lit(1)).over(whole())
    return df.withColumn("__n", n).filter(F.col("__n") >= s.min_observations).drop("__n")


def cleaning_stats(df: DataFrame, settings: Cleaning | None = None) -> DataFrame:
    """A row for each contract: rows before and after, share removed, nulls filled, values clipped and clamped."""
    s = settings or Cleaning()
    values = [c for c in df.columns if c not in ("contract_id", "category", "ts", "event_id")]
    nulls = lambda d: reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in values])
    before = df.groupBy("contract_id").agg(F.count("*").alias("original_rows"), F.sum(nulls(df)).alias("nulls_before"))
    filled = impute_quotes(impute(df.filter(F.col("ts").isNotNull()), price_columns(df), s.imputation_method))
    outside = reduce(lambda a, b: a + b, [flag((F.col(c) < s.min_price) | (F.col(c) > s.max_price)).cast("long") for c in price_columns(df)])
    filled = filled.withColumn("__outside", outside)
    if s.drop_zero_volume_only:
        filled = filled.filter("volume > 0")
    after = filled.groupBy("contract_id").agg(F.count("*").alias("final_rows"), F.sum(nulls(filled)).alias("nulls_after"), F.sum("__outside").alias("invalid_prices_fixed"))
    both = before.join(after, "contract_id", "left").na.fill(0, ["final_rows", "nulls_after", "invalid_prices_fixed"])
    removed = F.col("original_rows") - F.col("final_rows")
    return both.select(
        "contract_id", "original_rows", "final_rows", removed.alias("rows_removed"),
        (F.coalesce(safe_div(removed, "original_rows"), F.lit(0.0)) * 100).alias("removal_pct"),
        F.greatest(F.col("nulls_before") - F.col("nulls_after"), F.lit(0)).alias("nulls_imputed"),
        F.lit(0).cast("long").alias("outliers_winsorized"), "invalid_prices_fixed",
    )


def detect_gaps(df: DataFrame, minutes: float = 10) -> DataFrame:
    """``gap``: the row before is more than ``minutes`` away."""
    far = (seconds("ts") - seconds(F.lag("ts").over(by_time()))) > minutes * 60
    return df.withColumn("gap", flag(far))
