"""Minute bars from a stream of trades and quotes.

What needs whole contracts (quantiles, row windows) stays on the batch path: streams only write bars, which
batch runs read. Late rows are taken until the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_bars(ticks: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Bars of tumbling windows from (contract_id, category, ts, price, yes_bid, yes_ask, size)."""
    w = F.window("ts", width)
    edge = lambda c, f: f(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts")))
    bars = ticks.withWatermark("ts", late).groupBy("contract_id", "category", w.alias("w")).agg(
        edge("price", F.min_by).alias("price_o"), F.max("price").alias("price_h"), F.min("price").alias("price_l"), edge("price", F.max_by).alias("price_c"),
        edge("yes_bid", F.max_by).alias("yes_bid_c"), F.max("yes_bid").alias("yes_bid_h"), F.min("yes_bid").alias("yes_bid_l"),
        edge("yes_ask", F.max_by).alias("yes_ask_c"), F.max("yes_ask").alias("yes_ask_h"), F.min("yes_ask").alias("yes_ask_l"),
        F.sum("size").cast("long").alias("volume"), F.count("price").alias("trade_count"),
    )
    return bars.select("contract_id", "category", F.col("w.start").alias("ts"), *[c for c in bars.columns if c not in ("contract_id", "category", "w")])


def category_volume(ticks: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Volume and trades by category over sliding windows."""
    w = F.window("ts", width, slide)
    out = ticks.withWatermark("ts", late).groupBy("category", w.alias("w")).agg(F.sum("size").cast("long").alias("volume"), F.count("*").alias("trades"))
    return out.select("category", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "volume", "trades")


def write_bars(bars: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append finished bars as Parquet by category; each bar is written once."""
    w = bars.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy("category")
    return (w.trigger(availableNow=True) if once else w).start()
