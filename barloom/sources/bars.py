"""Bars of contracts: CSV folders, metadata, catalog, schema checks, and an adapter from events.

One long table ``bars(contract_id, category, ts, prices, quotes, volume, trade_count)``; whatever
is done for each contract is a window or a group over contract_id.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.common import by_time, quantile, seconds, whole

PRICES = ["price_c", "price_o", "price_h", "price_l"]
QUOTES = ["yes_bid_c", "yes_bid_o", "yes_bid_h", "yes_bid_l", "yes_ask_c", "yes_ask_o", "yes_ask_h", "yes_ask_l"]

# fixed values: columns of a bar file, in the order in which they stand there
_FILE_ORDER = ["datetime", "price_c", "yes_bid_c", "yes_ask_c", "volume", "price_o", "price_h", "price_l"]
_FILE_ORDER += ["yes_bid_o", "yes_bid_h", "yes_bid_l", "yes_ask_o", "yes_ask_h", "yes_ask_l", "trade_count", "contract_id"]
_TYPES = {"datetime": T.StringType(), "contract_id": T.StringType(), "volume": T.LongType(), "trade_count": T.LongType()}
BAR_FILE = T.StructType([T.StructField(c, _TYPES.get(c, T.DoubleType())) for c in _FILE_ORDER])

METADATA_FILE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("contract_id", "pm_category", "event_ticker", "title", "category", "status", "start_date", "end_date")]
    + [T.StructField("volume", T.LongType()), T.StructField("open_interest", T.LongType()), T.StructField("last_price", T.DoubleType()), T.StructField("resolution_rule", T.StringType())]
)

CANONICAL = ["Sports", "Politics", "Economics", "Crypto", "Weather"]
# fixed values: other names of the categories, in lower case
ALIASES = {
    "Sports": ["sports", "sport", "nfl", "nba", "mlb"],
    "Politics": ["politics", "political", "election", "elections"],
    "Economics": ["economics", "economic", "econ", "fed", "inflation", "cpi"],
    "Crypto": ["crypto", "cryptocurrency", "bitcoin", "btc"],
    "Weather": ["weather", "climate"],
}
STATUSES = ("active", "closed", "settled", "finalized")
FREQUENCIES = {"SECOND": "1s", "MINUTE": "1min", "HOUR": "1h", "DAY": "1D"}

_ID = re.compile(r"^[a-zA-Z0-9_\-]+$")


def check_contract_id(contract_id: str) -> str:
    """Strict identifiers for point lookups: letters, digits, ``_`` and ``-``."""
    if not isinstance(contract_id, str) or not _ID.match(contract_id):
        raise ValueError(f"invalid contract id: {contract_id!r}")
    return contract_id


def check_filename(name: str) -> str:
    if not name or ".." in name or "/" in name or "\\" in name:
        raise ValueError(f"invalid file name: {name!r}")
    return name


def valid_contract_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9_\-]+$"), F.lit(False))


def canonical_category(c: Column) -> Column:
    """Canonical names stay; other names by alias; what is left in title case (letters behind non-letters too)."""
    pairs = [F.lit(x) for name, words in ALIASES.items() for w in words for x in (w, name)]
    known = F.try_element_at(F.create_map(*pairs), F.lower(F.trim(c)))
    title = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), 0), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")
    return F.when(c.isin(*CANONICAL), c).otherwise(F.coalesce(known, title))


def status_code(c: Column) -> Column:
    """Upper-case status, UNKNOWN if it is none of the known ones."""
    return F.when(F.lower(F.trim(c)).isin(*STATUSES), F.upper(F.trim(c))).otherwise("UNKNOWN")


def parse_time(c: Column) -> Column:
    """UTC timestamps from text; what cannot be read is NULL, what has no zone is UTC."""
    return F.try_to_timestamp(c)


def to_eastern(c: Column) -> Column:
    return F.from_utc_timestamp(c, "America/New_York")


def _glob(root: str, categories: list[str] | None) -> list[str]:
    return [f"{root}/{check_filename(c)}/*.csv" for c in categories] if categories else [f"{root}/*/*.csv"]


def read_bars(spark: SparkSession, root: str, categories: list[str] | None = None, min_observations: int = 50) -> DataFrame:
    """Contracts of a folder tree category/contract.csv with enough rows. Chosen categories are the only folders read."""
    raw = spark.read.schema(BAR_FILE).option("header", True).option("enforceSchema", False).csv(_glob(root, categories))
    path = F.col("_metadata.file_path")
    stem = F.regexp_extract(path, r"([^/]+)\.csv$", 1)
    df = raw.withColumn("file_id", F.url_decode(stem)).withColumn("category", F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)))
    # a file is one contract: the first id in it, else its name, stands for all of its rows
    ids = raw.filter("contract_id is not null").select(path.alias("file"), "contract_id", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = ids.groupBy("file").agg(F.min_by("contract_id", F.struct("start", "at")).alias("first_id"))
    df = df.withColumn("file", path).join(first, "file", "left").drop("file").withColumn("contract_id", F.coalesce("first_id", "file_id")).drop("first_id").withColumn("category", canonical_category(F.col("category")))
    df = df.withColumn("ts", parse_time(F.col("datetime"))).drop("datetime", "file_id").filter(F.col("ts").isNotNull())
    return at_least(df, min_observations)


def at_least(bars: DataFrame, n: int) -> DataFrame:
    """Contracts with ``n`` rows or more."""
    return bars.withColumn("__n", F.count(F.lit(1)).over(whole())).filter(F.col("__n") >= n).drop("__n")


def read_contract(spark: SparkSession, root: str, contract_id: str, category: str | None = None) -> DataFrame:
    """One contract, by its file name."""
    name = check_contract_id(contract_id)
    folder = check_filename(category) if category else "*"
    raw = spark.read.schema(BAR_FILE).option("header", True).csv(f"{root}/{folder}/{name}.csv")
    return raw.withColumn("ts", parse_time(F.col("datetime"))).drop("datetime").filter(F.col("ts").isNotNull()).withColumn("contract_id", F.lit(contract_id))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """contract_id, category, path and size in KB of every file; no contents are read."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*.csv").select("path", "length")
    return files.select(
        F.url_decode(F.regexp_extract("path", r"([^/]+)\.csv$", 1)).alias("contract_id"),
        F.url_decode(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("category"),
        "path",
        (F.col("length") / 1024.0).alias("size_kb"),
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Contract metadata with parsed dates; an empty table if there is no such file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raw = spark.createDataFrame([], METADATA_FILE)
    else:
        raw = spark.read.schema(METADATA_FILE).option("header", True).csv(path)
    return typed_metadata(raw)


def typed_metadata(raw: DataFrame) -> DataFrame:
    """Dates parsed, counts 0 where missing, category from pm_category where there is one."""
    return (
        raw.withColumn("start_date", parse_time(F.col("start_date"))).withColumn("end_date", parse_time(F.col("end_date")))
        .withColumn("volume", F.coalesce("volume", F.lit(0))).withColumn("open_interest", F.coalesce("open_interest", F.lit(0)))
        .withColumn("category", F.coalesce("pm_category", "category"))
    )


def contract_metadata(contracts: DataFrame, contract_id: str) -> dict | None:
    """One contract's metadata by column, or None if there is no such contract."""
    row = contracts.filter(F.col("contract_id") == contract_id).first()
    return row.asDict() if row else None


class SchemaFile:
    """Expected columns from a JSON file of {table: {column: type}}."""

    def __init__(self, path: str | Path):
        self.tables = json.loads(Path(path).read_text())

    def missing(self, table: str, df: DataFrame) -> list[str]:
        return sorted(set(self.tables.get(table, {})) - set(df.columns))


def detect_frequency(bars: DataFrame) -> DataFrame:
    """contract_id and frequency, from the median distance of rows."""
    gap = seconds("ts") - seconds(F.lag("ts").over(by_time()))
    middle = bars.select("contract_id", gap.alias("gap")).groupBy("contract_id").agg(quantile("gap", 0.5).alias("gap"))
    code = F.when(F.col("gap").isNull(), "MINUTE").when(F.col("gap") <= 1.5, "SECOND").when(F.col("gap") <= 90, "MINUTE").when(F.col("gap") <= 5400, "HOUR").otherwise("DAY")
    return middle.select("contract_id", code.alias("frequency"))


def with_event_time(bars: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """``event_time``: the metadata's end date, else the first row's time in Sports and the last row's elsewhere."""
    own = F.when(F.col("category") == "Sports", F.min("ts").over(whole())).otherwise(F.max("ts").over(whole()))
    if contracts is None:
        return bars.withColumn("event_time", own)
    ends = contracts.select("contract_id", F.col("end_date").alias("__end"))
    return bars.withColumn("__own", own).join(ends, "contract_id", "left").withColumn("event_time", F.coalesce("__end", "__own")).drop("__own", "__end")


#: A bar for every event, as text that Spark and DuckDB both run.
BARS_SQL = """
SELECT concat('U', CAST(user_id AS STRING)) AS contract_id,
  CASE user_id % 5 WHEN 0 THEN 'Sports' WHEN 1 THEN 'Politics' WHEN 2 THEN 'Economics' WHEN 3 THEN 'Weather' ELSE 'Culture' END AS category,
  CAST(ts AS TIMESTAMP) AS ts, event_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE p END AS price_c,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE p + event_id % 2 END AS price_h,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE p - event_id % 3 END AS price_l,
  p - 1 - event_id % 4 AS yes_bid_c, p - event_id % 4 AS yes_bid_h, p - 2 - event_id % 4 - event_id % 5 AS yes_bid_l,
  p + 1 + event_id % 3 AS yes_ask_c, p + 2 + event_id % 3 + event_id % 7 AS yes_ask_h, p + event_id % 3 AS yes_ask_l,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE floor(value) END AS BIGINT) AS volume,
  CAST(event_id % 6 AS BIGINT) AS trade_count
FROM (SELECT *, CAST(least(99.0, greatest(1.0, round(value))) AS DOUBLE) AS p FROM events)
"""


def bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars made from the table of events (see ``BARS_SQL``)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # times without a zone are UTC
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(BARS_SQL.replace("FROM events", "FROM {events}"), events=events)
