import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def bars(spark):
    """A bar table from a dict of column lists; one contract A of one-minute rows unless told otherwise."""
    from datetime import datetime, timedelta

    def make(step: int = 60, contract: str = "A", category: str = "Sports", types: dict | None = None, **cols):
        n = len(next(iter(cols.values())))
        start = datetime(2024, 1, 1)
        rows = [(contract, category, start + timedelta(seconds=step * i), *[c[i] for c in cols.values()]) for i in range(n)]
        kinds = {k: ("long" if k in ("volume", "trade_count") else "double") for k in cols} | (types or {})
        return spark.createDataFrame(rows, "contract_id string, category string, ts timestamp, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))

    return make


@pytest.fixture
def column():
    """The values of one column in order of time."""

    def get(df, name):
        return [r[0] for r in df.orderBy("contract_id", "ts").select(name).collect()]

    return get
