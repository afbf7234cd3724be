"""Intermediate tables in the folder that all executors share.

``stash`` cuts lineage by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs the reading of a file and not a recomputation.
Tables are removed when the Python process ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATHS: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets one; a cluster has to set it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", where)
        _PATHS.append((spark, where))
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"
    _PATHS.append((spark, path))
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _PATHS:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone: nothing is left to ask
            return


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="barloom-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package importable on the workers, and batches that long texts do not swell.

    A limit other than Spark's default of 64 MB is the user's and stays.
    """
    spark = df.sparkSession
    ship(spark)
    if re.sub(r"\D", "", spark.conf.get(BATCH)) == str(64 << 20):
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(fn, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A name that is no column of ``df`` yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, and that column's name: ids may be null or repeat, rows do not."""
    row = fresh(docs, "row")
    return stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


SENT_ROWS = 1_000_000


def without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """``rows`` less those whose number is in ``gone`` (one column), and without the number: sent to all tasks up to ``SENT_ROWS``, joined beyond."""
    out = fresh(rows, "gone")
    gone = stash(gone.select(F.col(gone.columns[0]).alias(out)).distinct(), "gone")
    small = gone.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return rows.join(F.broadcast(gone) if small else gone, rows[row] == gone[out], "left_anti").drop(row)
