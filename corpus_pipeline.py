"""A corpus pipeline over ``documents``: quality, lines, near-duplicates, benchmark passages, mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of documents; the last returns what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.decontaminate import decontaminate
from barloom.llm.linededup import drop_recurring_lines
from barloom.llm.mix import mix
from barloom.llm.neardup import drop_near_duplicates
from barloom.llm.quality import keep_quality
from barloom.llm.stash import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more stay."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and documents of which nothing is left."""
    return drop_recurring_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles the smallest doc_id stays."""
    return drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: Python and learned models decide in several stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
