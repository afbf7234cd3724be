"""One thin query for each operator: ``opN_<name>``, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mix import mix

    return mix(_t(spark, sf_dir, "documents"))


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_recurring_lines

    return drop_recurring_lines(_t(spark, sf_dir, "documents"), digest=True)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    out = quality_scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import private_digest

    return private_digest(_t(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(_t(spark, sf_dir, "pages"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_t(spark, sf_dir, "documents"), width=2)


def op7_kneser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser import language_model_scores

    return language_model_scores(_t(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chroma import align_recordings, render

    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").cast("array<double>").alias("media"))
    return align_recordings(vectors, F.col("rec_id") % 50 == 0, decode=render)


def op10_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toolcalls import conversation_calls

    return conversation_calls(_t(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
