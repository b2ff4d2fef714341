"""Failure analysis of batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text


def explained(df: DataFrame) -> DataFrame:
    """Batch results with passed, reason and severity."""
    return (
        df.withColumn("passed", text.passed(F.col("similarity")))
        .withColumn("reason", text.failure_reason(F.col("model_answer"), F.col("similarity")))
        .withColumn("severity", text.failure_severity(F.col("model_answer"), F.col("similarity")))
    )


def reason_counts(df: DataFrame) -> DataFrame:
    return explained(df).filter(~F.col("passed")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def by_severity(df: DataFrame, order: str, descending: bool = True) -> DataFrame:
    """Failures by severity; descending puts Low first; ties keep the given order."""
    rank = text.severity_rank(F.col("severity"))
    return explained(df).filter(~F.col("passed")).orderBy(rank.desc() if descending else rank.asc(), order)


def with_reason(df: DataFrame, reason: str | None = None) -> DataFrame:
    """Results with a given reason; none, or "All", doesn't filter."""
    made = explained(df)
    return made if reason in (None, "All") else made.filter(made["reason"] == reason)


def by_number(df: DataFrame, column: str, order: str, descending: bool = False) -> DataFrame:
    """Results by similarity or latency (null as 0), then by the given order."""
    key = F.coalesce(column, F.lit(0.0))
    return df.orderBy(key.desc() if descending else key.asc(), order)


def display_rows(df: DataFrame) -> DataFrame:
    """What a results table shows: texts cut at 80, 60 and 80 characters, a dash for no expected answer or similarity."""
    expected = F.substring("expected_answer", 1, 60)
    return df.select(
        F.substring("prompt", 1, 80).alias("prompt"),
        F.when(F.coalesce(expected, F.lit("")) == "", "—").otherwise(expected).alias("expected"),
        F.substring("model_answer", 1, 80).alias("model_answer"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        text.percent(F.col("similarity")).alias("similarity_text"),
        text.symbol(F.col("passed")).alias("result"),
        "latency_s",
    )


def failures_first(df: DataFrame, order: str, descending: bool = False) -> DataFrame:
    """Failures before passes, each by similarity (null as 0), then by the given order."""
    s = F.coalesce("similarity", F.lit(0.0))
    return explained(df).orderBy("passed", s.desc() if descending else s.asc(), order)
