"""Exports of batch results: the query part of CSV, JSON and printed reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import iso_text, percent, shortened, symbol


def csv_rows(df: DataFrame) -> DataFrame:
    """Rows for a CSV file; a null similarity is written as 0.00%."""
    share = percent(F.coalesce("similarity", F.lit(0.0)))
    return df.select(F.col("prompt").alias("Prompt"), F.col("expected_answer").alias("Expected Answer"), F.col("model_answer").alias("Model Answer"), share.alias("Similarity"), symbol(F.col("passed")).alias("Result"))


def write_csv(df: DataFrame, path: str) -> None:
    csv_rows(df).write.mode("overwrite").option("header", True).csv(path)


def json_metadata(df: DataFrame, dataset: str, generated_at: Column) -> DataFrame:
    """One row: what a report says of a whole set of results."""
    return df.agg(F.lit(dataset).alias("dataset"), iso_text(generated_at).alias("generated_at"), F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def json_rows(df: DataFrame, order: str) -> DataFrame:
    """The results of a report; a similarity of null or 0 is null."""
    similarity = F.when(F.col("similarity") != 0, F.col("similarity"))
    return df.select(order, "prompt", "expected_answer", "model_answer", similarity.alias("similarity"), "passed")


def write_json(df: DataFrame, order: str, dataset: str, generated_at: Column, path: str) -> None:
    """A report of any size: JSON lines below path/metadata and, in order, below path/results."""
    json_metadata(df, dataset, generated_at).write.mode("overwrite").json(f"{path}/metadata")
    json_rows(df, order).orderBy(order).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/results")


def printed_rows(df: DataFrame, order: str, rows: int = 50, width: int = 300) -> DataFrame:
    """The first rows with trimmed texts cut to a width; a null similarity is a dash."""
    first = df.orderBy(order).limit(rows)
    texts = {c: shortened(F.trim(c), width) for c in ("prompt", "expected_answer", "model_answer")}
    return first.withColumns(texts).withColumn("similarity", percent(F.col("similarity")))
