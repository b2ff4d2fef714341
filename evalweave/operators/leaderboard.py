"""The leaderboard: keyed entries, their upsert, standard entries and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.scores import leaderboard_score, r2
from evalweave.operators.analytics import NUDGE

KEY = ["model", "dataset"]


def model_scores(df: DataFrame) -> DataFrame:
    """Mean of the rows' rounded scores, rounded again; 0 without rows."""
    score = leaderboard_score(*(F.col(c) for c in ("correctness", "relevance", "clarity", "safety")))
    return df.withColumn("score", score).groupBy("model").agg(F.coalesce(r2(F.avg("score") + NUDGE), F.lit(0.0)).alias("score"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those of the same model and dataset."""
    values = [c for c in old.columns if c not in KEY]
    both = old.withColumn("in_old", F.lit(True)).alias("o").join(new.withColumn("in_new", F.lit(True)).alias("n"), KEY, "full_outer")
    return both.select(*KEY, *(F.when(F.col("in_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values))


def standard_entries(df: DataFrame, at: Column) -> DataFrame:
    """The standard entry of each model: its mean trust as accuracy, all its rows, none passed."""
    of = df.filter("model IS NOT NULL").groupBy("model").agg(F.avg("trust_score").alias("accuracy"), F.count("*").alias("total"))
    return of.select("model", F.lit("standard").alias("dataset"), "accuracy", "total", F.lit(0).cast("long").alias("passed"), at.alias("timestamp"))


def with_standard(entries: DataFrame, standard: DataFrame) -> DataFrame:
    """entries and the standard rows of models that have no standard entry."""
    have = entries.filter("dataset = 'standard'").select("model").distinct()
    return entries.unionByName(standard.join(have, "model", "left_anti"))


def best_entries(entries: DataFrame) -> DataFrame:
    """Of each model and dataset the most accurate entry, the newest among equals, best first."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("accuracy"), F.desc("timestamp"))
    return entries.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place").orderBy(F.desc("accuracy"), F.desc("timestamp"))
