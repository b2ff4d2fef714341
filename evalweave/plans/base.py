"""The view that the registered queries share: documents with labels, and scores made of doc_id by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import scores, text

#: Patterns that occur in the generated tables, as the usual lists don't.
CUES = ("license", "copyright", "apache", "%%%", "***", "!!", "idiot", "thation")
MARKS = ("mit license", "apache license", "idiot", "&&&")
ROUTES = (("alpha", ("que", "der")), ("beta", ("ti", "license")), ("gamma", ("wh", "er")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def score(factor: int, modulus: int = 1000, key: str = "id") -> Column:
    return F.pmod(F.col(key) * factor, F.lit(modulus)).cast("double") / F.lit(float(modulus))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores before labels: a plan that needs no label has no join, and one that needs no text doesn't send it through one."""
    df = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("model"), F.col("text").alias("response"))
    df = df.withColumns(
        {
            "correctness": score(37),
            "relevance": score(91),
            "clarity": score(53),
            "safety": score(71),
            "tool_accuracy": F.when(F.col("id") % 3 != 0, score(17, 100)),
            "similarity": F.when(F.col("id") % 11 != 0, score(29)),
            "latency_s": score(13, 9000) * 90.0,
            "hallucination": text.hallucination_label(F.col("response"), CUES),
        }
    )
    df = df.withColumn("trust_score", scores.trust_score(*(F.col(c) for c in ("hallucination", "correctness", "relevance", "clarity", "safety"))))
    # one row a document, the worst of its labels: the optimizer drops the join where its columns aren't used
    worst = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("label_id")).agg((F.max("toxic") == 1).alias("safety_violation"), (F.min("quality") == 1).alias("factual_correct"))
    return df.join(worst, df["id"] == worst["label_id"], "left").drop("label_id")


def _sql_score(factor: int, modulus: int = 1000) -> str:
    return f"(CAST((id * {factor}) % {modulus} AS DOUBLE) / {float(modulus)}::DOUBLE)"


def sql_round(x: str, places: int) -> str:
    scale = f"{float(10**places)}::DOUBLE"
    return f"(floor(({x}) * {scale} + 0.5::DOUBLE) / {scale})"


_COUNT = " + ".join(f"CAST(contains(lower(response), '{c}') AS INTEGER)" for c in CUES)
_GROUND = "CASE hallucination WHEN 'Grounded' THEN 1.0::DOUBLE WHEN 'Likely Hallucination' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END"
TOTAL = "(correctness + relevance + clarity + safety)"

BASE = f"""
raw AS (SELECT d.doc_id AS id, d.lang AS category, d.source AS model, d.text AS response, l.toxic = 1 AS safety_violation, l.quality = 1 AS factual_correct
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
scored AS (SELECT *, {_sql_score(37)} AS correctness, {_sql_score(91)} AS relevance, {_sql_score(53)} AS clarity, {_sql_score(71)} AS safety,
  CASE WHEN id % 3 <> 0 THEN {_sql_score(17, 100)} END AS tool_accuracy, CASE WHEN id % 11 <> 0 THEN {_sql_score(29)} END AS similarity,
  {_sql_score(13, 9000)} * 90.0::DOUBLE AS latency_s, {_COUNT} AS cues FROM raw),
named AS (SELECT *, CASE WHEN cues = 0 THEN 'Grounded' WHEN cues <= 2 THEN 'Possible Hallucination' ELSE 'Likely Hallucination' END AS hallucination FROM scored),
base AS (SELECT *, {_GROUND} AS grounded, {sql_round(f"({_GROUND} + {TOTAL}) / 5.0::DOUBLE", 3)} AS trust_score FROM named)
"""
