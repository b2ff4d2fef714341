"""Blocked search against the expression over all pairs, on odd vectors and many ties."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalweave.functions.scores import cosine
from evalweave.operators import retrieval, search
from evalweave.plans import registry


def odd_vectors():
    rng = np.random.default_rng(7)
    plain = rng.normal(size=(40, 3)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0], [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e-200, 0.0, 0.0], [1e200, 1e200, 1.0], [3e-120, 1e-120, 0.0], [1.0, 2.0], [-0.0, 0.0, -0.0]]
    return plain + odd + plain[:15] + [[-x for x in v] for v in plain[:5]] + [[x * 3 for x in v] for v in plain[5:12]] + odd[:6]


def told(rows):
    return sorted(tuple("nan" if isinstance(x, float) and np.isnan(x) else x for x in r) for r in rows)


@pytest.mark.parametrize("kind,k,rows", [("double", 4, 8), ("float", 3, 5), ("double", 90, 16)])
def test_blocks_find_what_the_expression_finds(spark, kind, k, rows):
    both = spark.createDataFrame(list(enumerate(odd_vectors())), "id long, v array<double>").select("id", F.col("v").cast(f"array<{kind}>").alias("v"))
    q = both.select(F.col("id").alias("query_id"), F.col("v").alias("q")).repartition(3)
    c = both.select(F.concat(F.lit("c"), F.pmod(F.col("id") * 37, F.lit(101)).cast("string")).alias("chunk_id"), "v").repartition(3)
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "chunk_id")
    best = lambda df: told(df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).collect())
    want = q.crossJoin(c).select("query_id", "chunk_id", cosine(F.col("q"), F.col("v")).alias("s"))
    assert best(search.candidates(q, c, k, rows)) == best(want)


def test_few_pairs_become_rows(spark):
    v = np.random.default_rng(3).normal(size=(1050, 8)).tolist()
    both = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    q, c = both.filter("id < 50").select(F.col("id").alias("query_id"), F.col("v").alias("q")), both.filter("id >= 50").select(F.col("id").alias("chunk_id"), "v")
    assert "MapInArrow" in retrieval.nearest_chunks(q, c, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert search.candidates(q, c.coalesce(1), 5).count() == 50 * 5  # one block of chunks


def test_no_vectors(spark):
    q, c = spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>"), spark.createDataFrame([(2, [1.0])], "chunk_id long, v array<double>")
    assert retrieval.nearest_chunks(q, c.limit(0)).count() == retrieval.nearest_chunks(q.limit(0), c).count() == 0
    assert tuple(retrieval.nearest_chunks(q, c).first()) == (1, 2, 1, 1.0)


@pytest.mark.parametrize("name", ["mean_similarity", "topk_cosine"])
def test_no_row_a_pair(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan and "zipwith" not in plan.lower()
