import json

import pytest
from pyspark.sql import functions as F

from evalweave.operators import analytics, failures, leaderboard, pipeline, retrieval
from evalweave.sources import export, tables


def test_pages(spark):
    for n, pages in ((0, 0), (10, 1), (11, 2)):
        got = analytics.page(spark.range(n), "id").collect()
        assert {r["page"] for r in got} == ({pages} if pages else set())
        assert len(got) == (n - 1) % 10 + 1 if n else not got


def test_batch_summary_without_scores(spark):
    df = spark.createDataFrame([(None, False, 1.0), (None, False, 2.0)], "similarity double, passed boolean, latency_s double")
    r = analytics.batch_summary(df).first()
    assert (r["hallucination_rate"], r["average_similarity"], r["average_latency"]) == (0.0, 0.0, 1.5)


def test_null_label_isn_t_grounded(spark):
    df = spark.createDataFrame([("Grounded",), (None,)], "hallucination string")
    assert analytics.hallucination_rate(df).first()[0] == 0.5


def test_best_entry_is_the_most_accurate(spark):
    df = spark.createDataFrame([("m", "d", 0.9, 1), ("m", "d", 0.5, 2)], "model string, dataset string, accuracy double, timestamp long")
    assert [tuple(r) for r in leaderboard.best_entries(df).collect()] == [("m", "d", 0.9, 1)]


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "model string, dataset string, total long")
    new = spark.createDataFrame([("b", "x", 9), ("c", "x", 3)], "model string, dataset string, total long")
    assert {tuple(r) for r in leaderboard.upserted(old, new).collect()} == {("a", "x", 1), ("b", "x", 9), ("c", "x", 3)}


def test_severity_order(spark):
    rows = [(1, "x", 0.1), (2, "not have enough information", 0.1), (3, "x", 0.5)]
    df = spark.createDataFrame(rows, "id long, model_answer string, similarity double")
    assert [r["id"] for r in failures.by_severity(df, "id").collect()] == [2, 3, 1]


def test_repeated_without_prompts_is_synthetic(spark):
    empty = spark.createDataFrame([], "id long, category string, prompt string")
    assert pipeline.simulated(empty, "m", 3).count() == 3
    with pytest.raises(ValueError):
        pipeline.same_length(spark.range(2), spark.range(3))


def test_split_recursively():
    text = "a" * 30 + "\n\n" + "b c " * 40
    parts = retrieval.split_recursively(text, 50, 10)
    assert all(len(p) <= 50 for p in parts) and parts[0] == "a" * 30
    assert retrieval.split_recursively("", 50, 10) == []
    assert "".join(retrieval.split_recursively("x" * 120, 50, 0)) == "x" * 120


def test_chunks_are_numbered_over_the_source(spark):
    df = spark.createDataFrame([("s", 0, "one " * 300), ("s", 1, "two")], "source string, page int, text string")
    got = retrieval.indexed_chunks(retrieval.recursive_chunks(df)).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and got[-1]["text"] == "two"


def test_grounding_without_documents(spark):
    df = spark.createDataFrame([(1, [1.0], [1.0], None)], "query_id long, q array<double>, answer array<double>, v array<double>")
    assert tuple(retrieval.grounding(df).first()) == (1, 0.0, 0.0, 1.0)


def test_generator_errors_are_rows(spark):
    class Failing:
        def generate(self, prompt):
            raise RuntimeError("down")

    df = spark.createDataFrame([(1, "hi"), (2, "")], "query_id long, prompt string")
    got = {r["query_id"]: r for r in retrieval.answered(df, Failing).collect()}
    assert got[1]["answer"] == "[ERROR] down" and got[2]["answer"] == retrieval.NOTHING_FOUND


def test_readers(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps([{"id": 1, "category": "a", "prompt": "x"}, {"id": 2, "category": "b", "prompt": "y"}]))
    assert tables.read_prompts(spark, str(path), "b").first()["id"] == 2
    assert tables.read_json(spark, str(tmp_path / "none.json"), "id long").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_json(spark, str(tmp_path / "none.json"), "id long", missing_ok=False)
    csv = tmp_path / "d.CSV"
    csv.write_text('prompt,expected_answer\n"a, ""b""\nc",d\n')
    assert tables.read_dataset(spark, str(csv)).first()["prompt"] == 'a, "b"\nc'
    bad = tmp_path / "bad.csv"
    bad.write_text("x\n1\n")
    with pytest.raises(ValueError):
        tables.read_dataset(spark, str(bad))


def test_upsert_chunks_adds_nothing_twice(spark, tmp_path):
    df = spark.createDataFrame([("a", "t"), ("b", "u")], "chunk_id string, text string")
    for _ in range(2):
        tables.upsert_chunks(spark, df, str(tmp_path / "c"))
    assert tables.open_chunks(spark, str(tmp_path / "c")).count() == 2
    assert tables.drop_store(spark, str(tmp_path / "c"))


def test_bad_files_are_rows(spark, tmp_path):
    (tmp_path / "good.txt").write_bytes(b"p1|p2")
    (tmp_path / "bad.txt").write_bytes(b"\xff")
    got = tables.read_binary_pages(spark, str(tmp_path), lambda b: b.decode().split("|")).collect()
    assert sorted((r["source"], r["page"], r["error"]) for r in got if r["error"] is None) == [("good.txt", 0, None), ("good.txt", 1, None)]
    assert [r["source"] for r in got if r["error"]] == ["bad.txt"]


def test_exports(spark):
    df = spark.createDataFrame([(1, "p", "e", "m" * 400, None, False), (2, "q", "e", "m", 0.5, True)], "id long, prompt string, expected_answer string, model_answer string, similarity double, passed boolean")
    assert export.csv_rows(df).select("Similarity").first()[0] == "0.00%"
    meta = export.json_metadata(df, "set", F.lit("2024-01-01").cast("timestamp")).first()
    assert (meta["total"], meta["passed"], meta["generated_at"]) == (2, 1, "2024-01-01T00:00:00.000000") and export.json_rows(df, "id").first()["similarity"] is None
    r = export.printed_rows(df, "id").first()
    assert len(r["model_answer"]) == 301 and r["similarity"] == "—"


def test_project_filter(spark):
    df = spark.createDataFrame([("en",), ("fr",)], "category string")
    projects = spark.createDataFrame([("P", "en")], "project string, category string")
    assert analytics.of_project(df, projects, "P").count() == 1
    assert analytics.of_project(df, projects, "All Projects").count() == analytics.of_project(df, projects, "none").count() == 2
    assert analytics.searched(df.withColumn("c", F.lit("a%b")), "c", "A%").count() == 2
