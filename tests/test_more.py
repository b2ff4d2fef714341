"""The smaller functions, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from evalweave.functions import scores, text
from evalweave.operators import analytics, failures, leaderboard, pipeline, retrieval
from evalweave.sources import export, tables
from evalweave.streaming import metrics


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_names_and_labels(spark):
    c = F.col("p")
    assert one(spark, "p string", ("/a/b.json.csv",), text.file_name(c), text.dataset_name(c)) == ("b.json.csv", "b")
    assert one(spark, "s string, k long, p int", (None, 3, None), text.source_label(F.col("s"), F.col("k"), F.col("p")))[0] == "? – chunk 3, page ?"
    assert one(spark, "p string", ("x" * 600,), F.length(text.shortened(c, 500, "")), F.length(text.shortened(c, 55)))[0:2] == (500, 56)
    assert one(spark, "t timestamp", (__import__("datetime").datetime(2024, 1, 2, 3, 4, 5),), text.timestamp_text(F.col("t")), text.iso_text(F.col("t"))) == ("2024-01-02 03:04:05", "2024-01-02T03:04:05.000000")
    assert one(spark, "b boolean, x double", (None, None), text.symbol(F.col("b")), text.percent(F.col("x"))) == ("Fail", "—")
    assert text.route_pattern(("a.b", "c")) == r"(^|[^\p{L}\p{N}_])(a\.b|c)"


def test_why_failed(spark):
    rows = [("red apple", "green pear", 0.1), ("red apple", "red pear", 0.1), ("a", "a", 0.3), ("a", "a", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "e string, a string, s double").select(text.why_failed(F.col("e"), F.col("a"), F.col("s"))).collect()]
    assert got[0].startswith("No word in common") and got[1] == text.REASONS[3] + " (10%)" and got[2:] == [text.REASONS[4], text.REASONS[2]]


def test_similarity_of_unit_vectors(spark):
    got = one(spark, "a array<double>, b array<double>", ([1.0, 0.0], [0.6, 0.8]), retrieval.similarity_of(F.col("a"), F.col("b")), scores.distance_to_similarity(F.lit(3.0)))
    assert got == (0.6, 0.0)


def test_history(spark):
    rows = [(k, q) for k, q in enumerate("aabbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbcda")]
    df = spark.createDataFrame([*rows, (99, None), (100, None)], "k long, query string")
    assert [r["query"] for r in analytics.history(df, "k", 4).collect()] == [None, "a", "d", "c"]
    assert [r["query"] for r in analytics.history(df, "k", 9).collect()] == [None, "a", "d", "c", "b", "a"]


def test_pages_of_any_number(spark):
    for number, want in ((1, range(10)), (2, range(10, 20)), (3, range(20, 25)), (99, range(20, 25)), (0, range(10)), (None, range(20, 25))):
        got = analytics.page(spark.range(25), "id", number).orderBy("row_no").collect()
        assert [(r["id"], r["row_no"]) for r in got] == [(k, k + 1) for k in want]


def test_filters(spark):
    df = spark.createDataFrame([(" p ", " e "), ("  ", "e"), (None, "e")], "prompt string, expected_answer string")
    assert [tuple(r) for r in analytics.without_blank_prompts(df).collect()] == [("p", "e")]
    batch = spark.createDataFrame([(1, "a", 0.1, 3.0), (2, "[error]", None, 1.0), (3, "b", 0.9, 2.0)], "id long, model_answer string, similarity double, latency_s double")
    assert analytics.of_category(df.withColumn("category", F.lit("x")), "All").count() == 3
    assert [r["id"] for r in failures.by_number(batch, "similarity", "id").collect()] == [2, 1, 3]
    assert [r["id"] for r in failures.by_number(batch, "latency_s", "id", True).collect()] == [1, 3, 2]
    assert failures.with_reason(batch, text.REASONS[0]).first()["id"] == 2 and failures.with_reason(batch).count() == 3
    assert analytics.scored(batch).count() == 2 and analytics.first_with(batch, "similarity", 0.9, "id").first()["id"] == 3


def test_display_rows(spark):
    df = spark.createDataFrame([("p" * 99, "", "m" * 99, None, None, 1.0), ("p", "e" * 99, "m", 0.5, True, 1.0)], "prompt string, expected_answer string, model_answer string, similarity double, passed boolean, latency_s double")
    a, b = failures.display_rows(df).collect()
    assert (len(a["prompt"]), a["expected"], len(a["model_answer"]), a["similarity"], a["similarity_text"], a["result"]) == (80, "—", 80, 0.0, "—", "Fail")
    assert (len(b["expected"]), b["similarity_text"], b["result"]) == (60, "50.00%", "Pass")


def test_standard_entries(spark):
    df = spark.createDataFrame([("m", 0.5), ("m", 0.7), (None, 1.0)], "model string, trust_score double")
    got = leaderboard.standard_entries(df, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["model"], r["dataset"], round(r["accuracy"], 9), r["total"], r["passed"]) for r in got] == [("m", "standard", 0.6, 2, 0)]


def test_projects_and_datasets(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"projects": [{"id": "1", "name": "A", "description": "", "categories": ["x", "y"]}]}))
    assert sorted(map(tuple, tables.read_projects(spark, str(tmp_path / "p.json")).collect())) == [("A", "x"), ("A", "y")]
    (tmp_path / "o.json").write_text('{"prompt": "x"}')
    with pytest.raises(ValueError):
        tables.read_dataset(spark, str(tmp_path / "o.json"))
    (tmp_path / "l.json").write_text('\n [{"prompt": "x"}, {"prompt": "y", "expected_answer": "z"}]')
    assert tables.read_dataset(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "b.csv").write_bytes(b"prompt\nab\xffc\n")
    assert tables.read_dataset(spark, str(tmp_path / "b.csv")).first()["prompt"] == "ab�c"
    with pytest.raises(ValueError):
        tables.read_dataset(spark, str(tmp_path / "x.txt"))


def test_agent_cases(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_agent_cases(spark, str(tmp_path / "none.json"))
    (tmp_path / "c.json").write_text("[]")
    assert tables.read_agent_cases(spark, str(tmp_path / "c.json")).count() == 0
    assert tables.module_catalog(spark).count() == 4


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", "e", "m", None, False), (2, "q", "e", "m", 0.5, True)], "id long, prompt string, expected_answer string, model_answer string, similarity double, passed boolean")
    export.write_csv(df, str(tmp_path / "csv"))
    assert {r["Similarity"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"0.00%", "50.00%"}
    export.write_json(df, "id", "set", F.lit("2024-01-01").cast("timestamp"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/metadata")).first()["failed"] == 1
    assert [r["similarity"] for r in spark.read.json(str(tmp_path / "json/results")).orderBy("id").collect()] == [None, 0.5]
    for _ in range(2):
        tables.overwrite(df, str(tmp_path / "t"))
    tables.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    report = analytics.agent_report(spark.createDataFrame([("q", "a", "a", True, "r")], "query string, expected_tool string, tool_used string, correct boolean, response string"))
    tables.write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["results"][0]["tool_used"] == "a"
    assert tables.table_or_none(spark, "no_such_table") is None
    assert tables.with_columns(df, "PROMPT string, other int").columns == ["PROMPT", "other"]


def test_ingested_counts(spark):
    pages = spark.createDataFrame([("a", 0, "x", None), ("a", 1, "y", None), ("b", None, None, "bad")], "source string, page int, text string, error string")
    assert sorted(map(tuple, retrieval.ingested(pages).collect())) == [("a", 2, None), ("b", 0, "bad")]


def test_embedding_is_stable(spark):
    df = retrieval.embedded(spark.createDataFrame([("a b",), ("b a",), (None,)], "text string"), retrieval.HashEmbedder)
    a, b, none = (r["embedding"] for r in df.collect())
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and not any(none)


def test_chunk_overlap():
    text = " ".join(f"w{k}" for k in range(60))
    parts = retrieval.split_recursively(text, 50, 20)
    words = [p.split() for p in parts]
    for a, b in zip(words, words[1:], strict=False):
        shared = [w for w in a if w in b]
        assert shared == a[len(a) - len(shared) :] == b[: len(shared)] and 0 < len(" ".join(shared)) <= 20
    assert retrieval.split_recursively("a\n\nb\nc d", 3, 0) == ["a", "b", "c d"]


def test_labelled_and_judged(spark):
    df = spark.createDataFrame([(1, "x"), (None, "experts believe")], "id long, response string")
    assert [r["hallucination"] for r in pipeline.labelled(df).collect()] == ["Grounded", "Possible Hallucination"]
    assert all(0.6 <= r[c] <= 1.0 for r in pipeline.judged(df).collect() for c in pipeline.SCORES)


def test_streamed_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = metrics.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == metrics.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
