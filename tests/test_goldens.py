"""Values known from earlier runs of the evaluation: agent cases, labels, leaderboard, merged trust, a batch of twenty."""

import pytest
from pyspark.sql import functions as F

from evalweave.functions import text
from evalweave.operators import analytics, failures, leaderboard, pipeline, retrieval

CASES = [
    ("Check my PTO balance", "workday_api"),
    ("How many vacation days do I have left?", "workday_api"),
    ("I need to request time off next week", "workday_api"),
    ("Create HR ticket for laptop issue", "servicenow_api"),
    ("Submit a support request for my broken keyboard", "servicenow_api"),
    ("Which policy covers paid leave?", "policy_retriever"),
]


def test_agent_cases(spark):
    cases = spark.createDataFrame(CASES, "query string, expected_tool string")
    made = cases.withColumn("tool", text.route(F.col("query"))).withColumn("answer", text.tool_answer(F.col("tool")))
    got = {r["query"]: r for r in made.collect()}
    assert all(r["tool"] == r["expected_tool"] for r in got.values())
    assert got[CASES[0][0]]["answer"] == "Your PTO balance is 12 days."
    assert got[CASES[3][0]]["answer"] == "A support ticket has been created (INC0012345)."


def test_agent_report(spark):
    class Agent:
        def run(self, query):
            low = f" {query.lower()}"
            tool = next((t for t, words in text.ROUTES if any(f" {w}" in low for w in words)), None)
            return {"tool_used": tool, "response": text.ANSWERS[tool]} if tool else {}

    cases = spark.createDataFrame([*CASES[:2], ("hello", "workday_api"), ("?", "unknown")], "query string, expected_tool string")
    r = analytics.agent_report(retrieval.agent_results(cases, Agent)).first()
    assert (r["tool_accuracy"], r["total_tests"], r["passed_tests"]) == (0.75, 4, 3)
    assert r["results"][1]["query"] == CASES[0][0] and {x["tool_used"] for x in r["results"]} == {"unknown", "workday_api"}
    none = analytics.agent_report(retrieval.agent_results(cases.limit(0), Agent)).first()
    assert tuple(none) == (0.0, 0, 0, [])


def test_leaderboard_rounds_rows_first(spark):
    # rows of .83 .91 .78 .90 .82 give .85
    rows = [("m", s, s, s, s) for s in (0.83, 0.91, 0.78, 0.90, 0.82)]
    df = spark.createDataFrame(rows, "model string, correctness double, relevance double, clarity double, safety double")
    assert leaderboard.model_scores(df).first()["score"] == 0.85


def test_batch_of_twenty(spark):
    passing, failing = [0.7983, 0.55, *[0.65] * 13], [0.54, 0.5, 0.45, 0.41, 0.3306]
    df = failures.explained(spark.createDataFrame([("a", s, 61.41) for s in passing + failing], "model_answer string, similarity double, latency_s double"))
    r = analytics.batch_summary(df).first()
    assert (r["total"], r["passed"], r["pass_rate"], r["average_latency"]) == (20, 15, 0.75, 61.41)
    assert r["hallucination_rate"] == pytest.approx(1 - r["average_similarity"], abs=1e-4)
    assert sorted((x["reason"], x["severity"]) for x in df.filter("NOT passed").collect()) == sorted([(text.REASONS[5], "Medium")] * 4 + [(text.REASONS[4], "Critical")])


def test_evaluation_run(spark):
    cue = text.CUES
    results = spark.createDataFrame([(10, "fine"), (20, f"{cue[0]} and {cue[1]}"), (30, " ".join(cue[:3]))], "id long, response string")
    prompts = spark.createDataFrame([(7, "hi"), (5, "please jailbreak it"), (9, None)], "id long, prompt string")

    def judge(df):
        return df.withColumns({c: F.lit(0.8) for c in pipeline.SCORES})

    made = pipeline.evaluation_run(results, prompts, "phi3", judge)
    got = {r["id"]: (r["prompt_type"], r["hallucination"], r["trust_score"], r["model"]) for r in made["results"].collect()}
    assert got == {10: ("Injection", "Grounded", 0.84, "phi3"), 20: ("Normal", "Possible Hallucination", 0.74, "phi3"), 30: ("Normal", "Likely Hallucination", 0.64, "phi3")}
    assert made["leaderboard"].first()["score"] == 0.8 and made["trust"].first()["trust"] == 0.74
    with pytest.raises(ValueError):
        pipeline.evaluation_run(results, prompts.limit(2), "phi3", judge)


def test_numbered_in_cells(spark):
    df = spark.createDataFrame([(x * x,) for x in range(500)] + [(None,)], "k long")
    got = {r["k"]: r["n"] for r in pipeline.numbered(df, "k", "n", rows_each=20).collect()}
    assert got == {None: 0, **{x * x: x + 1 for x in range(500)}}
    assert pipeline.numbered(df.limit(0), "k", "n").count() == 0


def test_batch_run(spark):
    prompts = spark.createDataFrame([(1, " red apples ", "red apples"), (2, "boom", "x"), (3, "green pears", None), (4, "  ", "x"), (5, None, "x")], "id long, prompt string, expected_answer string")
    pages = spark.createDataFrame([("f.pdf", 0, 0, "red apples grow here"), ("f.pdf", 1, 0, "green pears grow there"), (None, 2, 0, "nothing")], "source string, page int, pos int, text string")

    class Model:
        def generate(self, prompt):
            if "boom" in prompt:
                raise RuntimeError("down")
            return "red apples"

    chunks = retrieval.embedded(retrieval.indexed_chunks(pages), retrieval.HashEmbedder)
    got = {r["id"]: r for r in retrieval.batch_run(prompts, chunks, retrieval.HashEmbedder, Model, "m", 2).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["similarity"] == 1.0 and got[1]["passed"] and got[1]["sources"][0] == "f.pdf – chunk 0, page 0" and len(got[1]["sources"]) == 2
    assert got[2]["model_answer"] == "[ERROR] down" and got[2]["similarity"] is None and not got[2]["passed"] and got[2]["latency_s"] == 0 and got[2]["sources"] == []
    assert got[3]["similarity"] is None and not got[3]["passed"] and got[3]["model"] == "m"
    none = retrieval.batch_run(prompts.filter("id = 1"), chunks.limit(0), retrieval.HashEmbedder, Model, "m").first()
    assert none["model_answer"] == retrieval.NOTHING_FOUND and none["sources"] == []


def test_scores_rank_before_rounding_and_clamp(spark):
    near = [(1, [0.9999, 0.01414]), (2, [0.99991, 0.0134]), (3, [-1.0, 0.0])]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    c = spark.createDataFrame(near, "chunk_id long, v array<double>")
    got = retrieval.nearest_chunks(q, c, 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(2, 0.9999), (1, 0.9999), (3, 0.0)]


def test_prompts(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, question string")
    rows = spark.createDataFrame([(1, 2, "b.pdf", None, "second"), (1, 1, None, 4, "first")], "query_id long, rank long, source string, page int, text string")
    got = {r["query_id"]: r["prompt"] for r in retrieval.assembled(q, retrieval.context_blocks(rows), "C:{context} Q:{question}!").collect()}
    assert got == {1: "C:[1] (Source: unknown, Page: 4)\nfirst\n\n[2] (Source: b.pdf, Page: ?)\nsecond Q:why?!", 2: None}
