from pyspark.sql import functions as F

from evalweave.functions import scores, text


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_hallucination_label_counts_distinct_cues(spark):
    c = text.CUES
    rows = [("plain",), (c[0],), (f"{c[0]} {c[1]}",), (f"{c[0]} {c[1]} {c[2]}",), (f"{c[0]} {c[0]} {c[0]}",), (None,)]
    got = values(spark, rows, "t string", text.hallucination_label(F.col("t")))
    assert got == ["Grounded", "Possible Hallucination", "Possible Hallucination", "Likely Hallucination", "Possible Hallucination", "Grounded"]


def test_injection_label(spark):
    assert values(spark, [("Please JAILBREAK it",), ("hello",), (None,)], "t string", text.injection_label(F.col("t"))) == ["Injection", "Normal", "Normal"]


def test_route(spark):
    rows = [("my laptop broke",), ("which procedures apply",), ("hello",), ("vacation policy",), (None,)]
    assert values(spark, rows, "t string", text.route(F.col("t"))) == ["servicenow_api", "policy_retriever", "unknown", "workday_api", "unknown"]


def test_label_score(spark):
    rows = [("Grounded",), ("Possible Hallucination",), ("Likely Hallucination",), ("other",), (None,)]
    assert values(spark, rows, "t string", scores.label_score(F.col("t"))) == [1.0, 0.5, 0.0, 0.5, 0.5]


def test_trust_score_takes_the_agent_branch_for_zero(spark):
    rows = [("Grounded", 0.8, None), ("Grounded", 0.8, 0.0), ("Grounded", None, None)]
    s = F.col("s")
    assert values(spark, rows, "h string, s double, t double", scores.trust_score(F.col("h"), s, s, s, s, F.col("t"))) == [0.84, 0.63, 0.2]


def test_reason_and_severity(spark):
    rows = [("a", x) for x in (0.2499, 0.25, 0.3999, 0.40, 0.5499, 0.55, None)] + [("[ERROR] x", None), ("I do not have enough information", 0.1), ("I don't have enough information", 0.6)]
    got = values(spark, rows, "a string, s double", text.failure_reason(F.col("a"), F.col("s")))
    r = text.REASONS
    assert got == [r[3], r[4], r[4], r[5], r[5], r[6], r[2], r[0], r[1], r[6]]
    got = values(spark, rows, "a string, s double", text.failure_severity(F.col("a"), F.col("s")))
    assert got == ["Critical"] * 3 + ["Medium"] * 3 + ["Critical", "Critical", "Low", "Medium"]


def test_passed(spark):
    assert values(spark, [(0.55,), (0.5499,), (None,)], "s double", text.passed(F.col("s"))) == [True, False, False]


def test_tiers_and_badges(spark):
    rows = [(0.70,), (0.6999,), (0.40,), (0.3999,)]
    assert values(spark, rows, "s double", scores.confidence_tier(F.col("s"))) == ["High", "Medium", "Medium", "Low"]
    assert values(spark, [(0.7,), (0.4,)], "s double", scores.score_badge(F.col("s"))) == ["yellow", "red"]


def test_cosine_of_zero(spark):
    rows = [([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])]
    assert values(spark, rows, "a array<float>, b array<float>", scores.cosine(F.col("a"), F.col("b"))) == [0.0, 1.0]


def test_token_estimate(spark):
    assert values(spark, [("",), ("one",), ("one two three",), (None,)], "t string", text.token_estimate(F.col("t"))) == [1, 1, 4, 1]


def test_highlight_whole_words(spark):
    got = values(spark, [("Leaves leave (LEAVE)",)], "t string", text.highlighted(F.col("t"), "leave the"))
    assert got == ["Leaves <mark>leave</mark> (<mark>LEAVE</mark>)"]
