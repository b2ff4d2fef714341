"""The evaluation pipeline: three result sets aligned and scored; simulated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import text
from evalweave.functions.scores import r3, simulated_trust, trust_score
from evalweave.operators import analytics, leaderboard

SCORES = ("correctness", "relevance", "clarity", "safety")
LABELS = ("Grounded", "Possible Hallucination", "Likely Hallucination")
#: Rows that a window numbers at once, about.
ROWS = 1_000_000


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("hallucination", text.hallucination_label(F.col("response")))


def _unit(key: str, salt: str, seed: int) -> Column:
    """A number in 0..1 from the md5 of a key, the same in any engine."""
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f"|{salt}|{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def judged(df: DataFrame, seed: int = 0) -> DataFrame:
    """Stand-in judge: four scores in 0.6..1.0 from a hash of the id, whatever the order of rows."""
    return df.withColumns({c: F.lit(0.6) + _unit("id", c, seed) * F.lit(0.4) for c in SCORES})


def simulated(df: DataFrame, model: str, runs: int, seed: int = 0) -> DataFrame:
    """`runs` rows made from the prompts in turn, with hashed scores in 0.5..1.0; synthetic prompts if there are none."""
    rows = repeated(df.select("id", "category", "prompt"), "id", runs)
    rows = rows.withColumns({c: r3(F.lit(0.5) + _unit("run", c, seed) * F.lit(0.5)) for c in SCORES}).withColumn("model", F.lit(model))
    label = F.element_at(F.array(*(F.lit(x) for x in LABELS)), (F.floor(_unit("run", "label", seed) * F.lit(3.0)) + 1).cast("int"))
    return rows.withColumn("hallucination", label).withColumn("trust_score", simulated_trust(*(F.col(c) for c in SCORES)))


def repeated(df: DataFrame, order: str, runs: int) -> DataFrame:
    """`runs` rows, numbered by run from 0, taken round and round in the given order."""
    n = df.count()
    many = df.sparkSession.range(runs).select(F.col("id").alias("run"))
    if not n:
        return many.select("run", F.col("run").alias("id"), F.lit("synthetic").alias("category"), F.concat(F.lit("Synthetic prompt "), F.col("run") + 1).alias("prompt"))
    few = df.orderBy(order).limit(runs) if runs < n else df  # no run reaches beyond
    return many.withColumn("turn", F.pmod("run", F.lit(n)).cast("long")).join(numbered(few, order, "turn"), "turn").drop("turn")


def numbered(df: DataFrame, order: str, name: str, rows_each: int = ROWS) -> DataFrame:
    """df with the place of each row, from 0, by a unique numeric column.

    The column's range is cut in equal cells, whose counts are summed up to give each cell its first place;
    rows are then numbered within cells, so that no window holds the whole table. Null comes first.
    """
    rows, least, most = df.agg(F.count("*"), F.min(order), F.max(order)).first()
    if rows <= rows_each or least is None:
        return df.withColumn(name, F.row_number().over(Window.orderBy(order)).cast("long") - 1)
    cells = 16 * -(-rows // rows_each)
    width = (most - least + 1) / cells
    placed = df.withColumn("cell", F.coalesce(F.floor((F.col(order) - F.lit(least)) / F.lit(float(width))), F.lit(-1)))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("cell").count().select("cell", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("base"))  # a row a cell
    within = F.row_number().over(Window.partitionBy("cell").orderBy(order)) - 1
    return placed.withColumn(name, within).join(base, "cell").withColumn(name, (F.col(name) + F.col("base")).cast("long")).drop("cell", "base")


def merged(hallucination: DataFrame, judge: DataFrame, injection: DataFrame, ordinal: str, model: str) -> DataFrame:
    """The three sets joined by an ordinal (two equi-joins), with the trust score; sets of different lengths are an error."""
    same_length(hallucination, judge, injection)
    three = hallucination.join(judge.select(ordinal, *SCORES), ordinal).join(injection.select(ordinal, "prompt_type"), ordinal)
    tool = F.col("tool_accuracy") if "tool_accuracy" in hallucination.columns else None
    return three.withColumn("model", F.lit(model)).withColumn("trust_score", trust_score(F.col("hallucination"), *(F.col(c) for c in SCORES), tool))


def same_length(*frames: DataFrame) -> None:
    counts = [f.count() for f in frames]
    if len(set(counts)) > 1:
        raise ValueError(f"result sets of different lengths: {counts}")


def evaluation_run(results: DataFrame, prompts: DataFrame, model: str, judge=judged, order: str = "id") -> dict[str, DataFrame]:
    """The five stages over results (id, response, ...) and the prompts (id, prompt) of an injection test.

    Gives injection, hallucination, judged, results and leaderboard by name. The two tables have ids of their own and
    are aligned by position; their lengths must be equal. judge adds the four scores.
    """
    injection = prompts.select(order, "prompt", text.injection_label(F.col("prompt")).alias("prompt_type"))
    made = {"injection": injection, "hallucination": labelled(results), "judged": judge(results)}
    at = "ordinal"
    three = [numbered(made[k], order, at) for k in ("hallucination", "judged", "injection")]
    made["results"] = merged(three[0].drop(*SCORES), three[1], three[2], at, model).drop(at)
    made["leaderboard"] = leaderboard.model_scores(made["judged"].withColumn("model", F.lit(model)))
    made["trust"] = analytics.trust_by_model(made["results"])
    return made
