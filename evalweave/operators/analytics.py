"""Filters, roll-ups, orders and pages over evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.scores import r2, r3, r4

#: Added to a mean before it is rounded, so that ties don't hang on the order of summing.
NUDGE = 1e-9


def mean3(c: str) -> Column:
    return F.coalesce(r3(F.avg(c) + NUDGE), F.lit(0.0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def not_grounded() -> Column:
    """A null label counts as not grounded."""
    return ~F.col("hallucination").eqNullSafe("Grounded")


def low_trust(df: DataFrame, below: float = 0.6) -> DataFrame:
    return df.filter(F.col("trust_score") < below)


def of_category(df: DataFrame, category: str) -> DataFrame:
    return df if category == "All" else df.filter(F.col("category") == category)


def of_project(df: DataFrame, projects: DataFrame, name: str | None) -> DataFrame:
    """Rows of a project's categories; no project, or one without categories, doesn't filter."""
    if name in (None, "All Projects"):
        return df
    wanted = projects.filter(F.col("project") == name).select("category")
    return df if wanted.isEmpty() else df.join(wanted, "category", "left_semi")


def searched(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows that contain a literal text, in any case; a blank text doesn't filter."""
    return df.filter(F.lower(F.col(column)).contains(text.lower())) if text.strip() else df


def without_blank_prompts(df: DataFrame) -> DataFrame:
    """Prompts and expected answers trimmed; rows with a blank or null prompt go."""
    return df.withColumn("prompt", F.trim("prompt")).withColumn("expected_answer", F.trim("expected_answer")).filter(F.length("prompt") > 0)


def average_trust(df: DataFrame) -> DataFrame:
    return df.agg(mean3("trust_score").alias("average_trust"))


def average_safety(df: DataFrame) -> DataFrame:
    return df.agg(mean3("safety").alias("average_safety"))


def hallucination_rate(df: DataFrame) -> DataFrame:
    return df.agg(r3(_ratio(F.count_if(not_grounded()), F.count("*"))).alias("hallucination_rate"))


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("prompts"),
        F.coalesce(r2(F.avg("trust_score") + NUDGE), F.lit(0.0)).alias("average_trust"),
        F.countDistinct("model").alias("models"),
        F.count_if(F.col("safety_violation")).alias("violations"),
    )


def trust_by_model(df: DataFrame) -> DataFrame:
    return df.filter("model IS NOT NULL").groupBy("model").agg(mean3("trust_score").alias("trust"))


def trust_heatmap(df: DataFrame, categories: list[str]) -> DataFrame:
    """Mean trust, a row for each model and a column for each of the given categories."""
    return df.filter("model IS NOT NULL").groupBy("model").pivot("category", categories).agg(r3(F.avg("trust_score") + NUDGE))


def failing_by_category(df: DataFrame, below: float = 0.6) -> DataFrame:
    return low_trust(df, below).groupBy("category").agg(F.count("*").alias("failing")).orderBy(F.desc("failing"), "category")


def trust_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    bin_of = F.least(F.floor(F.col("trust_score") * float(bins)), F.lit(bins - 1)).cast("int")
    return df.filter("trust_score IS NOT NULL").groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))


def tool_accuracy(df: DataFrame) -> DataFrame:
    return df.groupBy("expected_tool").agg(
        F.count("correct").alias("total"),
        F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("passed"),
        r4(_ratio(F.sum(F.col("correct").cast("long")), F.count("correct"))).alias("accuracy"),
    )


def agent_accuracy(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_tests"),
        F.count_if("correct").alias("passed_tests"),
        r4(_ratio(F.count_if("correct"), F.count("*"))).alias("tool_accuracy"),
    )


def batch_summary(df: DataFrame) -> DataFrame:
    """Pass rate, mean similarity of scored rows, the rest of it to one (0 if the mean is 0 or nothing is scored), mean latency."""
    mean = df.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("s"),
        F.coalesce(r2(F.avg("latency_s") + NUDGE), F.lit(0.0)).alias("average_latency"),
    )
    return mean.select(
        "total",
        "passed",
        r4(_ratio(F.col("passed"), F.col("total"))).alias("pass_rate"),
        r4(F.col("s") + NUDGE).alias("average_similarity"),
        F.when(F.col("s") == 0, F.lit(0.0)).otherwise(r4(F.lit(1.0) - F.col("s") + NUDGE)).alias("hallucination_rate"),
        "average_latency",
    )


def failure_share(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(~F.col("passed")).alias("failures"),
        F.count_if("passed").alias("passes"),
        r4(_ratio(F.count_if(~F.col("passed")), F.count("*"))).alias("failure_share"),
    )


def distinct_sorted(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    return df.select(F.coalesce(F.col(column), F.lit(missing)).alias(column)).distinct().orderBy(column)


def page(df: DataFrame, order: str, number: int | None = None, size: int = 10) -> DataFrame:
    """One page by an explicit, unique order, the last by default; numbers beyond the range are clamped.

    Rows are counted first; then a bounded top-k, from the nearer end, takes the page's rows, and only they are numbered.
    """
    rows = df.count()
    last = max(1, -(-rows // size))
    at = last if number is None else min(max(number, 1), last)
    begin, end = (at - 1) * size, min(at * size, rows)
    if begin <= rows - end:
        few = df.orderBy(F.asc(order)).limit(end)
        few = few.orderBy(F.desc(order)).limit(end - begin)
    else:
        few = df.orderBy(F.desc(order)).limit(rows - begin)
        few = few.orderBy(F.asc(order)).limit(end - begin)
    placed = F.row_number().over(Window.orderBy(order)) + F.lit(begin)  # over one page
    return few.withColumn("row_no", placed.cast("long")).withColumn("page", F.lit(at))


def history(df: DataFrame, order: str, keep: int = 10) -> DataFrame:
    """The last queries by a unique order, newest first, without immediate repeats.

    The newest few rows are tried first, and more only where repeats leave fewer than `keep` of them.
    """
    rows, take = df.count(), 4 * keep
    while True:
        few = df.orderBy(F.desc(order)).limit(take)
        before = F.lag(F.struct("query")).over(Window.orderBy(order))
        new = few.withColumn("before", before).filter(F.col("before").isNull() | ~F.col("query").eqNullSafe(F.col("before.query"))).drop("before")
        # the oldest row of a part may repeat the one before it
        if take >= rows or new.count() > keep:
            return new.orderBy(F.desc(order)).limit(keep)
        take *= 4


def first_with(df: DataFrame, column: str, value: object, order: str) -> DataFrame:
    """The first row, by an order, that has a value in a column."""
    return df.filter(F.col(column) == F.lit(value)).orderBy(order).limit(1)


def scored(df: DataFrame) -> DataFrame:
    """Rows whose similarity is known."""
    return df.filter(F.col("similarity").isNotNull())


def agent_report(results: DataFrame, order: str = "query") -> DataFrame:
    """One row (tool_accuracy, total_tests, passed_tests, results) of an agent's test cases; zeros and no results without any.

    The cases are nested in the row, as a report has them; agent_accuracy() gives the figures of sets of any size.
    """
    one = F.struct(order, *(c for c in results.columns if c != order))
    nested = results.agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*(x[c].alias(c) for c in results.columns))).alias("results"))
    return agent_accuracy(results).crossJoin(nested).select("tool_accuracy", "total_tests", "passed_tests", "results")
