"""Schemas, readers and writers of evaluation tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVAL_RESULT = (
    "id long, category string, prompt string, response string, expected_answer string, safety_violation boolean, factual_correct boolean, "
    "bias_violation boolean, hallucination string, correctness double, relevance double, clarity double, safety double, prompt_type string, "
    "model string, tool_accuracy double, trust_score double"
)
BATCH_RESULT = "prompt string, expected_answer string, model_answer string, similarity double, passed boolean, latency_s double, sources array<string>"
AGENT_CASE = "query string, expected_tool string"
LEADERBOARD = "model string, dataset string, accuracy double, total long, passed long, timestamp timestamp"
CHUNK = "chunk_id string, source string, page int, chunk_index long, text string, embedding array<float>"
PROJECTS = "projects array<struct<id: string, name: string, description: string, categories: array<string>>>"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_json(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """A JSON array of records under a fixed schema; a missing file is an empty table, or an error if not missing_ok."""
    if not _exists(spark, path):
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_prompts(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    df = read_json(spark, path, "id long, category string, prompt string, expected_answer string", missing_ok=False)
    return df if category is None else df.filter(F.col("category") == category)


def read_agent_cases(spark: SparkSession, path: str) -> DataFrame:
    """An agent's test cases; a missing file is an error, an empty list an empty table."""
    return read_json(spark, path, AGENT_CASE, missing_ok=False)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded set of prompts, JSON or CSV by its suffix; a CSV needs a row and a prompt column, a JSON file a list.

    Bytes of a CSV that aren't UTF-8 are read as replacement characters.
    """
    if path.lower().endswith(".json"):
        first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value", F.lit(" \t\r\n\ufeff")), 1, 1)).first()
        if first is None or first[0] != "[":
            raise ValueError("a JSON dataset is a list of objects")
        return read_json(spark, path, "prompt string, expected_answer string", missing_ok=False)
    if not path.lower().endswith(".csv"):
        raise ValueError("a dataset is a .json or a .csv file")
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if "prompt" not in df.columns or df.isEmpty():
        raise ValueError("a CSV dataset needs a row and a prompt column")
    return with_columns(df, "prompt string, expected_answer string")


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """df with just the columns of schema, absent ones as typed nulls."""
    have = {c.lower(): c for c in df.columns}
    fields = T._parse_datatype_string(schema).fields
    return df.select(*((F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """(project, category), a row each."""
    df = spark.read.schema(PROJECTS).option("multiLine", True).json(path)
    return df.select(F.explode("projects").alias("p")).select(F.col("p.name").alias("project"), F.explode("p.categories").alias("category"))


MODULES = (
    ("Hallucination labels", "functions.text.hallucination_label", "Finds phrases that go with made-up facts in a response"),
    ("Judge", "operators.pipeline.judged", "Gives a response scores for correctness, relevance, clarity and safety"),
    ("Injection labels", "functions.text.injection_label", "Finds prompts that try to override a model's instructions"),
    ("Leaderboard", "operators.leaderboard.model_scores", "Ranks models by their mean weighted score"),
)


def module_catalog(spark: SparkSession) -> DataFrame:
    """(name, file, purpose) of the evaluation modules."""
    return spark.createDataFrame(MODULES, "name string, file string, purpose string")


def open_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A stored chunk collection; FileNotFoundError if there is none."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def read_binary_pages(spark: SparkSession, path: str, parse) -> DataFrame:
    """(source, page, text, error) of every file below path; a file that `parse` (bytes -> list of texts) rejects gives one row with the error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for source, content in zip(pdf["path"], pdf["content"], strict=True):
                name = source.rsplit("/", 1)[-1]
                try:
                    texts = parse(bytes(content))
                    if not texts:
                        raise ValueError("no pages")
                    rows += [(name, k, t, None) for k, t in enumerate(texts)]
                except Exception as e:  # one bad file must not fail the others
                    rows.append((name, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "page", "text", "error"]).astype({"page": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source string, page int, text string, error string")


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A nested report of one row, as JSON; nulls are kept."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def upsert_chunks(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Append the chunks whose id isn't stored yet; ids are hashes of contents, so ingesting twice adds nothing."""
    new = new.dropDuplicates(["chunk_id"])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti")
    append(new, path)


def drop_store(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    try:
        return spark.table(name)
    except AnalysisException:
        return None
