"""Registry of the evaluation queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.functions import scores, text
from evalweave.functions.scores import r4
from evalweave.operators import analytics, failures, leaderboard, pipeline, retrieval
from evalweave.plans.base import BASE, CUES, MARKS, ROUTES, TOTAL, base, read, score, sql_round
from evalweave.streaming import metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PROJECTS = (("Safety", "en"), ("Safety", "de"), ("Facts", "fr"))
_FOUR = ("correctness", "relevance", "clarity", "safety")


def query(sql: str | None = None, view: bool = True):
    """Register a query under its function's name; sql may use the base view."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {BASE} {sql}" if view else sql
        return f

    return add


def _cols(*names: str) -> list:
    return [F.col(n) for n in names]


def _mean3(c: str) -> str:
    return f"coalesce({sql_round(f'avg({c}) + 1e-9::DOUBLE', 3)}, 0.0::DOUBLE)"


def _projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROJECTS, "project string, category string")


@query(f"SELECT model, {_mean3('trust_score')} AS trust FROM base WHERE model IS NOT NULL GROUP BY model")
def trust_by_model(spark, d):
    return analytics.trust_by_model(base(spark, d))


@query("SELECT id, trust_score FROM base")
def trust_score_plain(spark, d):
    return base(spark, d).select("id", "trust_score")


@query(f"SELECT id, CASE WHEN tool_accuracy IS NULL THEN trust_score ELSE {sql_round(f'{TOTAL} / 4.0::DOUBLE * 0.35::DOUBLE + grounded * 0.35::DOUBLE + tool_accuracy * 0.30::DOUBLE', 3)} END AS trust_score FROM base")
def trust_score_agent(spark, d):
    return base(spark, d).select("id", scores.trust_score(*_cols("hallucination", *_FOUR, "tool_accuracy")).alias("trust_score"))


@query(f"SELECT model, {sql_round('avg(s) + 1e-9::DOUBLE', 2)} AS score FROM (SELECT model, {sql_round('correctness * 0.4::DOUBLE + relevance * 0.2::DOUBLE + clarity * 0.2::DOUBLE + safety * 0.2::DOUBLE', 2)} AS s FROM base) GROUP BY model")
def weighted_leaderboard_score(spark, d):
    return leaderboard.model_scores(base(spark, d))


@query(f"SELECT id, {sql_round(f'{TOTAL} / 4.0::DOUBLE', 3)} AS trust FROM base")
def simulated_trust(spark, d):
    return base(spark, d).select("id", scores.simulated_trust(*_cols(*_FOUR)).alias("trust"))


@query(f"SELECT id, {sql_round('(0.35 * 0.80)::DOUBLE + (0.35 * 0.75)::DOUBLE + tool_accuracy * 0.30::DOUBLE', 3)} AS trust FROM base")
def agent_trust(spark, d):
    return base(spark, d).select("id", scores.agent_trust(F.col("tool_accuracy")).alias("trust"))


@query("SELECT id, CASE WHEN " + " OR ".join(f"contains(lower(response), '{m}')" for m in MARKS) + " THEN 'Injection' ELSE 'Normal' END AS prompt_type FROM base")
def injection_labels(spark, d):
    return base(spark, d).select("id", text.injection_label(F.col("response"), MARKS).alias("prompt_type"))


@query("SELECT id, hallucination, grounded AS label_score FROM base")
def hallucination_labels(spark, d):
    return base(spark, d).select("id", "hallucination", scores.label_score(F.col("hallucination")).alias("label_score"))


@query(f"SELECT {sql_round("CAST(count(*) FILTER (hallucination IS DISTINCT FROM 'Grounded') AS DOUBLE) / CAST(count(*) AS DOUBLE)", 3)} AS hallucination_rate FROM base")
def hallucination_rate(spark, d):
    return analytics.hallucination_rate(base(spark, d))


@query(f"SELECT {_mean3('trust_score')} AS average_trust FROM base")
def average_trust(spark, d):
    return analytics.average_trust(base(spark, d))


@query(f"SELECT {_mean3('safety')} AS average_safety FROM base")
def average_safety(spark, d):
    return analytics.average_safety(base(spark, d))


@query("SELECT count(*) AS total FROM base")
def total_prompts(spark, d):
    return base(spark, d).agg(F.count("*").alias("total"))


@query(f"SELECT count(*) AS prompts, {sql_round('avg(trust_score) + 1e-9::DOUBLE', 2)} AS average_trust, count(DISTINCT model) AS models, count(*) FILTER (safety_violation) AS violations FROM base")
def kpi_overview(spark, d):
    return analytics.overview(base(spark, d))


@query("SELECT model, " + ", ".join(f"{sql_round(f'avg(trust_score) FILTER (category = {chr(39)}{c}{chr(39)}) + 1e-9::DOUBLE', 3)} AS {c}" for c in ("de", "en", "es", "fr")) + " FROM base GROUP BY model")
def trust_heatmap(spark, d):
    return analytics.trust_heatmap(base(spark, d), ["de", "en", "es", "fr"])


@query("SELECT CAST(least(floor(trust_score * 10.0::DOUBLE), 9) AS INTEGER) AS bin, count(*) AS n FROM base GROUP BY ALL")
def trust_histogram(spark, d):
    return analytics.trust_histogram(base(spark, d))


@query("SELECT category, count(*) AS failing FROM base WHERE trust_score < 0.6::DOUBLE GROUP BY category")
def failing_by_category(spark, d):
    return analytics.failing_by_category(base(spark, d))


@query("SELECT id, trust_score FROM base WHERE trust_score < 0.6::DOUBLE")
def low_trust_06(spark, d):
    return analytics.low_trust(base(spark, d)).select("id", "trust_score")


@query("SELECT id, trust_score FROM base WHERE trust_score < 0.7::DOUBLE")
def low_trust_07(spark, d):
    return analytics.low_trust(base(spark, d), 0.7).select("id", "trust_score")


@query("SELECT id, hallucination FROM base WHERE hallucination IS DISTINCT FROM 'Grounded'")
def not_grounded(spark, d):
    return base(spark, d).filter(analytics.not_grounded()).select("id", "hallucination")


@query("SELECT id FROM base WHERE category = 'fr'")
def category_filter(spark, d):
    return analytics.of_category(base(spark, d), "fr").select("id")


@query("SELECT id, category FROM base WHERE category IN ('en', 'de')")
def project_filter_semi(spark, d):
    return analytics.of_project(base(spark, d), _projects(spark), "Safety").select("id", "category")


@query("SELECT project, count(*) AS n FROM base JOIN (VALUES ('Safety', 'en'), ('Safety', 'de'), ('Facts', 'fr')) p(project, c) ON category = c GROUP BY project")
def project_sizes(spark, d):
    return base(spark, d).join(_projects(spark), "category").groupBy("project").agg(F.count("*").alias("n"))


@query("SELECT id FROM base WHERE contains(lower(response), 'mit license')")
def keyword_search(spark, d):
    return analytics.searched(base(spark, d), "response", "MIT License").select("id")


def _sql_route(column: str) -> str:
    low = f"lower(coalesce({column}, ''))"
    whens = " ".join(f"WHEN regexp_matches({low}, '{text.route_pattern(w)}') THEN '{t}'" for t, w in ROUTES)
    return f"CASE {whens} ELSE 'unknown' END"


@query(f"SELECT id, {_sql_route('response')} AS tool FROM base")
def tool_routing(spark, d):
    return base(spark, d).select("id", text.route(F.col("response"), ROUTES).alias("tool"))


_EXPECTED = "CASE WHEN category = 'fr' THEN 'alpha' WHEN category = 'es' THEN 'unknown' ELSE 'gamma' END"
_CASES = f"cases AS (SELECT {_EXPECTED} AS expected_tool, {_sql_route('response')} = {_EXPECTED} AS correct FROM base)"


def _cases(spark, d):
    expected = F.when(F.col("category") == "fr", "alpha").when(F.col("category") == "es", "unknown").otherwise("gamma")
    return base(spark, d).select(expected.alias("expected_tool"), (text.route(F.col("response"), ROUTES) == expected).alias("correct"))


@query(f", {_CASES} SELECT expected_tool, count(correct) AS total, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS passed, {sql_round('CAST(sum(CAST(correct AS INTEGER)) AS DOUBLE) / CAST(count(correct) AS DOUBLE)', 4)} AS accuracy FROM cases GROUP BY expected_tool")
def tool_accuracy_by_tool(spark, d):
    return analytics.tool_accuracy(_cases(spark, d))


@query(f", {_CASES} SELECT count(*) AS total_tests, count(*) FILTER (correct) AS passed_tests, {sql_round('CAST(count(*) FILTER (correct) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 4)} AS tool_accuracy FROM cases")
def agent_accuracy(spark, d):
    return analytics.agent_accuracy(_cases(spark, d))


def _batch(spark, d):
    answer = F.when(F.col("id") % 17 == 0, F.lit("[ERROR] timeout")).when(F.col("id") % 13 == 0, F.lit("I do not have enough information.")).otherwise(F.col("response"))
    return failures.explained(base(spark, d).withColumn("model_answer", answer))


_LOW = "lower(coalesce(model_answer, ''))"
_NO_CONTEXT = " OR ".join(f"contains({_LOW}, '{p}')" for p in text.NO_CONTEXT)
_BATCH = f"""batch AS (SELECT *, coalesce(similarity >= 0.55::DOUBLE, false) AS passed,
  CASE WHEN contains({_LOW}, '[error]') THEN '{text.REASONS[0]}' WHEN {_NO_CONTEXT} THEN '{text.REASONS[1]}' WHEN similarity IS NULL THEN '{text.REASONS[2]}'
    WHEN similarity < 0.25::DOUBLE THEN '{text.REASONS[3]}' WHEN similarity < 0.40::DOUBLE THEN '{text.REASONS[4]}' WHEN similarity < 0.55::DOUBLE THEN '{text.REASONS[5]}' ELSE '{text.REASONS[6]}' END AS reason,
  CASE WHEN {_NO_CONTEXT} THEN 'Low' WHEN similarity IS NULL OR similarity < 0.40::DOUBLE THEN 'Critical' ELSE 'Medium' END AS severity
  FROM (SELECT *, CASE WHEN id % 17 = 0 THEN '[ERROR] timeout' WHEN id % 13 = 0 THEN 'I do not have enough information.' ELSE response END AS model_answer FROM base))"""


@query(f""", {_BATCH} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, {sql_round('CAST(count(*) FILTER (passed) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 4)} AS pass_rate,
  {sql_round('avg(similarity) + 1e-9::DOUBLE', 4)} AS average_similarity, {sql_round('1.0::DOUBLE - avg(similarity) + 1e-9::DOUBLE', 4)} AS hallucination_rate, {sql_round('avg(latency_s) + 1e-9::DOUBLE', 2)} AS average_latency FROM batch""")
def batch_summary(spark, d):
    return analytics.batch_summary(_batch(spark, d))


@query(f", {_BATCH} SELECT model, avg(CAST(passed AS INTEGER)) AS accuracy, count(*) AS total, count(*) FILTER (passed) AS passed FROM batch GROUP BY model")
def batch_accuracy(spark, d):
    return _batch(spark, d).groupBy("model").agg(F.avg(F.col("passed").cast("double")).alias("accuracy"), F.count("*").alias("total"), F.count_if("passed").alias("passed"))


@query(f", {_BATCH} SELECT count(*) FILTER (NOT passed) AS failures, count(*) FILTER (passed) AS passes, {sql_round('CAST(count(*) FILTER (NOT passed) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 4)} AS failure_share FROM batch")
def failure_share(spark, d):
    return analytics.failure_share(_batch(spark, d))


@query(f", {_BATCH} SELECT id, passed, reason, severity FROM batch")
def failure_reason(spark, d):
    return _batch(spark, d).select("id", "passed", "reason", "severity")


@query(f", {_BATCH} SELECT reason, count(*) AS n FROM batch WHERE NOT passed GROUP BY reason")
def reason_counts(spark, d):
    return failures.reason_counts(_batch(spark, d))


@query(f", {_BATCH} SELECT id, severity FROM batch WHERE NOT passed ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END DESC, id")
def failure_severity_sorted(spark, d):
    return failures.by_severity(_batch(spark, d), "id").select("id", "severity")


@query(f", {_BATCH} SELECT id, passed, similarity FROM batch ORDER BY passed, coalesce(similarity, 0.0::DOUBLE), id")
def failures_first(spark, d):
    return failures.failures_first(_batch(spark, d), "id").select("id", "passed", "similarity")


@query(f", {_BATCH} SELECT id, CASE WHEN length(trim(model_answer, ' ')) > 70 THEN substr(trim(model_answer, ' '), 1, 70) || '…' ELSE trim(model_answer, ' ') END AS label FROM batch ORDER BY id LIMIT 50")
def export_rows(spark, d):
    return _batch(spark, d).orderBy("id").limit(50).select("id", text.shortened(F.trim("model_answer"), 70).alias("label"))


_SPLIT = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


@query(f"SELECT a.id, len(list_intersect({_SPLIT.format('lower(a.response)')}, {_SPLIT.format('lower(b.response)')})) = 0 AS unrelated FROM base a JOIN base b ON b.id = a.id + 1")
def word_overlap(spark, d):
    df = base(spark, d)
    after = df.select((F.col("id") - 1).alias("id"), F.col("response").alias("answer"))
    return df.join(after, "id").select("id", text.no_common_word(F.col("response"), F.col("answer")).alias("unrelated"))


@query(f"SELECT id, CAST(greatest(1, floor(CAST(len({_SPLIT.format('response')}) AS DOUBLE) / 0.75::DOUBLE)) AS BIGINT) AS tokens FROM base")
def token_estimate(spark, d):
    return base(spark, d).select("id", text.token_estimate(F.col("response")).alias("tokens"))


_POSITIONS = f"""n AS (SELECT least((SELECT count(*) FROM documents), (SELECT count(*) FROM orders), (SELECT count(*) FROM conversations)) AS n),
h AS (SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, id, hallucination FROM base),
j AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, {", ".join(f"CAST((o_orderkey * {k}) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS {c}" for c, k in zip(_FOUR, (37, 91, 53, 71), strict=True))} FROM orders),
i AS (SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS ordinal, contains(lower(text), 'que') AS hit FROM conversations)"""


@query(
    f""", {_POSITIONS} SELECT ordinal, id, CASE WHEN hit THEN 'Injection' ELSE 'Normal' END AS prompt_type, hallucination, 'phi3' AS model,
  {sql_round(f"(CASE hallucination WHEN 'Grounded' THEN 1.0::DOUBLE WHEN 'Likely Hallucination' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END + {TOTAL}) / 5.0::DOUBLE", 3)} AS trust_score
  FROM h JOIN j USING (ordinal) JOIN i USING (ordinal) WHERE ordinal < (SELECT n FROM n)"""
)
def positional_merge(spark, d):
    """Three sets with ids of their own, as long as the shortest, aligned by position."""
    turns = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), text.injection_label(F.col("text"), ("que",)).alias("prompt_type"))
    judge = read(spark, d, "orders").select("o_orderkey", *(score(k, key="o_orderkey").alias(c) for c, k in zip(_FOUR, (37, 91, 53, 71), strict=True)))
    sets = [(base(spark, d).select("id", "hallucination"), "id"), (judge, "o_orderkey"), (turns, "at")]
    n = min(df.count() for df, _ in sets)
    three = [pipeline.numbered(df, key, "ordinal").filter(F.col("ordinal") < n) for df, key in sets]
    return pipeline.merged(*three, "ordinal", "phi3").select("ordinal", "id", "prompt_type", "hallucination", "model", "trust_score")


def _entries(spark, d, which: str):
    df = base(spark, d)
    old = df.filter("id % 2 = 0").groupBy("model", F.col("category").alias("dataset")) if which == "old" else df.filter("id % 5 = 0").groupBy("model", F.col("category").alias("dataset"))
    return old.agg(F.count("*").alias("total"), F.sum("id").alias("checksum"))


def _sql_entries(where: str) -> str:
    return f"(SELECT model, category AS dataset, count(*) AS total, CAST(sum(id) AS BIGINT) AS checksum FROM base WHERE {where} GROUP BY ALL)"


@query(f"SELECT coalesce(o.model, n.model) AS model, coalesce(o.dataset, n.dataset) AS dataset, coalesce(n.total, o.total) AS total, coalesce(n.checksum, o.checksum) AS checksum FROM {_sql_entries('id % 2 = 0')} o FULL JOIN {_sql_entries('id % 5 = 0')} n ON o.model = n.model AND o.dataset = n.dataset")
def leaderboard_upsert(spark, d):
    return leaderboard.upserted(_entries(spark, d, "old"), _entries(spark, d, "new"))


_STANDARD = f"""std AS (SELECT model, 'standard' AS dataset, {_mean3('trust_score')} AS accuracy, count(*) AS total FROM base GROUP BY model),
have AS (SELECT * FROM std WHERE model < 'src5')"""


@query(f", {_STANDARD} SELECT model, dataset, accuracy, total FROM have UNION ALL SELECT s.model, s.dataset, s.accuracy, s.total FROM std s WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.model = s.model)")
def standard_antijoin(spark, d):
    std = base(spark, d).groupBy("model").agg(analytics.mean3("trust_score").alias("accuracy"), F.count("*").alias("total"))
    std = std.select("model", F.lit("standard").alias("dataset"), "accuracy", "total")
    return leaderboard.with_standard(std.filter("model < 'src5'"), std)


@query("SELECT model, category AS dataset, correctness AS accuracy, id AS timestamp FROM base QUALIFY row_number() OVER (PARTITION BY model, category ORDER BY correctness DESC, id DESC) = 1")
def leaderboard_dedup(spark, d):
    entries = base(spark, d).select("model", F.col("category").alias("dataset"), F.col("correctness").alias("accuracy"), F.col("id").alias("timestamp"))
    return leaderboard.best_entries(entries)


@query("SELECT id, row_no, page FROM (SELECT id, row_number() OVER (ORDER BY id) AS row_no, CAST(greatest(1, ceil(count(*) OVER () / 10.0::DOUBLE)) AS INTEGER) AS page FROM base WHERE category = 'fr') WHERE ceil(row_no / 10.0::DOUBLE) = page")
def paginate_last(spark, d):
    return analytics.page(base(spark, d).filter("category = 'fr'").select("id"), "id")


@query("SELECT id, safety_violation FROM base UNION ALL BY NAME SELECT id FROM base WHERE id % 7 = 0")
def union_append(spark, d):
    df = base(spark, d)
    return df.select("id", "safety_violation").unionByName(df.filter("id % 7 = 0").select("id"), allowMissingColumns=True)


@query("SELECT r.range AS run, b.item_id FROM range(150) r JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS turn, count(*) OVER () AS n FROM benchmark) b ON r.range % b.n = b.turn", view=False)
def round_robin(spark, d):
    return pipeline.repeated(read(spark, d, "benchmark").select("item_id"), "item_id", 150)


@query("SELECT doc_id, chunk_index, substr(text, CAST(chunk_index * 450 + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(floor(greatest(length(text) - 51, 0) / 450.0::DOUBLE) AS BIGINT) + 1)) AS chunk_index FROM documents WHERE length(text) > 0)", view=False)
def fixed_chunks(spark, d):
    return retrieval.fixed_chunks(read(spark, d, "documents"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index FROM conversations", view=False)
def chunk_index(spark, d):
    df = read(spark, d, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("page"), F.lit(0).alias("pos"), "text")
    return retrieval.indexed_chunks(df).select(F.col("source").alias("conv_id"), F.col("page").alias("turn"), "chunk_index")


_UNIT = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_COS = "coalesce(list_dot_product(q.v, c.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)), 0), 0)"


def _queries_and_chunks(spark, d):
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return q, e.filter("vec_id % 50 <> 0").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))


_FOUND = f"""found AS (SELECT query_id, chunk_id, rank, {sql_round("greatest(0.0::DOUBLE, 1.0::DOUBLE - (2.0::DOUBLE - 2.0::DOUBLE * s) / 2.0::DOUBLE)", 4)} AS score FROM
  (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank, s FROM
    (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {_COS} AS s FROM {_UNIT} q, {_UNIT} c WHERE q.vec_id % 50 = 0 AND c.vec_id % 50 <> 0)) WHERE rank <= 5)"""


@query(f"WITH {_FOUND} SELECT * FROM found", view=False)
def topk_cosine(spark, d):
    return retrieval.nearest_chunks(*_queries_and_chunks(spark, d), k=5)


@query(f"WITH {_FOUND} SELECT query_id, {sql_round('avg(score) + 1e-9::DOUBLE', 4)} AS context_relevance FROM found GROUP BY query_id", view=False)
def mean_similarity(spark, d):
    return retrieval.nearest_chunks(*_queries_and_chunks(spark, d), k=5).groupBy("query_id").agg(r4(F.avg("score") + 1e-9).alias("context_relevance"))


_G = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {0}))"


@query(
    f"""WITH {_FOUND}, g AS (SELECT f.query_id, {_G.format(sql_round(f"avg({_COS}) + 1e-9::DOUBLE", 4))} AS context_relevance,
  {_G.format(sql_round(f"avg({_COS.replace('q.v', 'a.v')}) + 1e-9::DOUBLE", 4))} AS faithfulness
  FROM found f JOIN {_UNIT} q ON q.vec_id = f.query_id JOIN {_UNIT} a ON a.vec_id = f.query_id + 1 JOIN {_UNIT} c ON c.vec_id = f.chunk_id GROUP BY f.query_id)
  SELECT *, {sql_round('1.0::DOUBLE - faithfulness', 4)} AS hallucination_risk FROM g""",
    view=False,
)
def rag_metrics(spark, d):
    q, c = _queries_and_chunks(spark, d)
    answers = read(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("answer"))
    found = retrieval.nearest_chunks(q, c, k=5).select("query_id", "chunk_id")
    return retrieval.grounding(found.join(c, "chunk_id").join(q, "query_id").join(answers, "query_id"))


_CONF = sql_round("correctness * 0.4::DOUBLE + relevance * 0.4::DOUBLE + (1.0::DOUBLE - clarity) * 0.2::DOUBLE", 4)


@query(f"""SELECT id, c AS confidence, CASE WHEN c >= 0.70::DOUBLE THEN 'High' WHEN c >= 0.40::DOUBLE THEN 'Medium' ELSE 'Low' END AS tier,
  CASE WHEN c > 0.7::DOUBLE THEN 'green' WHEN c > 0.4::DOUBLE THEN 'yellow' ELSE 'red' END AS badge, CASE WHEN c < 0.2::DOUBLE THEN 'green' WHEN c < 0.5::DOUBLE THEN 'yellow' ELSE 'red' END AS risk
  FROM (SELECT id, {_CONF} AS c FROM base)""")
def confidence_tier(spark, d):
    c = F.col("confidence")
    df = base(spark, d).select("id", scores.confidence(*_cols("correctness", "relevance", "clarity")).alias("confidence"))
    return df.select("id", "confidence", scores.confidence_tier(c).alias("tier"), scores.score_badge(c).alias("badge"), scores.risk_badge(c).alias("risk"))


@query("SELECT conv_id AS query_id, string_agg('[' || n || '] (Source: ' || coalesce(role, 'unknown') || ', Page: ' || turn || chr(41) || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id", view=False)
def context_blocks(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    df = read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), n.alias("rank"), F.col("role").alias("source"), F.col("turn").alias("page"), "text")
    return retrieval.context_blocks(df)


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS chunks FROM documents GROUP BY ALL", view=False)
def collection_stats(spark, d):
    return read(spark, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("chunks")).orderBy("source")


@query("SELECT DISTINCT category FROM base")
def distinct_categories(spark, d):
    return analytics.distinct_sorted(base(spark, d), "category")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", view=False)
def windowed_events(spark, d):
    return metrics.windowed_counts(read(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _sql_unit(key: str, salt: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5({key} || '|{salt}|0'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE)"


@query("SELECT id, category, " + ", ".join(f"0.6::DOUBLE + {_sql_unit('id', c)} * 0.4::DOUBLE AS {c}" for c in _FOUR) + " FROM base")
def judge_scores(spark, d):
    return pipeline.judged(base(spark, d).select("id", "category"))


_RUN = ", ".join(f"{sql_round(f'0.5::DOUBLE + {_sql_unit(chr(114) + chr(117) + chr(110), c)} * 0.5::DOUBLE', 3)} AS {c}" for c in _FOUR)


@query(
    f"""SELECT run, id, 'benchmark' AS category, prompt, {", ".join(_FOUR)}, 'phi3' AS model, CASE CAST(floor({_sql_unit("run", "label")} * 3.0::DOUBLE) AS BIGINT) WHEN 0 THEN 'Grounded' WHEN 1 THEN 'Possible Hallucination' ELSE 'Likely Hallucination' END AS hallucination,
  {sql_round(f"{TOTAL} / 4.0::DOUBLE", 3)} AS trust_score FROM (SELECT r.range AS run, b.item_id AS id, b.text AS prompt, {_RUN.replace("run ||", "r.range ||")} FROM range(50) r
  JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS turn, count(*) OVER () AS n FROM benchmark) b ON r.range % b.n = b.turn)""",
    view=False,
)
def simulated_run(spark, d):
    prompts = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("category"), F.col("text").alias("prompt"))
    return pipeline.simulated(prompts, "phi3", 50)


@query(f", {_BATCH} SELECT id, similarity, latency_s FROM batch")
def sorted_by_latency(spark, d):
    return failures.by_number(_batch(spark, d), "latency_s", "id", descending=True).select("id", "similarity", "latency_s")


@query(f", {_BATCH} SELECT id, reason FROM batch WHERE reason = '{text.REASONS[4]}'")
def reason_filter(spark, d):
    return failures.with_reason(_batch(spark, d), text.REASONS[4]).select("id", "reason")


@query(
    f""", {_BATCH} SELECT id, CASE WHEN category = 'fr' THEN '—' ELSE substr(category, 1, 60) END AS expected, substr(model_answer, 1, 80) AS model_answer,
  coalesce(similarity, 0.0::DOUBLE) AS similarity, CASE WHEN passed THEN 'Pass' ELSE 'Fail' END AS result, latency_s FROM batch"""
)
def display_rows(spark, d):
    df = _batch(spark, d).withColumn("prompt", F.col("id").cast("string")).withColumn("expected_answer", F.when(F.col("category") != "fr", F.col("category")))
    return failures.display_rows(df).select(F.col("prompt").cast("long").alias("id"), "expected", "model_answer", "similarity", "result", "latency_s")


@query("SELECT id, category FROM base WHERE model = 'src3' ORDER BY id LIMIT 1")
def point_lookup(spark, d):
    return analytics.first_with(base(spark, d), "model", "src3", "id").select("id", "category")


@query(f", {_BATCH} SELECT id FROM batch WHERE similarity IS NOT NULL")
def scored_rows(spark, d):
    return analytics.scored(_batch(spark, d)).select("id")


@query("SELECT model, 'standard' AS dataset, count(*) AS total, CAST(0 AS BIGINT) AS passed, TIMESTAMP '2024-01-01 00:00:00' AS timestamp FROM base WHERE model IS NOT NULL GROUP BY model")
def standard_entries(spark, d):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return leaderboard.standard_entries(base(spark, d), at).drop("accuracy")


@query(
    f""", {_CASES} SELECT (SELECT {sql_round("CAST(count(*) FILTER (correct) AS DOUBLE) / CAST(count(*) AS DOUBLE)", 4)} FROM cases) AS tool_accuracy, (SELECT count(*) FROM cases) AS total_tests,
  tool_used, count(*) AS n FROM (SELECT {_sql_route("response")} AS tool_used FROM base) GROUP BY tool_used"""
)
def agent_tools(spark, d):
    """How often each tool is taken, beside the accuracy of all."""
    used = base(spark, d).select(text.route(F.col("response"), ROUTES).alias("tool_used")).groupBy("tool_used").agg(F.count("*").alias("n"))
    return used.crossJoin(F.broadcast(analytics.agent_accuracy(_cases(spark, d)).select("tool_accuracy", "total_tests")))  # one row


def _batch_run(spark, d):
    """Benchmark items asked of the conversations' turns; the answer repeats the end of the prompt."""
    prompts = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"), F.col("text").alias("expected_answer"))
    turns = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("page"), F.lit(0).alias("pos"), "text")
    chunks = retrieval.embedded(retrieval.indexed_chunks(turns), retrieval.HashEmbedder)
    return retrieval.batch_run(prompts, chunks, retrieval.HashEmbedder, retrieval.Echo, "echo")


@query()
def batch_run(spark, d):
    return _batch_run(spark, d)


@query()
def recursive_chunks(spark, d):
    df = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit(0).alias("page"), "text")
    return retrieval.indexed_chunks(retrieval.recursive_chunks(df))


__all__ = ["CUES", "ORACLES", "QUERIES"]
