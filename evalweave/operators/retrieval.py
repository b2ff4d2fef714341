"""Chunking, exact retrieval, grounding metrics and prompt assembly; models are injected."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import text as rules
from evalweave.functions.scores import clamp, cosine, distance_to_similarity, dot, r2, r4
from evalweave.operators import search
from evalweave.operators.batches import bound

SIZE, OVERLAP = 500, 50
#: Characters of a text split at once; of pieces held at once, and the number of these.
WINDOW, PIECES, MOST = 1 << 16, 1 << 20, 4096
#: A blank line, a line, a word, a letter.
SEPARATORS = tuple("\n\n|\n| |".split("|"))
NOTHING_FOUND = "No documents were found to answer this question."
#: A prompt, with the places of the context and of the question.
TEMPLATE = "Use nothing but these passages to answer; if they don't hold the answer, say so.\n\n{context}\n\nQuestion: {question}\nAnswer:"


Vectors = list[list[float]]


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> Vectors: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Agent(Protocol):
    def run(self, query: str) -> dict[str, str]: ...


def fixed_chunks(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, chunk): windows of `size` characters that overlap; none for empty text."""
    step = size - overlap
    last = F.floor(F.greatest(F.length("text") - F.lit(overlap) - 1, F.lit(0)) / step)
    at = df.filter(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_index"))
    return at.select("doc_id", "chunk_index", F.expr(f"substring(text, int(chunk_index * {step} + 1), {size})").alias("chunk"))


def _parts(text: str, mark: str) -> Iterator[str]:
    """text.split(mark), or its characters for an empty mark, without holding all of them."""
    if not mark:
        yield from text
        return
    at = 0
    while len(text) - at > WINDOW:
        *some, rest = text[at : at + WINDOW].split(mark)
        if some:
            yield from some
            at += WINDOW - len(rest)  # just after a mark, as split() goes on
            continue
        to = text.find(mark, at)
        if to < 0:
            break
        yield text[at:to]
        at = to + len(mark)
    yield from text[at:].split(mark)


def _pieces(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    mark = next((s for s in separators if s and s in text), "")
    rest = separators[separators.index(mark) + 1 :] if mark in separators else ()
    held: deque[str] = deque()
    length, gap = -len(mark), len(mark)  # of what is held, joined: a gap less than its parts and their gaps

    for part in _parts(text, mark):
        if len(part) > size:
            if joined := mark.join(held).strip():
                yield joined
            held.clear()
            length = -gap
            yield from _pieces(part, size, overlap, rest)
            continue
        if held and length + gap + len(part) > size:
            if joined := mark.join(held).strip():
                yield joined
            while held and (length > overlap or length + gap + len(part) > size):
                length -= len(held.popleft()) + gap
        held.append(part)
        length += gap + len(part)
    if joined := mark.join(held).strip():
        yield joined


def split_recursively(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that works, neighbours sharing up to `overlap`."""
    return list(_pieces(text, size, overlap, separators))


def recursive_chunks(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(source, page, pos, text): the pieces of each page; a worker holds a batch of pages and about PIECES characters of pieces."""
    kinds = pa.schema([("source", pa.string()), ("page", pa.int32()), ("pos", pa.int32()), ("text", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for row in zip(*b.columns, strict=True):
                source, page, text = (x.as_py() for x in row)
                for k, piece in enumerate(_pieces(text or "", size, overlap, SEPARATORS)):
                    rows.append((source, page, k, piece))
                    held += len(piece)
                    if held >= PIECES or len(rows) >= MOST:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    bound(df.sparkSession)
    given = df.select(F.col("source").cast("string").alias("source"), F.col("page").cast("int").alias("page"), "text")
    return given.mapInArrow(run, "source string, page int, pos int, text string")


def indexed_chunks(df: DataFrame) -> DataFrame:
    """Chunks numbered over their whole source, from 0, with an id that hashes their contents."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("page", "pos")) - 1
    out = df.withColumn("chunk_index", n.cast("long"))
    return out.withColumn("chunk_id", F.sha2(F.concat_ws("\x1f", "source", F.col("page").cast("string"), F.col("chunk_index").cast("string"), "text"), 256))


def embedded(df: DataFrame, make: Callable[[], Embedder], column: str = "text") -> DataFrame:
    """df with an embedding of a text column; the model is made once a worker task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield pdf.assign(embedding=model.embed(pdf[column].fillna("").tolist()))

    return df.mapInPandas(run, f"{_ddl(df)}, embedding array<float>")


class HashEmbedder:
    """Offline default: words hashed to signed places, unit length. It stands in for a model, and isn't one."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> Vectors:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.size] += 1.0 if h & 0x10000 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


class Echo:
    """Offline default: the last line of a prompt but one, without its first word. It stands in for a model, and isn't one."""

    def generate(self, prompt: str) -> str:
        return prompt.rsplit("\n", 2)[1].partition(" ")[2]


def nearest_chunks(queries: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, chunk_id, rank, score): the k chunks of greatest cosine, ties by chunk_id.

    The order is that of the exact cosine; the score is that cosine, not below zero, rounded after ranking.

    queries (query_id, q) meet the chunks (chunk_id, v) in blocks, and few pairs become rows. The window's limit
    drops all but k a query before its shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "chunk_id")
    ranked = search.candidates(queries, chunks, k).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "rank", distance_to_similarity(F.lit(2.0) - F.lit(2.0) * F.col("s")).alias("score"))


def similarity_of(a: Column, b: Column) -> Column:
    """Similarity of unit vectors through their squared distance."""
    return distance_to_similarity(F.lit(2.0) - F.lit(2.0) * dot(a, b))


def grounding(found: DataFrame) -> DataFrame:
    """(query_id, context_relevance, faithfulness, hallucination_risk) from (query_id, q, answer, v) rows, one a context document; v null: none.

    Means of cosines, rounded and clamped; without documents 0, 0 and 1.
    """
    with_doc = F.col("v").isNotNull()
    mean = lambda c: clamp(F.coalesce(r4(F.avg(F.when(with_doc, c)) + 1e-9), F.lit(0.0)))
    g = found.groupBy("query_id").agg(mean(cosine(F.col("q"), F.col("v"))).alias("context_relevance"), mean(cosine(F.col("answer"), F.col("v"))).alias("faithfulness"))
    return g.withColumn("hallucination_risk", r4(F.lit(1.0) - F.col("faithfulness")))


def _block() -> Column:
    return F.format_string("[%d] (Source: %s, Page: %s)\n%s", F.col("rank"), F.coalesce("source", F.lit("unknown")), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.coalesce("text", F.lit("")))


def _ranked(**columns: Column) -> Column:
    """The rows of a group by rank, as structs of the given columns."""
    return F.array_sort(F.collect_list(F.struct("rank", *(c.alias(n) for n, c in columns.items()))))


def context_blocks(df: DataFrame) -> DataFrame:
    """(query_id, context): the ranked chunks of each query, numbered and labelled, a blank line between."""
    return df.groupBy("query_id").agg(F.array_join(F.transform(_ranked(b=_block()), lambda x: x["b"]), "\n\n").alias("context"))


def assembled(queries: DataFrame, context: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(query_id, prompt) from (query_id, question) and the context of context_blocks(); without context the prompt is null. Other columns of context stay."""
    before, after = template.split("{context}")
    both = queries.select("query_id", "question").join(context, "query_id", "left")
    parts = [F.lit(x) for x in after.split("{question}")]
    prompt = F.concat(F.lit(before), F.col("context"), parts[0], F.col("question"), parts[1]).alias("prompt")
    return both.select("query_id", prompt, *(c for c in context.columns if c not in ("query_id", "context")))


def answered(prompts: DataFrame, make: Callable[[], Generator], keep: Sequence[str] = ()) -> DataFrame:
    """prompts (query_id, prompt and the columns to keep) with answer, error and generation seconds.

    A generator's failure is an error string, not an exception; an empty or null prompt gets the fixed answer in no time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = make()
        for pdf in batches:
            rows = []
            for p in pdf["prompt"]:
                if not p:
                    rows.append((NOTHING_FOUND, None, 0.0))
                    continue
                began, error = time.perf_counter(), None
                try:
                    answer = model.generate(p)
                except Exception as e:  # reported with the row
                    answer, error = f"[ERROR] {e}", str(e)
                rows.append((answer, error, round(time.perf_counter() - began, 3)))
            yield pdf.assign(**dict(zip(("answer", "error", "seconds"), zip(*rows, strict=True) if rows else ((), (), ()), strict=True)))

    given = prompts.select(F.col("query_id").cast("long").alias("query_id"), "prompt", *keep)
    return given.mapInPandas(run, f"{_ddl(given)}, answer string, error string, seconds double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def retriever(chunks: DataFrame, make: Callable[[], Embedder], k: int = 3) -> Callable[..., DataFrame]:
    """A function of (queries (query_id, question), k) that finds the chunks of each: nearest_chunks() with their other columns."""

    def retrieve(queries: DataFrame, k: int = k) -> DataFrame:
        q = embedded(queries.select("query_id", "question"), make, "question").select("query_id", F.col("embedding").alias("q"))
        found = nearest_chunks(q, chunks.select("chunk_id", F.col("embedding").alias("v")), k)
        return found.join(chunks.drop("embedding"), "chunk_id")

    return retrieve


def query_run(queries: DataFrame, chunks: DataFrame, embedder: Callable[[], Embedder], generator: Callable[[], Generator], k: int = 3, retrieval_seconds: float = 0.0) -> DataFrame:
    """Retrieve, assemble, generate: a row for each of queries (query_id, question).

    (query_id, answer, error, sources, context_chunks, retrieval_time, generation_time, total_time, estimated_tokens);
    sources are labels in the order of rank. One plan retrieves for all queries at once, so that the
    seconds of a single retrieval are what the caller has measured.
    """
    found = retriever(chunks, embedder, k)(queries)
    label = rules.source_label(F.col("source"), F.col("chunk_index"), F.col("page"))
    ranked = found.groupBy("query_id").agg(_ranked(b=_block(), s=label).alias("found"))
    context = ranked.select("query_id", F.array_join(F.transform("found", lambda x: x["b"]), "\n\n").alias("context"), F.transform("found", lambda x: x["s"]).alias("s"))
    made = answered(assembled(queries, context), generator, ["s"])
    took = F.lit(float(retrieval_seconds))
    return made.select(
        "query_id",
        "answer",
        "error",
        F.coalesce("s", F.array().cast("array<string>")).alias("sources"),
        F.coalesce(F.size("s"), F.lit(0)).alias("context_chunks"),
        took.alias("retrieval_time"),
        F.col("seconds").alias("generation_time"),
        (took + F.col("seconds")).alias("total_time"),
        F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(rules.token_estimate(F.col("answer"))).alias("estimated_tokens"),
    )


def batch_run(prompts: DataFrame, chunks: DataFrame, embedder: Callable[[], Embedder], generator: Callable[[], Generator], model: str, k: int = 3) -> DataFrame:
    """The batch results of prompts (id, prompt, expected_answer): answers, their similarity to what was expected, pass flags.

    Rows with a blank prompt go. Without an expected answer the similarity is null; where the generator fails too, and the row
    has no sources and a latency of 0.
    """
    rows = prompts.select(F.col("id").cast("long").alias("query_id"), F.trim("prompt").alias("prompt"), F.trim(F.coalesce("expected_answer", F.lit(""))).alias("expected_answer")).filter(F.length("prompt") > 0)
    made = query_run(rows.select("query_id", F.col("prompt").alias("question")), chunks, embedder, generator, k)
    both = rows.join(made, "query_id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = embedder()
        for pdf in batches:
            told = [bool(e) and not isinstance(x, str) for e, x in zip(pdf["expected_answer"], pdf["error"], strict=True)]
            texts = pdf["expected_answer"][told].tolist() + pdf["answer"][told].tolist()
            vectors = iter(encoder.embed(texts) if texts else [])
            expected = [next(vectors) if t else None for t in told]
            yield pdf.assign(a=expected, b=[next(vectors) if t else None for t in told])

    # in one pass, so that no answer is generated twice
    judged = both.mapInPandas(compare, f"{_ddl(both)}, a array<double>, b array<double>")
    scored = judged.withColumn("similarity", F.when(F.col("a").isNotNull(), r4(cosine(F.col("a"), F.col("b")))))
    failed = F.col("error").isNotNull()
    return scored.select(
        F.col("query_id").alias("id"),
        "prompt",
        "expected_answer",
        F.col("answer").alias("model_answer"),
        "similarity",
        rules.passed(F.col("similarity")).alias("passed"),
        F.when(failed, F.lit(0.0)).otherwise(r2(F.col("total_time"))).alias("latency_s"),
        F.when(failed, F.array().cast("array<string>")).otherwise(F.col("sources")).alias("sources"),
        F.lit(model).alias("model"),
    )


def ingested(pages: DataFrame) -> DataFrame:
    """(source, pages, error) of read_binary_pages() rows: the pages read of each file, or why it couldn't be read."""
    return pages.groupBy("source").agg(F.count("text").alias("pages"), F.max("error").alias("error"))


def agent_results(cases: DataFrame, make: Callable[[], Agent]) -> DataFrame:
    """(query, expected_tool, tool_used, correct, response) of a user's agent over test cases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agent = make()
        for pdf in batches:
            got = [agent.run(q) for q in pdf["query"]]
            used = [g.get("tool_used", "unknown") for g in got]
            yield pdf.assign(tool_used=used, correct=[u == e for u, e in zip(used, pdf["expected_tool"], strict=True)], response=[g.get("response", "") for g in got])

    return cases.select("query", "expected_tool").mapInPandas(run, "query string, expected_tool string, tool_used string, correct boolean, response string")
