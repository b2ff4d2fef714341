"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

Lengths are counted in words. A document longer than a sequence is split in pieces of the full length
and a remainder. Only the histogram of piece lengths, at most max_words rows, reaches the driver, where
packing patterns are built: lengths are placed longest first, each into the open pattern that is
shortest so far, and the counts of patterns are updated. The patterns, whose number depends on
max_words alone, are joined back to the pieces by each piece's rank among those of its length.

Ranks come from windows over (length, bucket of doc_id) and the buckets' counts; buckets grow in number with
the pieces, so that no window holds more than about EACH of them. Equal lengths are packed in the order of
buckets, then of doc_id and piece.

Edge cases: null, blank and empty texts have no words and are in no pack. Repeated rows are packed one
by one; rows with null doc_id too (which of them gets which place is open). Other columns are untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import arrow_batches, cut, raw_texts, share, word_bounds

MAX_WORDS = 2048
#: Pieces in a window, about.
EACH = 100_000

Pattern = tuple[tuple[int, int], ...]


def patterns(histogram: dict[int, int], limit: int) -> list[tuple[Pattern, int]]:
    """[(pattern, packs)]: a pattern is ((length, pieces), ...) with the lengths falling.

    Every piece of the histogram is in just one pack, and no pack is longer than limit.
    """
    closed: list[tuple[Pattern, int]] = []
    order = count()
    opened: list[tuple[int, int, Pattern, int]] = []  # (used, age, pattern, packs), the shortest first
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if opened and opened[0][0] + length <= limit:
                used, _, pattern, packs = heapq.heappop(opened)
                take = min(packs, left)
                if take < packs:
                    heapq.heappush(opened, (used, next(order), pattern, packs - take))
            else:
                used, pattern, take = 0, (), left
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern and pattern[-1][0] == length else (*pattern, (length, 1))
            left -= take
            if used + length == limit:
                closed.append((grown, take))
            else:
                heapq.heappush(opened, (used + length, next(order), grown, take))
    merged: dict[Pattern, int] = {}
    for pattern, packs in closed + [(p, n) for _, _, p, n in opened]:
        merged[pattern] = merged.get(pattern, 0) + packs
    return sorted(merged.items(), reverse=True)


def slots(found: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """[(length, first rank, last rank + 1, first pack, pieces a pack, offset of the first)] of every pattern's lengths."""
    out, taken, pack = [], {}, 0
    for pattern, packs in found:
        at = 0
        for length, pieces in pattern:
            rank = taken.get(length, 0)
            out.append((length, rank, rank + packs * pieces, pack, pieces, at))
            taken[length] = rank + packs * pieces
            at += length * pieces
        pack += packs
    return out


def pieces(docs: DataFrame, max_words: int) -> DataFrame:
    """(doc_id, piece, start_word, n_words): the parts of each document, in order."""
    arrow_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([0 if raw is None else len(word_bounds(raw)[0]) for raw in raw_texts(b.column("text"))], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n)], ["doc_id", "n"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, n long").filter("n > 0")
    first = F.col("piece") * max_words
    split = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_words))).alias("piece"))
    return split.select("doc_id", "piece", first.alias("start_word"), F.least(F.col("n") - first, F.lit(max_words)).cast("long").alias("n_words"))


def packed_documents(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, piece, start_word, n_words, pack_id, pack_offset): where each piece of a document goes."""
    spark = docs.sparkSession
    # counting words reads all texts; the few bytes it leaves of each are kept
    parts = cut(pieces(docs, max_words).withColumn("row", F.monotonically_increasing_id()))
    buckets = max(64, -(-parts.count() // EACH))
    parts = parts.withColumn("bucket", share(F.coalesce("doc_id", "row"), buckets, 1))
    counts = parts.groupBy("n_words", "bucket").count()
    histogram = {r["n_words"]: r["n"] for r in counts.groupBy("n_words").agg(F.sum("count").alias("n")).collect()}
    rows = slots(patterns(histogram, max_words))
    table = spark.createDataFrame(rows, "length long, low long, high long, pack long, each long, at long")
    before = Window.partitionBy("n_words").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("n_words", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("n_words", "bucket").orderBy("doc_id", "piece")
    ranked = parts.withColumn("place", F.row_number().over(within) - 1).join(base, ["n_words", "bucket"]).withColumn("place", F.col("base") + F.col("place"))
    if len(rows) < 200_000:  # a few MB, and bounded by max_words
        table = F.broadcast(table)
    inside = F.col("place") - F.col("low")
    return ranked.join(table, (F.col("n_words") == F.col("length")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))).select(
        "doc_id",
        "piece",
        "start_word",
        "n_words",
        (F.col("pack") + F.floor(inside / F.col("each"))).alias("pack_id"),
        (F.col("at") + F.pmod(inside, F.col("each")) * F.col("length")).alias("pack_offset"),
    )

