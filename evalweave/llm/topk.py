"""Exact top-k search by distributed histogram selection; the vectors whose id is divisible by `every` are queries against all others.

Vectors are made unit length and rounded to 24 binary places, so that a score, their inner product, is
an exact integer multiple of 2**-48 in any order of summing. Vectors are stored in blocks, a partition each, queries again in blocks of their own; a
task takes a block of queries and one of candidates from where they are stored. The kth score within a query's own block is
a lower bound. Above it, a histogram of 64 bins is summed over all blocks, and the bin of the kth score
becomes the next interval, until the candidates above the interval's lower end are about k. Then each
block hands on those of its scores, at most k a query, and the k best are chosen by score, ties by id.

The histograms, not the vectors or scores, are shuffled. Edge cases: null, empty, zero or non-finite vectors
and null ids neither ask nor answer; vectors of other than the commonest length neither. Lengths may be of
any magnitude: vectors are scaled by a power of two first. Rows that repeat an id count once, with the least
vector. A query with fewer than k others gets all. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import arrow_batches, cut, share

PLACES = 24
BINS = 64
BLOCK = 4096
K = 10
_ONE = 1 << (2 * PLACES)
#: Below all scores; no score is above _ONE.
_LOW = -2 * _ONE


def blocks(vectors: DataFrame, block: int = BLOCK, every: int = 1) -> tuple[DataFrame, DataFrame]:
    """(block, ids, data): packed rounded vectors, about `block` in each; the same of those whose id is divisible by `every`."""
    one = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("v"))
    good = one.filter("size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(v, x -> x <> 0)")
    good = cut(good)
    dims = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        v = np.stack(table.column("v").to_pylist())[order]
        v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])  # exact; no square over- or underflows
        v = np.floor(v / np.sqrt((v * v).sum(axis=1))[:, None] * float(1 << PLACES) + 0.5)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([v.astype(np.int32).tobytes()], pa.binary())})

    def packed(some: DataFrame, count: int) -> DataFrame:
        parts = max(1, -(-count // block))
        return some.withColumn("block", share(F.col("id"), parts, 10).cast("int")).groupBy("block").applyInArrow(pack, "block int, ids binary, data binary").repartitionByRange(parts, "block")

    same = good.filter(F.size("v") == F.lit(dims["dim"] if dims else 0))
    asked = same.filter(F.col("id") % every == 0)
    return packed(same, dims["count"] if dims else 0), packed(asked, asked.count())


def _pairs(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray):
    """(first query, scores) of slices of the queries against all candidates; the pair of an id with itself is far below all."""
    for k in range(0, len(q), 256):
        s = q[k : k + 256] @ c.T
        s[qid[k : k + 256, None] == cid[None, :]] = -np.inf
        yield k, s


def _load(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype=np.int64)
    return i, np.frombuffer(data, dtype=np.int32).reshape(len(i), -1).astype(np.float64)


STATE = "qblock int, qids binary, qdata binary, low binary, need binary, step binary, open long"


def _row(block: int, ids: bytes, data: bytes, low: np.ndarray, need: np.ndarray, step: np.ndarray, left: int) -> pa.RecordBatch:
    blobs = (ids, data, *(x.astype(np.int64).tobytes() for x in (low, need, step)))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([left], pa.int64())], ["qblock", "qids", "qdata", "low", "need", "step", "open"])


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int64)


def top_k(vectors: DataFrame, k: int = K, block: int = BLOCK, every: int = 1) -> DataFrame:
    """(vec_id, neighbour_id, place, score): of each vector whose id is divisible by `every` the k others with the greatest cosine."""
    arrow_batches(vectors.sparkSession)
    stored, asked = map(cut, blocks(vectors, block, every))
    two = stored.select(F.col("ids").alias("cids"), F.col("data").alias("cdata"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blk, ids, data in zip(*(b.column(c).to_pylist() for c in ("block", "ids", "data")), strict=True):
                i, q = _load(ids, data)
                low = np.full(len(i), _LOW, dtype=np.int64)
                if len(i) > k:
                    low = np.concatenate([np.partition(s, -k, axis=1)[:, -k] for _, s in _pairs(q, i, q, i)]).astype(np.int64)
                width = np.ceil(np.log2((_ONE + 1 - low) / BINS)).astype(np.int64)
                yield _row(blk, ids, data, low, np.full(len(i), k), np.int64(1) << np.maximum(width, 0), -1)

    # low: the lower end of each query's interval, which has BINS bins of `step`; need: the rank of the kth score within it
    state = cut(asked.mapInArrow(start, STATE))
    n = asked.agg(F.coalesce(F.sum(F.length("ids") / 8), F.lit(0))).first()[0]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blk, qi, qd, low, step, ci, cd in zip(*(b.column(c).to_pylist() for c in ("qblock", "qids", "qdata", "low", "step", "cids", "cdata")), strict=True):
                (qid, q), (cid, c) = _load(qi, qd), _load(ci, cd)
                low, step = _longs(low).astype(np.float64), _longs(step).astype(np.float64)
                h = np.zeros((len(q), BINS), dtype=np.int64)
                for at, s in _pairs(q, qid, c, cid):
                    r, x = np.nonzero(s >= low[at : at + len(s), None])
                    bins = np.floor((s[r, x] - low[at + r]) / step[at + r]).astype(np.int64)
                    r, bins = r[bins < BINS], bins[bins < BINS]
                    h[at : at + len(s)] = np.bincount(r * BINS + bins, minlength=len(s) * BINS).reshape(-1, BINS)
                yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([h.astype(np.int32).tobytes()], pa.binary())], ["hblock", "h"])

    def narrow(left: pa.Table, right: pa.Table) -> pa.Table:
        h = sum(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in left.column("h").to_pylist()).reshape(-1, BINS)
        row = right.to_pylist()[0]
        low, need, step = (_longs(row[c]) for c in ("low", "need", "step"))
        above = np.cumsum(h[:, ::-1], axis=1)
        hit = above >= need[:, None]
        found = hit.any(axis=1)  # else fewer than k others: keep all
        pick, rows = hit.argmax(axis=1), np.arange(len(h))
        before = np.where(pick > 0, above[rows, pick - 1], 0)
        inside = np.where(found, above[rows, pick] - before, 0)
        low, need = np.where(found, low + (BINS - 1 - pick) * step, low), np.where(found, need - before, need)
        extra = int(np.where(found & (step > 1), np.maximum(inside - need, 0), 0).sum())
        return pa.Table.from_batches([_row(row["qblock"], row["qids"], row["qdata"], low, need, np.maximum(step // BINS, 1), extra)])

    while n:
        counts = state.select("qblock", "qids", "qdata", "low", "step").crossJoin(two).mapInArrow(histogram, "hblock int, h binary")
        state = cut(counts.groupBy("hblock").cogroup(state.groupBy("qblock")).applyInArrow(narrow, STATE))
        if state.agg(F.sum("open")).first()[0] <= k * n:
            break

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qd, low, ci, cd in zip(*(b.column(c).to_pylist() for c in ("qids", "qdata", "low", "cids", "cdata")), strict=True):
                (qid, q), (cid, c) = _load(qi, qd), _load(ci, cd)
                low, out = _longs(low).astype(np.float64), []
                for at, s in _pairs(q, qid, c, cid):
                    r, x = np.nonzero(s >= low[at : at + len(s), None])
                    v, i = s[r, x], cid[x]
                    order = np.lexsort((i, -v, r))
                    r, v, i = r[order], v[order], i[order]
                    best = np.arange(len(r)) - np.searchsorted(r, r) < k
                    out.append((qid[at + r[best]], i[best], v[best] / float(_ONE)))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["vec_id", "neighbour_id", "score"])

    kept = state.select("qids", "qdata", "low").crossJoin(two).mapInArrow(choose, "vec_id long, neighbour_id long, score double")
    order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id")
    return kept.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k).select("vec_id", "neighbour_id", "place", "score")
