"""Exact nearest neighbours by cosine: blocks of vectors are multiplied, and what may be among the best is scored again in doubles.

Each table is packed into blocks of bounded bytes, and each block of queries meets each block of chunks, in tasks that
share out both. A product in single precision is off by no more than a bound that grows with the length of the vectors,
so only chunks within it of the kth best so far are scored as the expression scores.cosine() does, term by term. What each block
hands on, at most k chunks a query, is ranked by the caller. No task holds more than a few blocks, and the k best scores of each of its queries.

The work is the product of the two tables, and the whole of it is done; what moves is each table, once or once a task.
Null vectors, vectors with nulls and those of another length have a cosine of 0, as in the expression; zero vectors too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators.batches import bound

#: The most vectors, and bytes of vectors, in a block; queries multiplied at once; pairs scored at once.
ROWS, BYTES, QUERIES, PAIRS = 4096, 4 << 20, 256, 1 << 16


def _packed(df: DataFrame, key: str, vector: str, name: str, rows: int) -> DataFrame:
    """(block, dim, ids, data), their names after `name`: vectors of one length, by id within a block; dim is -1 for those without a cosine."""
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0), null_placement="at_start"))
            flat, size = b.column(1).flatten(), pc.fill_null(pc.list_value_length(b.column(1)), -1).to_numpy(zero_copy_only=False).copy()
            length = np.maximum(size, 0).astype(np.int64)
            if flat.null_count:
                size[np.repeat(np.arange(len(size)), length)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
            at, x = np.cumsum(length) - length, flat.to_numpy(zero_copy_only=False).astype(kind)
            for dim in np.unique(size).tolist():
                same, each = np.flatnonzero(size == dim), max(1, min(rows, BYTES // (max(dim, 1) * kind.itemsize)))
                for k in range(0, len(same), each):
                    of = same[k : k + each]
                    ids = b.column(0).take(pa.array(of))
                    data = x[at[of, None] + np.arange(max(dim, 0))].tobytes()
                    cols = [pa.array([block]), pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, [f"{name}{c}" for c in ("block", "dim", "ids", "data")])
                    block += 1

    given = df.select(key, vector if single else F.col(vector).cast("array<double>"))
    ids = df.schema[key].dataType.simpleString()
    return given.mapInArrow(run, f"{name}block long, {name}dim int, {name}ids array<{ids}>, {name}data binary").hint("rebalance")


class _Vectors:
    """A block of vectors: by place in doubles, their norms, unit vectors in single precision, and which are zero or can't be scaled."""

    def __init__(self, n: int, dim: int, data: bytes) -> None:
        v = np.frombuffer(data, dtype=np.float32 if len(data) == 4 * n * dim else np.float64).reshape(n, dim)
        self.v = np.ascontiguousarray(v.T, dtype=np.float64)
        total = np.zeros(n)
        for x in self.v:
            total += x * x
        self.norm = np.sqrt(total)
        self.zero = self.norm == 0
        plain = (self.norm > 1e-100) & (self.norm < 1e100)
        self.odd = ~(plain | self.zero)
        self.unit = np.where(plain, self.v / np.where(plain, self.norm, 1.0), 0.0).T.astype(np.float32)


def _cosines(q: _Vectors, c: _Vectors, r: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosine of each pair, its terms added in order as scores.dot() does."""
    out = np.empty(len(r))
    for k in range(0, len(r), PAIRS):
        i, j = r[k : k + PAIRS], x[k : k + PAIRS]
        s, scale = np.zeros(len(i)), q.norm[i] * c.norm[j]
        for a, b in zip(q.v, c.v, strict=True):
            s += a[i] * b[j]
        out[k : k + PAIRS] = np.where(scale == 0, 0.0, s / np.where(scale == 0, 1.0, scale))
    return out


def _best(q: _Vectors, c: _Vectors, k: int, top: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, chunk, cosine) of what may be among the k best of all: at most k a query. top, the k best cosines of each query so far, is brought up to date."""
    n, off = len(c.norm), 2 * (len(c.v) + 8) * 2.0**-24
    first = np.zeros(n, dtype=bool)
    first[np.flatnonzero(~c.odd)[:k]] = True  # a zero vector's best are those with the least ids
    for at in range(0, len(q.norm), QUERIES):
        to = slice(at, at + QUERIES)
        near, low = q.unit[to] @ c.unit.T, top[to].min(axis=1) - off
        near[:, c.odd] = -np.inf
        if n > k and np.isinf(low).any():
            low = np.maximum(low, np.partition(near, n - k, axis=1)[:, n - k] - 2 * off)
        may = near >= np.nextafter(low.astype(np.float32), np.float32(-np.inf))[:, None]
        may[q.zero[to]] = first & (low[q.zero[to], None] <= 0)
        may[:, c.odd] = True
        may[q.odd[to]] = True
        r, x = np.nonzero(may)
        s = _cosines(q, c, r + at, x)
        nan = np.isnan(s)
        up = np.where(nan, np.inf, s)  # NaN is above all
        order = np.lexsort((x, -up, ~nan, r))
        place = np.arange(len(r)) - np.searchsorted(r, r)
        order, place = order[place < k], place[place < k]
        r, x, s, up = r[order], x[order], s[order], up[order]
        new = np.full(top[to].shape, -np.inf)
        new[r, place] = up
        top[to] = np.partition(np.concatenate([top[to], new], axis=1), k, axis=1)[:, k:]
        kept = up >= top[to].min(axis=1)[r]
        yield r[kept] + at, x[kept], s[kept]


def candidates(queries: DataFrame, chunks: DataFrame, k: int, rows: int = ROWS) -> DataFrame:
    """(query_id, chunk_id, s): cosines of queries (query_id, q) and chunks (chunk_id, v), with the k best of each query, ties by chunk_id, among them."""
    k = max(k, 1)
    bound(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, np.ndarray] = {}
        held: tuple = (None, None)
        for b in batches:
            for i in range(b.num_rows):
                qblock, qdim, cblock, cdim = (b.column(x)[i].as_py() for x in ("qblock", "qdim", "cblock", "cdim"))
                qids, cids = b.column("qids")[i].values, b.column("cids")[i].values
                same = qdim == cdim and qdim >= 0
                if held[0] != (cblock, same):
                    held = (cblock, same), _Vectors(len(cids), cdim if same else 0, b.column("cdata")[i].as_py() if same else b"")
                q = _Vectors(len(qids), qdim if same else 0, b.column("qdata")[i].as_py() if same else b"")
                top = tops.setdefault(qblock, np.full((len(qids), k), -np.inf))
                with np.errstate(all="ignore"):
                    found = list(_best(q, held[1], k, top))
                r, x, s = (np.concatenate(a) for a in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(r)), cids.take(pa.array(x)), pa.array(s)], ["query_id", "chunk_id", "s"])

    pairs = _packed(chunks, "chunk_id", "v", "c", rows).crossJoin(_packed(queries, "query_id", "q", "q", rows))
    names = (f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "query_id"), (chunks, "chunk_id")))
    return pairs.mapInArrow(run, f"{', '.join(names)}, s double")
