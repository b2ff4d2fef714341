"""A packed exchange of 64-bit pairs: Python tasks hand numpy blobs to buckets instead of a row for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs that a task holds before it hands them on.
FLUSH = 1 << 21

SCHEMA = "bucket int, keys binary, items binary, extra binary"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets split the hash space evenly, by the high half of 64-bit keys."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def blobs(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that occurs, with the values of each column as one blob, in their order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, dtype=np.int64)
    cuts = np.append(first, len(bucket))
    arrays = [pa.array(bucket[first], pa.int32())]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        offsets = (cuts * values.itemsize).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The blobs of a column as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


class Packer:
    """Collects (key, item, extra) triples and yields a row for each bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, keys: np.ndarray, item: int, extra: int | np.ndarray) -> None:
        self.held.append((keys, item, extra))
        self.size += len(keys)

    def full(self) -> bool:
        return self.size >= FLUSH

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys = np.concatenate([k for k, _, _ in self.held])
        items = np.concatenate([np.full(len(k), i, dtype=np.int64) for k, i, _ in self.held])
        extra = np.concatenate([np.broadcast_to(np.asarray(e, dtype=np.int64), len(k)) for k, _, e in self.held])
        yield self.rows(keys, items, extra)
        self.held, self.size = [], 0

    def rows(self, keys: np.ndarray, items: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
        return blobs(bucket_of(keys, self.buckets), {"keys": keys, "items": items, "extra": extra})


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, items, extra) of one bucket, sorted by key, item, extra."""
    keys, items, extra = (joined(table.column(c), t) for c, t in (("keys", np.uint64), ("items", np.int64), ("extra", np.int64)))
    order = np.lexsort((extra, items, keys))
    return keys[order], items[order], extra[order]


def buckets_for(pairs: int, each: int = 1 << 20) -> int:
    """How many buckets keep about `each` pairs apiece, whatever the corpus."""
    return max(1, -(-pairs // each))


def packed(make: Callable[[Packer, pa.RecordBatch], None], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: `make` adds a batch's pairs to the packer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for b in batches:
            make(packer, b)
            if packer.full():
                yield from packer.flush()
        yield from packer.flush()

    return run
