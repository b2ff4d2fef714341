"""Shared parts of the training-data operators: Arrow text access, vectorised hashing, checkpoints.

Words are maximal runs of bytes other than the ASCII white space ``[ \\t\\n\\x0b\\f\\r]``.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 17)
        tables = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        have = _POWERS[which] = (tables[0], tables[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a UTF-8 text start and end."""
    padded = np.ones(len(raw) + 2, dtype=bool)
    padded[1:-1] = SPACE[raw]
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    up, down = _powers(0, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of q words."""
    n = len(words) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(1, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[q:] - sums[:-q]) * down[:n] + np.uint64(q))


def raw_texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each string of an Arrow column, without copying; None for null."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield everything[at[k] : at[k + 1]] if valid[k] else None


def int64s(column: pa.Array, null: int = -(2**63)) -> np.ndarray:
    """An integer column with nulls replaced."""
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def arrow_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once by bytes as well as by rows, if the session's bounds are wider; send it this code by value."""
    import evalweave.llm

    cloudpickle.register_pickle_by_value(evalweave.llm)  # executors need not have the package installed
    for name, most in (("maxBytesPerBatch", 8 << 20), ("maxRecordsPerBatch", 4096)):
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a single machine, as in tests, an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="evalweave-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder and read it from there from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sent_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, which must be cheap to count, marked for broadcast if it has fewer rows than that; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() < rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def has_words(text: Column) -> Column:
    """True where a text isn't null and has a character that isn't white space."""
    return F.coalesce(F.length(F.trim(text, F.lit(" \t\n\x0b\f\r"))) > 0, F.lit(False))


def share(key: Column, parts: int, salt: int) -> Column:
    """A deterministic number below parts for a key, uniform over keys."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(parts))
