"""Quality classifier: naive Bayes support vectors over byte n-grams.

Features are indicators of the hashed byte 4-grams of a text and of its 3-grams of word shapes. Each is scaled by the log-count ratio
of its class counts; on the scaled indicators, shortened to at most unit length, a linear hinge-loss model is fitted
by dual coordinate descent. One model tells high from low quality, a second tells toxic from other
text. The models are fitted on the driver from a bounded sample; scoring is one pass without shuffle,
and the weights that are broadcast have a fixed size (2.4 MB).

Edge cases: null or blank text has null scores and isn't kept. Labels that are null, or whose doc_id
is null, are ignored; several labels of one doc_id count as the worst of them. With no label of either
class, a model scores every text as clean. Repeated rows are scored alike; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import SPACE, arrow_batches, raw_texts, share, word_bounds, word_hashes

NGRAM = 4
BITS = 18
PER_CLASS = 2500
SIZE = (1 << BITS) + (1 << 15)
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[[c for c in range(33, 128) if not chr(c).isalnum() and chr(c) not in ".,;:?'-"]] = 8
#: A document goes if its quality score is below QUALITY or its toxicity score above TOXIC.
QUALITY, TOXIC = 0.0, 0.0


@dataclass
class Model:
    """weights: one column for quality (positive: good), one for toxicity (positive: toxic)."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: np.ndarray
    floor: np.ndarray
    fitted: tuple[bool, bool]


def features(raw: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text, which is framed by spaces first."""
    framed = np.full(len(raw) + 2, 32, dtype=np.uint8)
    framed[1:-1] = raw
    if len(framed) < NGRAM:
        framed = np.concatenate([framed, np.full(NGRAM - len(framed), 32, dtype=np.uint8)])
    n = len(framed) - NGRAM + 1
    code = framed[:n].astype(np.uint32)
    for k in range(1, NGRAM):
        code |= framed[k : n + k].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2246822519)
    code >>= np.uint32(32 - BITS)
    order = np.arange(n, dtype=np.int32)
    scratch[code] = order
    return np.concatenate([code[scratch[code] == order], shapes(raw)])


def shapes(raw: np.ndarray) -> np.ndarray:
    """The distinct runs of three word shapes: capital first, other capital, digit, symbol, repeat of the word before."""
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.empty(0, dtype=np.uint32)
    kind = _KIND[raw]
    has = np.bitwise_or.reduceat(kind, starts).astype(np.uint32)
    shape = has & np.uint32(12)
    shape |= (kind[starts] & 2) >> 1
    inner = kind.copy()
    inner[starts] = 0
    shape |= np.bitwise_or.reduceat(inner, starts) & np.uint8(2)
    words = word_hashes(raw, starts, ends)
    shape[1:] |= (words[1:] == words[:-1]).astype(np.uint32) << np.uint32(4)
    framed = np.full(len(shape) + 4, 31, dtype=np.uint32)
    framed[2:-2] = shape
    return np.unique(framed[:-2] | framed[1:-1] << np.uint32(5) | framed[2:] << np.uint32(10)) + np.uint32(1 << BITS)


def fit_linear(flat: np.ndarray, ends: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(weights of the scaled indicators, log-count ratios, bias, floor) of one two-class model.

    Row i has the indicators flat[ends[i] : ends[i + 1]].
    Dual coordinate descent for the hinge loss: each step solves for one dual variable within
    [0, cost] and moves the primal weights along that row. A row is divided by the root of its squared length plus floor, the median squared
    length, so that a short text, which has little evidence, scores near the bias.
    """
    d = SIZE
    side = np.repeat(y > 0, np.diff(ends))
    counts = np.stack([np.bincount(flat[side == label], minlength=d) + 1.0 for label in (False, True)])
    del side
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = np.zeros(d), 0.0
    values = ratio.astype(np.float32)[flat]
    size = np.array([values[a:z] @ values[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], dtype=np.float64)
    floor = float(np.median(size))
    scale = 1 / np.sqrt(size + floor) if floor else np.ones(len(size))
    squares = size * scale * scale + 1  # with the constant
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            row, v = flat[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]] * scale[i]
            gradient = y[i] * (w[row] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), cost)
            if step := (new - alpha[i]) * y[i]:
                alpha[i] = new
                w[row] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, ratio, bias, floor


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """About per_class labelled documents of each (quality, toxic), by a hash of doc_id."""
    worst = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("q"), F.max(F.col("toxic").cast("int")).alias("t"))
        .filter("q IS NOT NULL AND t IS NOT NULL")
    )
    sizes = worst.groupBy("q", "t").count().collect()  # four rows
    rate = F.lit(0)
    for r in sizes:
        rate = F.when((F.col("q") == r["q"]) & (F.col("t") == r["t"]), F.lit(min(1 << 20, -(-(per_class << 20) // r["count"])))).otherwise(rate)
    few = worst.filter(share(F.col("doc_id"), 1 << 20, 8) < rate)
    # at most about 4 * per_class rows, whatever the corpus: small enough to broadcast
    return docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(few), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit both models on a sample of at most about per_class documents of each class."""
    arrow_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(1 << BITS, dtype=np.int32)
        for b in batches:
            blobs = [features(raw, scratch).tobytes() for raw in raw_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("q"), b.column("t"), pa.array(blobs, pa.binary())], ["doc_id", "q", "t", "f"])

    got = sample_labelled(docs, labels, per_class).mapInArrow(extract, "doc_id long, q int, t int, f binary").toArrow()
    got = got.take(pa.array(np.argsort(got.column("doc_id").to_numpy(), kind="stable")))
    good, toxic = (got.column(c).to_numpy() == 1 for c in ("q", "t"))
    blobs = got.column("f")
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(blobs).to_numpy() // 4)]).astype(np.int64)
    flat = np.empty(ends[-1], dtype=np.uint32)
    for i in range(len(blobs)):
        flat[ends[i] : ends[i + 1]] = np.frombuffer(blobs[i].as_buffer(), dtype=np.uint32)
    del got, blobs
    pa.default_memory_pool().release_unused()
    weights, ratios, bias, floor, fitted = np.zeros((SIZE, 2), np.float32), np.zeros((SIZE, 2), np.float32), np.zeros(2), np.zeros(2), [False, False]
    for k, truth in enumerate((good, toxic)):
        if truth.any() and not truth.all():
            w, r, bias[k], floor[k] = fit_linear(flat, ends, np.where(truth, 1.0, -1.0))
            weights[:, k], ratios[:, k], fitted[k] = w * r, r * r, True
    return Model(weights, ratios, bias, floor, (fitted[0], fitted[1]))


def _scores(model: tuple, raws: Iterator[np.ndarray | None]) -> np.ndarray:
    """Two scores a text; NaN for null or blank text."""
    weights, ratios, bias, floor, fitted = model
    scratch = np.zeros(1 << BITS, dtype=np.int32)
    out = []
    for raw in raws:
        if raw is None or SPACE[raw].all():
            out.append((np.nan, np.nan))
            continue
        f = features(raw, scratch)
        dot, norm = weights[f].sum(axis=0, dtype=np.float64), np.sqrt(ratios[f].sum(axis=0, dtype=np.float64) + floor)
        s = dot / np.where(norm > 0, norm, 1.0) + bias
        out.append((s[0] if fitted[0] else 1.0, s[1] if fitted[1] else -1.0))
    return np.array(out, dtype=np.float64).reshape(-1, 2)


def kept(scores: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (scores[:, 0] >= QUALITY) & (scores[:, 1] <= TOXIC)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, quality_score, toxic_score, keep) for every row of docs."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.ratios, model.bias, model.floor, model.fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(shared.value, raw_texts(b.column("text")))
            cols = [b.column("doc_id"), pa.array(s[:, 0], from_pandas=True), pa.array(s[:, 1], from_pandas=True), pa.array(kept(s))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "quality_score", "toxic_score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, quality_score double, toxic_score double, keep boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the models keep, with all their columns."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.ratios, model.bias, model.floor, model.fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(kept(_scores(shared.value, raw_texts(b.column("text"))))))

    return docs.mapInArrow(run, docs.schema)

