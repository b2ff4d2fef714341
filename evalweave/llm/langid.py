"""Language ID by hyperdimensional profiles.

Every symbol (a lower-cased ASCII letter, a space for any run of other ASCII, or one of 229 classes of the
last two bytes of any other character, so that alphabets are told apart) has a random vector of +1 and -1. A 3-gram is bound by multiplying its symbols'
vectors, permuted once for each place; a text's profile bundles the vectors of its 3-grams. Languages
have prototypes, the bundles of a bounded sample of labelled documents (about TRAIN of each language),
and a document gets the language whose prototype has the greatest cosine with its profile.

Edge cases: null texts and texts without letters get a null language and score 0; every row has a row in
the result. Documents with null lang aren't trained on; without any, all languages are null. Ties go to
the first language by name. Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import arrow_batches, has_words, raw_texts, share

DIMENSIONS = 1024
TRAIN = 1000
SYMBOLS = 256

_SYMBOL = np.zeros(256, dtype=np.int32)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[192:] = -1  # a lead byte counts with the byte that follows


def codes(raw: np.ndarray) -> np.ndarray:
    """Codes of the 3-grams of a text that hold a letter."""
    s = _SYMBOL[raw]
    at = np.flatnonzero((raw >= 128) & (raw < 192))
    s[at] = 27 + (raw[at - 1].astype(np.int32) * 64 + raw[at]) % 229
    s = s[s >= 0]
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one space for a run
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return code[s[1:-1] != 0] if len(s) > 2 else code[:0]


def letters(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIMENSIONS))


def bound(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The vectors of 3-grams: the first symbol's permuted twice, the second's once."""
    a, b, c = code // (SYMBOLS * SYMBOLS), code // SYMBOLS % SYMBOLS, code % SYMBOLS
    return np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]


def prototypes(docs: DataFrame, train: int = TRAIN) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from about `train` documents of each language."""
    arrow_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull())
    sizes = known.groupBy("lang").count().collect()  # one row a language
    rate = F.lit(0)
    for r in sizes:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1 << 20, -(-(train << 20) // r["count"])))).otherwise(rate)
    some = known.filter((share(F.col("doc_id"), 1 << 20, 5) < rate) & has_words(F.col("text"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, raw in zip(b.column("lang").to_pylist(), raw_texts(b.column("text")), strict=True):
                at, n = np.unique(codes(raw), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    got = some.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    lang, code, n = np.array(got.column("lang").to_pylist(), dtype=object), got.column("code").to_numpy(), got.column("n").to_numpy()
    table = letters()
    out = np.zeros((len(langs), DIMENSIONS))
    for k, name in enumerate(langs):
        here = np.flatnonzero(lang == name)
        for part in np.array_split(here, max(1, len(here) // 4096)):
            out[k] += n[part].astype(np.float64) @ bound(code[part], table)
        out[k] /= np.linalg.norm(out[k]) or 1.0
    return langs, out.astype(np.float32)


def profiles(raws: list[np.ndarray | None], table: np.ndarray) -> np.ndarray:
    """The bundles of texts, a row each."""
    each = [np.empty(0, dtype=np.int64) if raw is None else codes(raw) for raw in raws]
    joined = np.concatenate(each) if each else np.empty(0, dtype=np.int64)
    if not len(joined):
        return np.zeros((len(raws), table.shape[1]), dtype=np.float32)
    present, place = np.unique(joined, return_inverse=True)
    row = np.repeat(np.arange(len(raws)), [len(e) for e in each])
    out = np.zeros((len(raws), table.shape[1]), dtype=np.float32)
    for k in range(0, len(present), 4096):
        part = present[k : k + 4096]
        inside = (place >= k) & (place < k + len(part))
        counts = np.bincount(row[inside] * len(part) + place[inside] - k, minlength=len(raws) * len(part))
        out += counts.reshape(len(raws), len(part)).astype(np.float32) @ bound(part, table).astype(np.float32)
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang, predicted, score, margin): the declared and the found language, the cosine and its lead over the next."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, protos = shared.value
        table = letters()
        for whole in batches:
            for k in range(0, len(whole), 256):
                b = whole.slice(k, 256)
                p = profiles(list(raw_texts(b.column("text"))), table)
                norm = np.linalg.norm(p, axis=1)
                cos = (p @ protos.T) / np.where(norm > 0, norm, 1.0)[:, None] if langs else np.zeros((len(b), 1))
                best = cos.argmax(axis=1)
                top = cos[np.arange(len(b)), best]
                rest = np.partition(cos, -2, axis=1)[:, -2] if len(langs) > 1 else np.zeros(len(b))
                found = [langs[i] if ok else None for i, ok in zip(best, norm > 0, strict=True)] if langs else [None] * len(b)
                cols = [b.column("doc_id"), b.column("lang"), pa.array(found, pa.string()), pa.array(top.astype(np.float64)), pa.array((top - rest).astype(np.float64))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "predicted", "score", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "doc_id long, lang string, predicted string, score double, margin double")
