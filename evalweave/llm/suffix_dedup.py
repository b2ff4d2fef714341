"""Suffix-array dedup: word passages that occur more than once, by bucket-pointer refinement.

A suffix is a word position of a document; sorting all suffixes would bring equal passages together.
Only suffixes that can share min_words words with another are sorted.

1. Initial buckets: the q-gram (q = half of min_words) at a suffix names its bucket. Every passage of
   min_words words holds min_words - q + 1 q-grams, and the least of their names is at the same place in
   each copy; only suffixes at such least q-grams are put in buckets (about 2 of min_words - q + 2). A
   suffix alone in its bucket is in its final place and is dropped.
2. Refinement: each suffix whose passage holds a q-gram with company is sorted on its own bucket and on
   the bucket to which a later offset points, so that its new bucket is its first min_words words.

Bucket names are made by the same refinement from single words on: the name of 2k words is made of the names of
k words at a suffix and at offset k, each level reusing the names of the one before (so names() doubles from
one word to q, and the last step points min_words - q ahead). Names hang on contents alone, the same
wherever they are computed, so that a pointer is followed by reading the name at the later offset; only
the levels q and min_words, which drop suffixes, need an exchange. A text is cut on 128 bits of name.

Of the suffixes in a bucket the first, by doc_id and position, is the one to keep; the words that any
other covers are repeats. Where suffixes of one bucket meet within a task, only the first is sent to the
bucket; the others are known to have company and to be repeats, and go straight to their documents. So a passage that
millions of documents share sends a suffix a task, not millions, to one place.

Edge cases: null, blank or short texts have no passage. Rows with one doc_id are told apart by a hash of
their texts; repeated rows (same id, same text) share one verdict and aren't repeats of each other. A
passage may overlap itself ("a a a ..."): its first suffix is kept and all words that a later one covers are repeats.
Null doc_id sorts first. Other columns are untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import arrow_batches, fresh, gram_hashes, has_words, int64s, mix, raw_texts, word_bounds, word_hashes
from evalweave.llm.exchange import FLUSH, SCHEMA, Packer, blobs, bucket_of, buckets_for, joined, unpack

MIN_WORDS = 50
NULL_ID = -(2**63)


def names(raw: np.ndarray, q: int) -> np.ndarray:
    """The bucket name of each suffix of a text that has q words."""
    starts, ends = word_bounds(raw)
    if len(starts) < q:
        return np.empty(0, dtype=np.uint64)
    name, k = word_hashes(raw, starts, ends), 1
    while k < q:
        ahead = min(k, q - k)
        name = refined(name, ahead)
        k += ahead
    return name


def refined(name: np.ndarray, ahead: int) -> np.ndarray:
    """New names of suffixes, made of their own names and those at an offset."""
    return mix(name[:-ahead] * np.uint64(3) + mix(name[ahead:] + np.uint64(ahead)))


def least(name: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the first least name of some run of `window` names."""
    if len(name) < window:
        return np.empty(0, dtype=np.int64)
    at = np.arange(len(name))
    step = 1
    while step < window:  # doubling: the least of 2**k names, then of two overlapping runs
        jump = min(step, window - step)
        a, b = at[: len(at) - jump], at[jump:]
        at = np.where(name[b] < name[a], b, a)
        step += jump
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _by_document(size: int):
    """Hands (document, position) pairs on to buckets of documents; extra holds text hash << 32 | payload."""
    packer = Packer(buckets_for(size))

    def hand(items: np.ndarray, extra: np.ndarray) -> pa.Table:
        if not len(items):
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())], ["bucket", "keys", "items", "extra"])
        return pa.Table.from_batches([packer.rows(mix(mix(items.view(np.uint64)) + (extra.view(np.uint64) >> np.uint64(32))), items, extra)])

    return hand


class Suffixes:
    """Collects (name, check, document, place) of suffixes and sends of each name in hand only the first to its bucket.

    The low bit of extra says that a suffix has company. The others, which have company and aren't first, have
    the bucket -1 - k, k being a bucket of their document.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, name: np.ndarray, check: np.ndarray, item: int, h: int, at: np.ndarray) -> None:
        self.held.append((name, check, np.full(len(name), item, dtype=np.int64), (h << 32) | (at.astype(np.int64) << 1)))
        self.size += len(name)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            name, check, item, extra = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.size = [], 0
            name, check, item, extra, company, first, index = settled(name, check, item, extra)
            back = np.argsort(index)  # in the order of documents, blobs compress well
            name, check, item, extra, first = name[back], check[back], item[back], (extra | company)[back], first[back]
            bucket = np.where(first, bucket_of(name, self.buckets), -1 - (mix(item.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int32))
            yield blobs(bucket.astype(np.int32), {"keys": name, "checks": check, "items": item, "extra": extra})


def settled(name: np.ndarray, check: np.ndarray, item: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes sorted by name, document and place, each once, with (has company, is the first of its name, its index)."""
    order = np.lexsort((extra, item, check, name))
    name, check, item, extra = name[order], check[order], item[order], extra[order]
    place = extra >> 1
    same = (name[1:] == name[:-1]) & (check[1:] == check[:-1])
    new = np.ones(len(name), dtype=bool)  # repeated rows give one suffix twice
    new[1:] = ~same | (item[1:] != item[:-1]) | (place[1:] != place[:-1])
    start = np.flatnonzero(new)
    known = np.bitwise_or.reduceat(extra & 1, start) if len(start) else extra
    name, check, item, extra = name[start], check[start], item[start], extra[start] & ~1
    same = (name[1:] == name[:-1]) & (check[1:] == check[:-1])
    before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
    return name, check, item, extra, (before | after | (known == 1))[: len(name)].astype(np.int64), ~before[: len(name)], order[start]


def _documents(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, text hash, sorted payloads) of each document in a bucket."""
    _, items, extra = unpack(table)
    text = extra >> 32
    first = np.flatnonzero(np.concatenate([[True], (items[1:] != items[:-1]) | (text[1:] != text[:-1])])) if len(items) else np.empty(0, dtype=np.int64)
    for a, b in zip(first, np.append(first[1:], len(items))[: len(first)], strict=True):
        yield int(items[a]), int(text[a]), extra[a:b] & 0xFFFFFFFF


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, repeats, kept): of each document with a repeated passage, the word spans.

    Both are arrays of struct(start_word, end_word), the end exclusive: `repeats` covers the passages whose
    first occurrence is elsewhere, `kept` those that are the first occurrence.
    """
    arrow_batches(docs.sparkSession)
    q = -(-min_words // 2)
    ahead = min_words - q
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(has_words(F.col("text")))
    docs = docs.withColumn("h", text_hash(F.col("text")))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def flushed(make):
        """A mapInArrow function: `make` adds a batch's suffixes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Suffixes(many)
            for b in batches:
                make(held, b)
                if held.size >= FLUSH // 2:
                    yield from held.flush()
            yield from held.flush()

        return run

    def start(held: Suffixes, b: pa.RecordBatch) -> None:
        for i, h, raw in zip(int64s(b.column("doc_id")), int64s(b.column("h")), raw_texts(b.column("text")), strict=True):
            name = names(raw, q)
            at = least(name, ahead + 1)
            if len(at):
                held.add(name[at], np.zeros(len(at), dtype=np.uint64), i, h, at)

    def settle(table: pa.Table) -> pa.Table:
        """Company, and the place of the first, to the documents: extra is text hash << 32 | place << 1 | first."""
        name, check, item, extra = (joined(table.column(c), t) for c, t in (("keys", np.uint64), ("checks", np.uint64), ("items", np.int64), ("extra", np.int64)))
        if table.column("bucket")[0].as_py() < 0:
            return hand(item, extra & ~1)
        _, _, item, extra, company, first, _ = settled(name, check, item, extra)
        some = company == 1
        return hand(item[some], extra[some] | first[some])

    def anchors(table: pa.Table) -> pa.Table:
        ids, hashes, found = [], [], []
        for i, h, at in _documents(table):
            ids.append(i), hashes.append(h), found.append((at >> 1).astype(np.int32).tobytes())
        return pa.table([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], ["i", "g", "anchors"])

    def refine(held: Suffixes, b: pa.RecordBatch) -> None:
        cols = (int64s(b.column("doc_id")), int64s(b.column("h")), raw_texts(b.column("text")), b.column("anchors").to_pylist())
        for i, h, raw, blob in zip(*cols, strict=True):
            name = names(raw, q)
            n = len(name) - ahead
            touched = np.zeros(n + 1, dtype=np.int32)
            at = np.frombuffer(blob, dtype=np.int32)
            np.add.at(touched, np.maximum(at - ahead, 0), 1)
            np.add.at(touched, np.minimum(at + 1, n), -1)
            at = np.flatnonzero(np.cumsum(touched[:n]) > 0)
            starts, ends = word_bounds(raw)
            held.add(refined(name, ahead)[at], gram_hashes(word_hashes(raw, starts, ends), min_words)[at], i, h, at)

    def cover(table: pa.Table) -> pa.Table:
        rows = []
        for i, h, at in _documents(table):
            found = []
            for keep in (0, 1):
                pos = at[(at & 1) == keep] >> 1
                new = np.flatnonzero(np.concatenate([[True], pos[1:] > pos[:-1] + min_words])) if len(pos) else np.empty(0, dtype=np.int64)
                last = (np.append(new[1:], len(pos)) - 1)[: len(new)]
                found.append([{"start_word": int(pos[a]), "end_word": int(pos[z]) + min_words} for a, z in zip(new, last, strict=True)])
            rows.append((None if i == NULL_ID else i, h, *found))
        kind = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32())]))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), kind, kind), strict=True)], ["doc_id", "text_hash", "repeats", "kept"])

    hand, many = _by_document(size // 16), buckets_for(size // 16)
    sent = "bucket int, keys binary, checks binary, items binary, extra binary"
    buckets = docs.mapInArrow(flushed(start), sent).groupBy("bucket").applyInArrow(settle, SCHEMA)
    live = buckets.groupBy("bucket").applyInArrow(anchors, "i long, g long, anchors binary")
    met = docs.join(live, F.coalesce("doc_id", F.lit(NULL_ID)).eqNullSafe(F.col("i")) & (docs["h"] == live["g"])).select("doc_id", "h", "text", "anchors")
    refined_rows = met.mapInArrow(flushed(refine), sent).groupBy("bucket").applyInArrow(settle, SCHEMA)
    place = "array<struct<start_word: int, end_word: int>>"
    return refined_rows.groupBy("bucket").applyInArrow(cover, f"doc_id long, text_hash long, repeats {place}, kept {place}")


def text_hash(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit((1 << 31) - 1))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, keep): a row for each span of words that repeats, see spans()."""
    found = spans(docs, min_words)
    def marked(spans: str, keep: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start_word"].cast("long").alias("start_word"), s["end_word"].cast("long").alias("end_word"), F.lit(keep).alias("keep")))

    one = found.select("doc_id", F.explode(F.concat(marked("repeats", False), marked("kept", True))).alias("s"))
    return one.select("doc_id", "s.start_word", "s.end_word", "s.keep")


def remove_words(raw: np.ndarray, repeats: list[dict]) -> bytes:
    """A text without the given word spans; what stood between words goes with the word before it."""
    starts, _ = word_bounds(raw)
    keep = np.ones(len(raw), dtype=bool)
    for s in repeats:
        keep[starts[s["start_word"]] : starts[s["end_word"]] if s["end_word"] < len(starts) else len(raw)] = False
    return raw[keep].tobytes().strip()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut from text (n_chars, if present, is counted anew).

    One occurrence of each passage stays. A document of which nothing stays is dropped; one without repeats
    is unchanged, null texts included. All columns keep their names and types.
    """
    found = spans(docs, min_words).filter(F.size("repeats") > 0)
    i, h, r = (fresh(docs, c) for c in ("cut_id", "cut_hash", "cut_words"))
    found = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(i), F.col("text_hash").alias(h), F.col("repeats").alias(r))
    joined = docs.join(found, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == found[i]) & (text_hash(docs["text"]) == found[h]), "left").drop(i, h)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut_words = b.column(r)
            b = b.drop_columns([r])
            hit = np.flatnonzero(cut_words.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                at = b.schema.get_field_index("text")
                texts, raws = b.column(at).to_pylist(), list(raw_texts(b.column(at)))
                for k in hit:
                    texts[k] = remove_words(raws[k], cut_words[int(k)].as_py()).decode("utf-8", "ignore")
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.column(at).type))
                n = b.schema.get_field_index("n_chars")
                if n >= 0:
                    counts, touched = b.column(n), np.zeros(len(texts), dtype=bool)
                    touched[hit] = True
                    counts = pc.if_else(pa.array(touched), pc.utf8_length(b.column(at)).cast(counts.type), counts)
                    b = b.set_column(n, b.schema.field(n), counts)
                stays = np.ones(len(texts), dtype=bool)
                stays[[k for k in hit if not texts[k]]] = False
                b = b.filter(pa.array(stays))
            yield b

    return joined.mapInArrow(rewrite, docs.schema)
