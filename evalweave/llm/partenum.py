"""N-gram Jaccard join by PartEnum signatures.

A document's features are its distinct word n-grams, lower-cased (a shorter text has one feature, all
its words). The join finds every pair of feature sets whose Jaccard similarity reaches a threshold t > 1/2.

Signatures. Sets are banded by size, each band four times as wide as the last; a set takes part in its own
band and, if a larger partner may lie there, in the next. In a band whose least size is L the feature domain
is partitioned by hash into g parts, about (1-t) L, and each part into parts of a single feature; the
subsets of size two of each part are enumerated. That similar sets share a subset follows from counting: with
features in any fixed order, a set of size s and a partner share at least ceil(t s) features, so among the
first s - ceil(t s) + g + 1 of each they share at least g + 1, and of g + 1 features two lie in one of the
g parts. So only subsets within that beginning are signatures. (A set of one feature has that as its
signature.) The order puts rare features first, by counts over the whole corpus in a table of fixed
size, then by hash; it steers the cost, never the result. A signature being two rare features, sets
that aren't similar hardly ever share one, however large the corpus.

Equal texts are one entity, under a 64-bit hash of the text, whatever their number. Near copies come in crowds whose pairs
grow with their square, so entities are first gathered in stars: those that share the feature next to two of MINIMA places of the hash
space with a leader, and are similar to it. This steers cost only. Signatures then name the star of their set, not the set, and travel as
packed blobs, sorted and their upper halves as differences, of four bytes of the signature and eight of its star's leader. A
signature that thousands of stars share is paired in tiles. As 1 - Jaccard is a metric, sets of two stars can be similar only if
the leaders' similarity reaches the threshold less what both stars' widest members are apart from them; pairs of leaders are first
held against parity bitmaps, which never rule out such a pair, and what is left is compared as whole sets of 48-bit features, both
in cells of bounded size. Stars that may touch make a block, whose sets are sent once, or in chunks of bounded size to every pair
of chunks, and compared all with all by products of matrices. A tile hands on counts of links and a spanning forest, never the pairs.

Edge cases: null or blank text has no features and links with nothing. Each distinct text of a doc_id is a document; those of one
doc_id are in one class, and its links are counted together. Rows with null doc_id are
ignored. Ties don't arise; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import arrow_batches, cut, gram_hashes, has_words, int64s, mix, raw_texts, sent_if_small, word_bounds, word_hashes
from evalweave.llm.exchange import FLUSH, blobs, bucket_of, buckets_for, joined

NGRAM = 2
THRESHOLD = 0.7
#: Counters of the table by which features are ordered, and the slices in which it is summed.
COUNTERS, SLICES = 1 << 20, 64
#: Signatures in a bucket, about; pairs that a bucket holds before it hands them on; sets a side of a tile of a crowded place.
BUCKET, HELD, TILE = 1 << 21, 1 << 21, 512
#: Rows of two or three ids, a few MB, up to which a table is sent to what it is joined with; beyond, both are shuffled.
SENT = 500_000
#: Places of the hash space by whose next features stars are found; sets, bytes of text and columns of a chunk that is compared with others.
MINIMA, CHUNK, CHUNK_BYTES, COLUMNS = 8, 4096, 8 << 20, 2048
_BAND = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(1, MINIMA + 1, dtype=np.uint64) * _BAND
_PLACES = np.arange(MINIMA, dtype=np.uint64) << np.uint64(61)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(raw: np.ndarray, n: int) -> np.ndarray:
    """The sorted hashes of the distinct word n-grams of a text. Only ASCII is lower-cased."""
    raw = _LOWER[raw]
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    return np.unique(gram_hashes(word_hashes(raw, starts, ends), min(n, len(starts))))


def parts_of(band: np.ndarray, threshold: float) -> np.ndarray:
    """How many parts the features have in a band; sizes of band b begin at 4**b."""
    return np.maximum(1, ((1 - threshold) * 4.0**band).astype(np.int64))


def signatures(sets: list[np.ndarray], threshold: float, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) of at most 4096 sets. level: what commonness() gives, by the high bits of a feature."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
    rare = level[(grams >> np.uint64(44)).astype(np.int64)].astype(np.uint64)
    grams = grams[np.argsort((owner.astype(np.uint64) << np.uint64(52)) | (rare << np.uint64(44)) | (grams >> np.uint64(20)), kind="stable")]
    place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.maximum(sizes, 1)
    own = np.array([(int(s).bit_length() - 1) // 2 for s in some], dtype=np.int64)
    found, whose = [], []
    for band in (own, own + 1):
        g = parts_of(band, threshold)
        least = np.maximum(some, 4**band)  # of a partner that is no smaller
        shared = np.ceil(threshold * least - 1e-9).astype(np.int64)
        begin = np.where(np.floor(some / threshold + 1e-9) >= least, some - shared + g + 1, 0)
        at = np.flatnonzero(place < begin[owner])
        gram, who = grams[at], owner[at]
        salt = band.astype(np.uint64) * _BAND
        part = ((mix(gram + salt[who]) >> np.uint64(32)) * g[who].astype(np.uint64)) >> np.uint64(32)
        home = (who.astype(np.uint64) << np.uint64(32)) | part
        order = np.argsort(home, kind="stable")
        home, who, value = home[order], who[order], mix(gram[order])
        for ahead in range(1, len(home)):
            first = np.flatnonzero(home[ahead:] == home[:-ahead])
            if not len(first):
                break
            found.append(mix(value[first] + value[first + ahead] + salt[who[first]]))
            whose.append(who[first])
        if band is own:
            alone = np.flatnonzero(sizes[who] == 1)
            found.append(mix(value[alone]))
            whose.append(who[alone])
    return np.concatenate(found), np.concatenate(whose)


def commonness(docs: DataFrame, n: int) -> np.ndarray:
    """How common features are in docs (text), by the 20 high bits of their hashes: 4 log2 of 1 and the documents, in whole numbers."""
    size = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros(COUNTERS, dtype=np.int64), False
        for b in batches:
            for raw in raw_texts(b.column("text")):
                np.add.at(table, (features(raw, n) >> np.uint64(44)).astype(np.int64), 1)
                some = True
        if some:
            parts = [table[k * size : (k + 1) * size].astype(np.uint32).tobytes() for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId() // 64] * SLICES, pa.int32()), pa.array(parts, pa.binary())], ["slice", "some", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = np.zeros(size, dtype=np.int64), None
        for b in batches:
            for counts in b.column("counts").to_pylist():
                total += np.frombuffer(counts, dtype=np.uint32)
            key = b.slice(0, 1) if len(b) else key
        if key is not None:
            top = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([key.column("slice"), key.column("some"), pa.array([top.tobytes()], pa.binary())], ["slice", "some", "counts"])

    made = "slice int, some int, counts binary"
    # summed in two steps, so that no group grows with the corpus more than its root does
    got = docs.select("text").mapInArrow(count, made).groupBy("slice", "some").applyInArrow(add, made).groupBy("slice").applyInArrow(add, made).toArrow()
    total = np.zeros(COUNTERS, dtype=np.uint32)
    for k, counts in zip(got.column("slice").to_pylist(), got.column("counts").to_pylist(), strict=True):
        total[k * size : (k + 1) * size] = np.frombuffer(counts, dtype=np.uint32)
    return (4 * np.log2(1.0 + total)).astype(np.uint8)


def _pairs(runs: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs (their lengths and where they begin), at most about HELD at once."""
    for length in np.unique(runs[runs > 1]).tolist():
        at = first[runs == length]
        if length <= 4 * TILE:
            x, y = np.triu_indices(length, 1)
            step = max(1, HELD // len(x))
            for k in range(0, len(at), step):
                yield (at[k : k + step, None] + x).ravel(), (at[k : k + step, None] + y).ravel()
            continue
        for begin in at.tolist():
            for i in range(0, length, TILE):
                x = np.arange(i, min(length, i + TILE))
                for j in range(i, length, 4 * TILE):
                    p, q = np.meshgrid(x, np.arange(j, min(length, j + 4 * TILE)), indexing="ij")
                    p, q = p[p < q], q[p < q]
                    yield begin + p, begin + q


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of names that share a signature of a bucket (keys, names)."""
    table = pa.Table.from_batches(batches)
    keys, names = unpacked_keys(table.column("keys")), joined(table.column("names"), np.uint64)
    del table
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(keys) else order
    keys, names = keys[order], names[order]
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])  # copies have one name
    keys, names = keys[new], names[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    lows, highs, held = [], [], 0

    def row(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

    for p, q in _pairs(np.diff(np.append(first, len(keys))), first):
        lows.append(names[p]), highs.append(names[q])  # names rise within a run
        held += len(p)
        if held > HELD:
            a, b = _distinct(np.concatenate(lows), np.concatenate(highs))
            lows, highs, held = [a], [b], len(a)
            if held > HELD // 2:
                yield row(a, b)
                lows, highs, held = [], [], 0
    if held:
        yield row(*_distinct(np.concatenate(lows), np.concatenate(highs)))


def packed_signatures(token: np.ndarray, names: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row (bucket, keys, names) for each bucket that occurs: signatures sorted by their low 32 bits, the keys of a bucket as one blob.

    A blob of keys begins with 1 and has the low halves of all and then the differences of the upper halves, a byte each; with 0, if
    one of these doesn't fit, it has the keys as they are.
    """
    order = np.argsort((bucket_of(token, buckets).astype(np.uint64) << np.uint64(32)) | (token & np.uint64(0xFFFFFFFF)))
    bucket, keys, names = bucket_of(token[order], buckets), token[order].astype(np.uint32), names[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    made = []
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        part = keys[a:z]
        apart = np.diff(part >> np.uint32(16), prepend=np.uint32(0))
        made.append(b"\1" + part.astype(np.uint16).tobytes() + apart.astype(np.uint8).tobytes() if apart.max() < 256 else b"\0" + part.tobytes())
    cuts = pa.py_buffer((np.append(first, len(keys)) * 8).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(made, pa.binary()), pa.Array.from_buffers(pa.binary(), len(first), [None, cuts, pa.py_buffer(names)])], ["bucket", "keys", "names"])


def unpacked_keys(column: pa.ChunkedArray) -> np.ndarray:
    out = [np.empty(0, dtype=np.uint32)]
    for blob in column.to_pylist():
        if blob[:1] == b"\1":
            n = len(blob) // 3
            upper = np.cumsum(np.frombuffer(blob, dtype=np.uint8, offset=1 + 2 * n), dtype=np.uint32) << np.uint32(16)
            out.append(upper | np.frombuffer(blob, dtype=np.uint16, count=n, offset=1))
        else:
            out.append(np.frombuffer(blob, dtype=np.uint32, offset=1))
    return np.concatenate(out)


def minima(grams: np.ndarray) -> np.ndarray:
    """The first of a set's sorted features at or after each of MINIMA places that split the hash space evenly, going round; scrambled."""
    return mix(mix(grams[np.searchsorted(grams, _PLACES) % len(grams)]) + _SALTS)


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of the least item under a key of a bucket (keys, items) with each other, once a key."""
    table = pa.Table.from_batches(batches)
    keys, items = joined(table.column("keys"), np.uint64), joined(table.column("items"), np.int64)
    order = np.lexsort((items, keys))
    keys, items = keys[order], items[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    root = np.repeat(items[first], np.diff(np.append(first, len(keys))))
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])]) if len(keys) else np.empty(0, dtype=bool)
    new &= root != items
    yield pa.RecordBatch.from_arrays([pa.array(root[new]), pa.array(items[new])], ["a", "b"])


def stars(docs: DataFrame, lead: DataFrame, n: int, threshold: float) -> DataFrame:
    """(entity, leader, jaccard): entities with a leader that they are similar to and that has none itself."""
    buckets = buckets_for(MINIMA * lead.count(), BUCKET)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, items = [], []
        for b in batches:
            for raw, e in zip(raw_texts(b.column("text")), int64s(b.column("entity")).tolist(), strict=True):
                held.append(minima(features(raw, n))), items.append(e)
            if len(held) * MINIMA >= FLUSH // 2:
                keys = np.concatenate(held)
                yield blobs(bucket_of(keys, buckets), {"keys": keys, "items": np.repeat(np.array(items, dtype=np.int64), MINIMA)})
                held, items = [], []
        if held:
            keys = np.concatenate(held)
            yield blobs(bucket_of(keys, buckets), {"keys": keys, "items": np.repeat(np.array(items, dtype=np.int64), MINIMA)})

    signed = docs.select("entity", "text").mapInArrow(sign, "bucket int, keys binary, items binary")
    # two of eight minima, which sets at the threshold rarely lack; it steers cost only
    pairs = signed.groupBy("bucket").applyInArrow(_starred, "a long, b long").groupBy("a", "b").count().filter("count > 1").select("a", "b", F.lit(float(threshold)).alias("least"))
    near = cut(_compared(docs, cut(pairs), lead, n, True))
    near = cut(_compared(docs, near, lead, n, False))
    led = near.select(F.col("b").alias("a")).distinct()
    return cut(near.join(led, "a", "left_anti").groupBy(F.col("b").alias("entity")).agg(F.min(F.struct("a", "jaccard")).alias("s")).select("entity", F.col("s.a").alias("leader"), "s.jaccard"))


def candidates(docs: DataFrame, size: int, n: int, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of the names in docs (name, text) that share a signature. size: bytes of all texts."""
    level = docs.sparkSession.sparkContext.broadcast(commonness(docs, n))
    buckets = buckets_for(size // 8, BUCKET)  # about a signature for each eight bytes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for k in range(0, len(whole), 1024):
                b = whole.slice(k, 1024)
                sets = [features(raw, n) for raw in raw_texts(b.column("text"))]
                token, who = signatures(sets, threshold, level.value)
                held.append((token, int64s(b.column("name")).view(np.uint64)[who]))
                size += len(token)
                if size >= FLUSH // 2:
                    yield packed_signatures(*(np.concatenate(h) for h in zip(*held, strict=True)), buckets)
                    held, size = [], 0
        if size:
            yield packed_signatures(*(np.concatenate(h) for h in zip(*held, strict=True)), buckets)

    signed = docs.select("name", "text").mapInArrow(sign, "bucket int, keys binary, names binary")
    return signed.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def bitmap(grams: np.ndarray) -> bytes:
    """Parities of a set's features by the low bits of their hashes, at least one bit a feature.

    Two sets differ in at least as many features as their bitmaps, folded to one length, differ in bits.
    """
    bits = max(64, 1 << (len(grams) - 1).bit_length())
    parity = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(bool), bitorder="little").tobytes()


def _may_reach(pairs: pa.Table, maps: pa.Table) -> pa.Table:
    """The pairs whose sizes and bitmaps don't rule out the similarity that each must have at least."""
    threshold = np.maximum(pairs.column("least").to_numpy(), 0)
    ids, sizes = maps.column("entity").to_numpy(), maps.column("size").to_numpy()
    blobs = maps.column("blob").to_pylist()
    order = np.argsort(ids)
    ends = [pairs.column(c).to_numpy() for c in ("a", "b")]
    where = [order[np.minimum(np.searchsorted(ids[order], e), len(ids) - 1)] for e in ends]
    wide = np.array([len(x) // 8 for x in blobs])
    slack = np.floor((1 - threshold) / (1 + threshold) * (sizes[where[0]] + sizes[where[1]]) + 1e-9)
    keep = np.zeros(len(ends[0]), dtype=bool)
    near = np.minimum(sizes[where[0]], sizes[where[1]]) >= threshold * np.maximum(sizes[where[0]], sizes[where[1]]) - 1e-9
    common = np.minimum(wide[where[0]], wide[where[1]])
    for words in np.unique(common[near]):
        group = np.flatnonzero(near & (common == words))
        step = max(1, (1 << 20) // int(words))
        used = np.unique(np.concatenate([side[group] for side in where]))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(blobs[k], dtype=np.uint64).reshape(-1, int(words)), axis=0) for k in used])
        for k in range(0, len(group), step):
            g = group[k : k + step]
            x, y = (np.searchsorted(used, side[g]) for side in where)
            apart = np.bitwise_count(folded[x] ^ folded[y]).sum(axis=1, dtype=np.int64)
            keep[g] = apart <= slack[g]
    return pairs.select(["a", "b", "least"]).filter(pa.array(keep))


def packed_set(grams: np.ndarray) -> bytes:
    """A sorted set's six high bytes of each feature."""
    return np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked_set(blob: bytes) -> np.ndarray:
    whole = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    whole[:, 2:] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return whole.view(np.uint64).ravel()


def _reach(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs whose sets reach the similarity that each must have at least, with it."""
    found = {e: unpacked_set(blob) for e, blob in zip(sets.column("entity").to_pylist(), sets.column("blob").to_pylist(), strict=True)}
    out = []
    for x, y, threshold in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "least")), strict=True):
        p, q = found[x], found[y]
        at = np.searchsorted(p, q)
        at[at == len(p)] = 0
        common = int(np.count_nonzero(p[at] == q))
        whole = len(p) + len(q) - common
        if common >= threshold * whole - 1e-9:
            out.append((x, y, threshold, common / whole))
    x, y, t, j = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(t, pa.float64()), pa.array(j, pa.float64())], ["a", "b", "least", "jaccard"])


def _in_cells(pairs: DataFrame, each: int) -> DataFrame:
    """pairs with the number of a cell, about `each` pairs apiece.

    Pairs whose smaller end has the same smallest partner share a cell, so that a set is sent to few
    cells; a place with very many pairs is split in tiles of about TILE sets a side.
    """
    cells = max(1, -(-pairs.count() // each))
    ends = pairs.select(F.col("a").alias("e"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("e"), F.col("a").alias("o")))
    root = cut(ends.groupBy("e").agg(F.least(F.min("o"), F.first("e")).alias("root")))
    rooted = pairs.join(sent_if_small(root.withColumnRenamed("e", "a"), SENT), "a")
    crowded = rooted.groupBy("root").count().filter(F.col("count") > TILE * TILE).select("root", F.ceil(F.sqrt(F.col("count").cast("double")) / TILE).cast("int").alias("tiles"))
    tiled = rooted.join(sent_if_small(cut(crowded), SENT), "root", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    place = F.xxhash64("root", F.pmod(F.xxhash64("a"), "tiles"), F.pmod(F.xxhash64("b"), "tiles"))
    return tiled.select("a", "b", "least", F.pmod(place, F.lit(cells)).cast("int").alias("cell"))


def _compared(docs: DataFrame, pairs: DataFrame, lead: DataFrame, n: int, small: bool) -> DataFrame:
    """The pairs of entities that the bitmaps (small) or else the sets themselves let through. pairs: (a, b, least), with the least similarity wanted; lead: (entity, lead), the least doc_id of each entity."""
    cells = cut(_in_cells(pairs, 1 << 16 if small else 1 << 13))
    wanted = cells.select(F.explode(F.array("a", "b")).alias("entity"), F.col("cell").alias("place")).groupBy("entity").agg(F.collect_set("place").alias("places"))
    few = cut(wanted.join(lead, "entity").select("entity", F.col("lead").alias("doc_id"), "places"))
    # of each entity one document is read; a few MB of ids are sent to the texts, beyond that both are shuffled
    texts = docs.select("doc_id", "entity", "text").join(sent_if_small(few, SENT), ["entity", "doc_id"])

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [features(raw, n) for raw in raw_texts(b.column("text"))]
            made = pa.array([bitmap(g) if small else packed_set(g) for g in sets], pa.binary())
            places = b.column("places")
            row = pa.array(np.repeat(np.arange(len(b)), places.value_lengths().to_numpy()))
            sizes = pa.array([len(g) for g in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([places.flatten(), b.column("entity").take(row), sizes.take(row), made.take(row)], ["place", "entity", "size", "blob"])

    sent = texts.select("entity", "places", "text").mapInArrow(blobs, "place int, entity long, size int, blob binary")

    def judge(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        return (_may_reach if small else _reach)(pairs, sets)

    return cells.groupBy("cell").cogroup(sent.groupBy("place")).applyInArrow(judge, "a long, b long, least double" + ("" if small else ", jaccard double"))


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the weight of those across that it is similar to, and a set of its component. left, right: the same numbers of sets, or disjoint ones."""
    alone = left is right
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column, width = owner[order], column[order], int(np.count_nonzero(shared))
    common = np.zeros((len(left), len(right)), dtype=np.float32)  # whole numbers below 2**24
    for k in range(0, width, COLUMNS):
        who, what = (x[slice(*np.searchsorted(column, [k, k + COLUMNS]))] for x in (owner, column))
        sides = []
        for side in (left,) if alone else (left, right):
            row = np.full(len(sets), -1)
            row[side] = np.arange(len(side))
            ours, m = row[who] >= 0, np.zeros((len(side), min(COLUMNS, width - k)), dtype=np.float32)
            m[row[who[ours]], what[ours] - k] = 1
            sides.append(m)
        common += sides[0] @ sides[-1].T
    hit, links = np.zeros(common.shape, dtype=bool), np.zeros(len(sets), dtype=np.int64)
    for k in range(0, len(left), 256):
        some = common[k : k + 256].astype(np.float64)
        near = some >= threshold * (sizes[left[k : k + 256], None] + sizes[None, right] - some) - 1e-9
        if alone:
            near[np.arange(len(near)), k + np.arange(len(near))] = False
        hit[k : k + 256], near = near, near.astype(np.float64)
        links[left[k : k + 256]] += (near @ weight[right]).astype(np.int64)
        if not alone:
            links[right] += (weight[left[k : k + 256]] @ near).astype(np.int64)
    root = np.arange(len(sets))
    if alone:
        np.fill_diagonal(hit, True)
    free, other = np.ones(len(left), dtype=bool), np.ones(len(right), dtype=bool)
    for first in np.flatnonzero(links[left]).tolist():
        at = np.array([first]) if free[first] else np.empty(0, dtype=np.int64)
        free[first] = False
        while len(at):
            root[left[at]] = left[first]
            across = np.flatnonzero(hit[at].any(axis=0) & other)
            root[right[across]], other[across] = left[first], False
            at = np.flatnonzero(hit[:, across].any(axis=1) & free)
            free[at] = False
    return links, root


def _blocks(near: DataFrame, followers: DataFrame, lead: DataFrame) -> DataFrame:
    """(entity, doc_id, copies, block, chunk, chunks) of the entities of stars that may touch, a block each, in chunks of bounded size."""
    leaders = followers.select(F.col("leader").alias("node")).distinct()
    edges = near.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))
    nodes = leaders.unionByName(edges.select(F.explode(F.array("doc_a", "doc_b")).alias("node"))).distinct()
    blocks = cut(nodes.join(groups(edges).withColumnRenamed("doc_id", "node"), "node", "left").select("node", F.coalesce("leader", "node").alias("block")))
    within = blocks.select(F.col("node").alias("entity"), "block").unionByName(followers.select("entity", F.col("leader").alias("node")).join(blocks, "node").select("entity", "block"))
    within = cut(within.join(lead, "entity"))
    sizes = within.groupBy("block").agg(F.greatest(F.ceil(F.sum("bytes") / CHUNK_BYTES), F.ceil(F.count(F.lit(1)) / CHUNK)).cast("int").alias("chunks"))
    return cut(within.join(sent_if_small(cut(sizes), SENT), "block").select("entity", F.col("lead").alias("doc_id"), "copies", "block", F.pmod(F.xxhash64("entity", F.lit(9)), "chunks").cast("int").alias("chunk"), "chunks", "bytes"))


def _counted(docs: DataFrame, placed: DataFrame, n: int, threshold: float) -> DataFrame:
    """(entity, root, links): what each tile of blocks finds, of entities with links."""
    moved = placed.agg(F.coalesce(F.sum(F.col("bytes") * F.col("chunks")), F.lit(0))).first()[0]
    cells = max(1, -(-moved // CHUNK_BYTES))
    texts = docs.select("doc_id", "entity", "text").join(sent_if_small(placed.drop("bytes"), SENT), ["entity", "doc_id"])
    names = ["cell", "block", "i", "j", "chunk", "entity", "copies", "blob"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            made = pa.array([packed_set(features(raw, n)) for raw in raw_texts(b.column("text"))], pa.binary())
            chunk, chunks = b.column("chunk").to_numpy().astype(np.int64), b.column("chunks").to_numpy()
            row = np.repeat(np.arange(len(b)), chunks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            i, j = np.minimum(chunk[row], other), np.maximum(chunk[row], other)
            block = int64s(b.column("block"))[row]
            cell = mix(mix(block.view(np.uint64) + i.astype(np.uint64) * _SALTS[1]) + j.astype(np.uint64) * _SALTS[2]) % np.uint64(cells)
            for k in range(0, len(row), 1024):
                z = slice(k, k + 1024)
                at = pa.array(row[z])
                yield pa.RecordBatch.from_arrays([pa.array(cell[z].astype(np.int32)), pa.array(block[z]), pa.array(i[z].astype(np.int32)), pa.array(j[z].astype(np.int32)), b.column("chunk").take(at), b.column("entity").take(at), b.column("copies").take(at), made.take(at)], names)

    def count(table: pa.Table) -> pa.Table:
        block, i, j, chunk, entity, copies = (table.column(c).to_numpy() for c in names[1:7])
        blobs, order, out = table.column("blob"), np.lexsort((entity, j, i, block)), []
        new = [x[order][1:] != x[order][:-1] for x in (block, i, j)]
        cuts = np.flatnonzero(np.concatenate([[True], new[0] | new[1] | new[2], [True]]))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = order[a:z]
            at = at[np.concatenate([[True], entity[at][1:] != entity[at][:-1]])]  # a document may have several rows
            left = np.flatnonzero(chunk[at] == i[at[0]])
            right = left if i[at[0]] == j[at[0]] else np.flatnonzero(chunk[at] == j[at[0]])
            if len(at) > 1 and len(left) and len(right):
                links, root = links_within([unpacked_set(blobs[k].as_py()) for k in at.tolist()], left, right, copies[at].astype(np.float64), threshold)
                some = np.flatnonzero(links)
                out.append((entity[at[some]], entity[at[root[some]]], links[some]))
        found = [np.concatenate([np.empty(0, dtype=np.int64), *c]) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 3
        return pa.table(found, ["entity", "root", "links"])

    sent = texts.mapInArrow(send, "cell int, block long, i int, j int, chunk int, entity long, copies long, blob binary")
    return sent.groupBy("cell").applyInArrow(count, "entity long, root long, links long")


def linked(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): of every doc_id its class and the other documents that reach the threshold with it.

    A class is a connected component of the similar documents, under its smallest id. Copies with equal texts are counted
    among the links. The rows are as many as the ids, however large the crowds.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above 1/2, at most 1")
    arrow_batches(docs.sparkSession)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL").withColumn("entity", F.when(has_words(F.col("text")), F.xxhash64("text")))
    docs = every.filter("entity IS NOT NULL")
    members = every.select("doc_id", "entity").distinct()
    lead = cut(docs.groupBy("entity").agg(F.min("doc_id").alias("lead"), F.countDistinct("doc_id").alias("copies"), F.max(F.octet_length("text")).cast("long").alias("bytes")))
    size = lead.agg(F.coalesce(F.sum(F.col("bytes") * F.col("copies")), F.lit(0))).first()[0]
    followers = stars(docs, lead, n, threshold)
    named = docs.join(sent_if_small(followers.select("entity", "leader"), SENT), "entity", "left").select(F.coalesce("leader", "entity").alias("name"), "text")
    pairs = cut(candidates(named, size, n, threshold))
    wide = cut(followers.groupBy("leader").agg((1 - F.min("jaccard")).alias("wide")))
    for c in "ab":
        pairs = pairs.join(sent_if_small(wide.withColumnsRenamed({"leader": c, "wide": f"{c}_wide"}), SENT), c, "left")
    apart = F.coalesce("a_wide", F.lit(0.0)) + F.coalesce("b_wide", F.lit(0.0))
    wanted = F.when(F.coalesce("a_wide", "b_wide").isNull(), float(threshold)).otherwise(F.lit(threshold - 1e-9) - apart)
    near = cut(_compared(docs, cut(pairs.select("a", "b", wanted.alias("least"))), lead, n, True))
    near = cut(_compared(docs, near, lead, n, False))
    counted = cut(_counted(docs, _blocks(near, followers, lead), n, threshold))
    ends = [sent_if_small(lead.select(F.col("entity").alias(c), F.col("lead").alias(f"doc_{c}")), SENT) for c in "ab"]
    links = counted.filter("entity <> root").select(F.col("entity").alias("a"), F.col("root").alias("b")).join(ends[0], "a").join(ends[1], "b")
    several = members.filter("entity IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id")
    same = members.join(several, "doc_id").join(lead, "entity").select(F.col("doc_id").alias("doc_a"), F.col("lead").alias("doc_b"))
    classes = groups(links.select("doc_a", "doc_b").unionByName(same).filter("doc_a <> doc_b").distinct())
    totals = counted.groupBy("entity").agg(F.sum("links").alias("links"))
    rows = members.join(lead, "entity", "left").join(totals, "entity", "left").join(classes.select(F.col("doc_id").alias("lead"), "leader"), "lead", "left")
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("leader", "lead", "doc_id")).alias("class_id"), F.sum(F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("links"))


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, leader) of each document in a pair: connected components, the leader being the smallest id.

    Every round, each document takes the smallest label among its neighbours and then that label's own
    label; rounds grow with the logarithm of the longest chain for the usual star-like groups. Fewer than SENT
    pairs, a few MB, are labelled by the driver.
    """
    pairs = cut(pairs.select("doc_a", "doc_b"))
    if pairs.count() < SENT:
        got = pairs.toArrow()
        ids, at = np.unique(np.concatenate([got.column(c).to_numpy() for c in ("doc_a", "doc_b")]), return_inverse=True)
        label, (u, v) = np.arange(len(ids)), at.reshape(2, -1)
        while len(u):
            least = np.minimum(label[u], label[v])
            before = label.copy()
            np.minimum.at(label, before[u], least)
            np.minimum.at(label, before[v], least)
            while (label[label] != label).any():
                label = label[label]
            if (label[u] == label[v]).all():
                break
        return pairs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64()), "leader": pa.array(ids[label], pa.int64())}))
    edges = cut(pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).unionByName(pairs.select(F.col("doc_b").alias("u"), F.col("doc_a").alias("v"))))
    labels = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        stepped = labels.join(near, "u").select("u", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("j"))
        new = cut(stepped.join(jump, "l", "left").select("u", "was", F.least("l", F.coalesce("j", "l")).alias("l")))
        changed = new.filter("l <> was").limit(1).count()
        labels = new.select("u", "l")
        if not changed:
            return labels.select(F.col("u").alias("doc_id"), F.col("l").alias("leader"))


def one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without those that aren't the leader of their near-duplicate group.

    A group is a class of linked(); its smallest doc_id stays. Rows with null doc_id
    stay. Of rows that repeat a doc_id, all stay or go together.
    """
    gone = linked(docs, n, threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
