"""LM scoring by Ziv-Merhav cross-parsing against reference text, symbol by symbol (a symbol is a word).

The reference is every distinct text labelled of high quality and not toxic. A document is factored greedily
into the longest phrases that occur anywhere in the reference of its language (an unknown word is a phrase
of its own). With c phrases over n words and N words in that reference, the cross-entropy is c log2(N + 1) / n
bits a word; less the document's own LZ78 estimate, p log2(p) / n for p incremental phrases, it is the
relative entropy. A document never meets itself: a text that one document alone has is left out of the
reference it is scored against. A text that several documents have is scored against all of it, copies
included, so that equal texts of a language score alike.

The reference is indexed by content. Its words (64-bit hashes salted by the language) lie in one file of the
shared folder; the places of its suffixes are shuffled to buckets by the hash of their first two words, whose
number grows with the reference, and each bucket is sorted by the first CAP words; of more than FEW suffixes
that share these, by all words. As buckets divide the hashes in order, they are then moved into one file for
all, so that a search takes as many steps as the logarithm of the reference, however many buckets there were.
Scoring tasks map these files and find where a suffix would lie; its longest phrase is one it shares with a
neighbour there. Phrases of CAP words or more are compared in full, and only where the factoring comes to them.
Sorted suffixes answer what the states of a suffix automaton would, and unlike it can be split over machines;
automaton() is kept as the measure that tests hold them against. The driver holds a row a partition and
language, and a row a bucket. The shared folder must be mounted as a file system on every machine (an error otherwise).

Edge cases: null or blank text has no row. A null language is one of its own. A language without reference
text scores as against an empty one. Labels with null doc_id or null values don't count; of several labels
of one document the worst does. Rows with null doc_id are scored; repeated rows are scored alike. Other
columns are ignored; an empty table gives an empty result. Words are lower-cased.
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import arrow_batches, cut, gram_hashes, has_words, int64s, mix, sent_if_small, shared_folder, word_bounds, word_hashes
from evalweave.llm.exchange import bucket_of

#: Suffixes of the reference in a bucket, about.
BUCKET = 1_000_000
#: Words by which all suffixes are sorted; words compared at once beyond them; suffixes compared at once; suffixes that share CAP words and are left at that.
CAP, STEP, MANY, FEW = 16, 32, 1 << 15, 16
#: What tasks hand to a bucket: places of suffixes, words with the least and most text that holds them, texts that one document alone has.
BLOBS = ("places", "words", "least", "most", "texts")
#: Files of the index with what a bucket adds to each: the same number of values for those of a line.
FILES = (("places", "runs"), ("pairs", "first"), ("words", "least", "most"), ("texts", "spans"))


def automaton(documents: list[list[str]]) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of the documents; state 0 is the root. No phrase crosses documents."""
    steps: list[dict[str, int]] = [{}]
    link, longest = [-1], [0]
    for words in documents:
        last = 0
        for w in words:
            known = steps[last].get(w)
            if known is not None:  # seen after an earlier document
                if longest[known] == longest[last] + 1:
                    last = known
                    continue
                copy = len(steps)
                steps.append(dict(steps[known]))
                link.append(link[known])
                longest.append(longest[last] + 1)
                link[known] = copy
                p = last
                while p >= 0 and steps[p].get(w) == known:
                    steps[p][w] = copy
                    p = link[p]
                last = copy
                continue
            state = len(steps)
            steps.append({})
            link.append(0)
            longest.append(longest[last] + 1)
            p = last
            while p >= 0 and w not in steps[p]:
                steps[p][w] = state
                p = link[p]
            if p >= 0:
                q = steps[p][w]
                if longest[q] == longest[p] + 1:
                    link[state] = q
                else:
                    copy = len(steps)
                    steps.append(dict(steps[q]))
                    link.append(link[q])
                    longest.append(longest[p] + 1)
                    link[q] = link[state] = copy
                    while p >= 0 and steps[p].get(w) == q:
                        steps[p][w] = copy
                        p = link[p]
            last = state
    return steps


def cross_phrases(words: list[str], steps: list[dict[str, int]]) -> int:
    """Phrases of the greedy factoring of words into longest matches."""
    root, count, at = steps[0], 0, steps[0]
    inside = False
    for w in words:
        to = at.get(w)
        if to is None and inside:
            count += 1
            to = root.get(w)
        if to is None:
            count += 1
            at, inside = root, False
        else:
            at, inside = steps[to], True
    return count + inside


def own_phrases(words: list[str]) -> int:
    """Phrases of the incremental (LZ78) parsing of words."""
    seen: dict[tuple[int, str], int] = {}
    at, count = 0, 0
    for w in words:
        key = (at, w)
        to = seen.get(key)
        if to is None:
            count += 1
            seen[key] = count
            at = 0
        else:
            at = to
    return count + (at > 0)


def hashes(words: list[str], salt: int) -> np.ndarray:
    """A hash of each word in the language of a salt; 0 and 1 are kept for the ends of texts."""
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return np.maximum(mix(word_hashes(raw, *word_bounds(raw)) + np.uint64(salt & (2**64 - 1))), np.uint64(2))


def pairs(text: np.ndarray) -> np.ndarray:
    """A hash of each word with the next."""
    return gram_hashes(text, 2)


def sorted_suffixes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, distinct pair hashes, where each begins): places sorted by pair hash, then by the words up to CAP, then by all words if more than FEW are left, then by place."""
    at = np.sort(at)
    h = mixed_pairs(text, at)
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    group = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, dtype=bool)
    first = np.flatnonzero(group)
    keys = h[first]
    for d in range(2, CAP):
        tied = ~group  # a suffix is tied if it or the next doesn't begin a group
        tied[:-1] |= ~group[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        number = np.cumsum(group)[tied]
        t = text[at[tied] + d]
        order = np.lexsort((t, number))
        at[tied], t = at[tied][order], t[order]
        group[tied[1:]] |= t[1:] != t[:-1]
    begin = np.flatnonzero(group)
    size = np.diff(np.append(begin, len(at)))
    crowd = np.flatnonzero(np.repeat(size > FEW, size))
    at[crowd] = sorted_in_full(text, at[crowd], np.cumsum(group)[crowd])
    return at, keys, np.append(first, len(at))


def sorted_in_full(text: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Places in groups of one number, which share CAP words: each group sorted by all words to the end of the text. A group is parted by a suffix in its middle and what the others share with that, again and again."""
    at = at.copy()
    rest, depth = np.arange(len(at)), np.full(len(at), CAP, dtype=np.int64)
    while len(rest):
        begin = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        size = np.diff(np.append(begin, len(rest)))
        here = at[rest]
        depth, side = common(text, here, np.repeat(here[begin + size // 2], size), depth)
        near = np.where(side < 0, depth, -depth)  # what shares more lies nearer to the middle
        order = np.lexsort((near, side, number))
        at[rest], number, side, near, depth = here[order], number[order], side[order], near[order], depth[order]
        new = np.r_[True, (number[1:] != number[:-1]) | (side[1:] != side[:-1]) | (near[1:] != near[:-1])]
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied &= side != 0  # else equal to the end
        rest, number, depth = rest[tied], np.cumsum(new)[tied], depth[tied]
    return at


def common(text: np.ndarray, at: np.ndarray, other: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that the suffixes at two places share, of which they are known to share depth; -1, 0, 1 as the first is below, equal to or above the other)."""
    depth, side = depth.copy(), np.zeros(len(at), dtype=np.int8)
    for i in range(0, len(at), MANY):
        live, wide = np.arange(i, min(len(at), i + MANY)), STEP
        while len(live):
            along = np.arange(wide)
            x, y = (text[np.minimum((p[live] + depth[live])[:, None] + along, len(text) - 1)] for p in (at, other))
            stop = (x != y) | (x == 0)
            k = stop.argmax(axis=1)
            ended = stop[np.arange(len(live)), k]
            depth[live] += np.where(ended, k, wide)
            j = np.flatnonzero(ended)
            u, v = x[j, k[j]], y[j, k[j]]
            side[live[j]] = (u > v).astype(np.int8) - (u < v)
            live = live[~ended]
            wide = min(2 * wide, max(STEP, MANY * STEP // max(1, len(live))))
    return depth, side


def mixed_pairs(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """As pairs(), of the words at given places."""
    out = np.empty(len(at), dtype=np.uint64)
    for i in range(0, len(at), 1 << 16):
        a = at[i : i + (1 << 16)]
        both = np.stack([text[a], text[a + 1], np.zeros(len(a), dtype=np.uint64)], axis=1).ravel()
        out[i : i + len(a)] = pairs(both)[0::3]
    return out


class Index:
    """The mapped files of a reference."""

    def __init__(self, folder: str) -> None:
        def mapped(name: str, kind: type = np.uint64) -> np.ndarray:
            path = f"{folder}/{name}"
            return np.asarray(np.memmap(path, dtype=kind, mode="r")) if os.path.getsize(path) else np.empty(0, dtype=kind)

        self.text, self.pairs, self.words, self.texts = (mapped(x) for x in ("text", "pairs", "words", "texts"))
        self.least, self.most, self.spans = (mapped(x, np.int64) for x in ("least", "most", "spans"))
        self.places, self.first, self.runs = (mapped(x, small(len(self.text))) for x in ("places", "first", "runs"))
        self.spans = self.spans.reshape(-1, 2)

    def own(self, keys: np.ndarray) -> np.ndarray:
        """Where the text that each document must not meet begins and ends; (-1, -1) for none."""
        out = np.full((len(keys), 2), -1, dtype=np.int64)
        k, hit = _found(self.texts, keys)
        out[hit] = self.spans[k[hit]]
        return out

    def lengths(self, text: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, up to CAP, of the longest phrase at each place `at` of text; suffixes that share two words, from, to). own: where the text that a place must not meet begins and ends, or -1."""
        out, low, high = np.zeros(len(text), dtype=np.int32), np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
        w = text[at]
        order = np.argsort(w)
        k, known = _found(self.words, w[order])
        i, k = order[known], k[known]
        mine = np.flatnonzero(own[i, 0] >= 0)
        alone = mine[(self.least[k[mine]] == own[i[mine], 0]) & (self.most[k[mine]] == own[i[mine], 0])]
        out[at[np.delete(i, alone)]] = 1
        inner = np.flatnonzero((out[at] == 1) & (text[at + 1] > 1))
        h = pairs(text)[at[inner]]
        order = np.argsort(h)
        k, hit = _found(self.pairs, h[order])
        i, k = inner[order[hit]], k[hit]
        for j in range(0, len(i), MANY):
            a, n = i[j : j + MANY], k[j : j + MANY]
            lo, hi = self.first[n].astype(np.int64), self.first[n + 1].astype(np.int64)
            out[at[a]], low[at[a]], high[at[a]] = self._nearest(text, at[a], lo, hi, own[a]), lo, hi
        return out, low, high

    def _nearest(self, text: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Words, up to CAP, that places of text share with any of the suffixes lo..hi, all of which share two, outside their own text; 1 for none."""
        a, b = lo.copy(), hi.copy()
        left, right = np.full(len(at), 2, dtype=np.int32), np.full(len(at), 2, dtype=np.int32)
        live = np.arange(len(at))
        while len(live):
            mid = (a[live] + b[live]) >> 1
            n = np.minimum(left[live], right[live])
            place = self.places[mid].astype(np.int64)
            t, u = self.text[place + n], text[at[live] + n]
            more = np.flatnonzero(t == u)
            n[more] = self._shared(text, at[live[more]], place[more])
            t[more], u[more] = self.text[place[more] + n[more]], text[at[live[more]] + n[more]]
            below = (n < CAP) & (t < u)
            above = (n < CAP) & ~below
            x, y = live[below], live[above]
            a[x], left[x] = mid[below] + 1, n[below]
            b[y], right[y] = mid[above], n[above]
            equal = live[n == CAP]  # it lies on both sides
            a[equal], b[equal] = mid[n == CAP] + 1, mid[n == CAP]
            left[equal] = right[equal] = CAP
            live = live[a[live] < b[live]]
        # the neighbours are a - 1 and b; past the run of the own text, if they are of that
        left[a <= lo], right[b >= hi] = 1, 1
        mine = np.flatnonzero(own[:, 0] >= 0)
        for side, near in ((left, a - 1), (right, b)):
            i = mine[side[mine] > 1]
            place = self.places[near[i]]
            i = i[(place >= own[i, 0]) & (place < own[i, 1])]
            past = self.past(near[i], side is right)
            side[i] = 1
            inside = (past >= lo[i]) & (past < hi[i])
            i, past = i[inside], past[inside]
            side[i] = self._shared(text, at[i], self.places[past].astype(np.int64))
        return np.maximum(left, right)

    def _shared(self, text: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words, up to CAP, that places of text share with suffixes, which share two."""
        along = np.arange(2, CAP + 1)
        apart = self.text[place[:, None] + along] != text[at[:, None] + along]
        apart[:, -1] = True
        return (apart.argmax(axis=1) + 2).astype(np.int32)

    def past(self, near: np.ndarray, after: bool) -> np.ndarray:
        """The suffix after, or before, the run of suffixes of one text in which each lies."""
        ends = self.runs[near]
        return ends.astype(np.int64) if after else np.searchsorted(self.runs, ends) - 1

    def longest(self, text: np.ndarray, at: int, lo: int, hi: int, own: tuple[int, int]) -> int:
        """Words of the longest phrase at a place of text that shares CAP words with suffixes in lo..hi."""
        want = text[at : at + CAP]
        x, y = (self._edge(want, lo, hi, after) for after in (False, True))
        if y - x <= FEW:
            near = np.arange(x, y)
        else:
            a, b, left, right = x, y, CAP, CAP
            while a < b:
                mid = (a + b) >> 1
                n, below = self._match(text, at, int(self.places[mid]), min(left, right))
                if below:
                    a, left = mid + 1, n
                else:
                    b, right = mid, n
            near = []
            for k, after in ((a - 1, False), (a, True)):
                if x <= k < y and own[0] <= self.places[k] < own[1]:
                    k = int(self.past(np.array([k]), after)[0])
                if x <= k < y:
                    near.append(k)
        return max((self._match(text, at, p, CAP)[0] for p in self.places[near].tolist() if not own[0] <= p < own[1]), default=0)

    def _edge(self, want: np.ndarray, lo: int, hi: int, after: bool) -> int:
        """The first suffix of lo..hi whose first words aren't below those wanted, or are above them."""
        while lo < hi:
            mid = (lo + hi) >> 1
            p = int(self.places[mid])
            have = self.text[p + 2 : p + len(want)]
            apart = have != want[2:]
            k = int(apart.argmax())
            if (have[k] < want[k + 2]) if apart[k] else after:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def _match(self, text: np.ndarray, at: int, place: int, n: int) -> tuple[int, bool]:
        """(words that a place of text shares with a suffix, which share n; whether the suffix is below it)."""
        step = STEP
        while True:
            have, want = self.text[place + n : place + n + step], text[at + n : at + n + step]
            size = min(len(have), len(want))
            apart = have[:size] != want[:size]
            k = int(apart.argmax())
            if apart[k]:
                return n + k, bool(have[k] < want[k])
            n, step = n + size, 2 * step


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each wanted key would lie among sorted ones; whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return k, keys[k] == wanted


def small(total: int) -> type:
    """The type of numbers up to a total."""
    return np.uint32 if total < 2**32 else np.int64


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Whole or not at all, also where a task is run twice."""
    part = f"{folder}/{name}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, values)
    os.replace(part, f"{folder}/{name}.npy")


def begins_of(folder: str) -> np.ndarray:
    """Where the texts of a reference begin, in order."""
    path = f"{folder}/begins"
    return np.memmap(path, dtype=np.int64, mode="r") if os.path.getsize(path) else np.empty(0, dtype=np.int64)


def indexed(reference: DataFrame, folder: str, bucket_words: int) -> dict[str, int]:
    """Write the index of (key, alone, lang, salt, text), which must be cut, to a folder: the words of each language."""
    spark = reference.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, texts, words = TaskContext.get().partitionId(), {}, {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                texts[lang] = texts.get(lang, 0) + 1
                words[lang] = words.get(lang, 0) + len(t.lower().split())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(texts), pa.int32()), "lang": pa.array(texts, pa.string()), "texts": pa.array(texts.values(), pa.int64()), "words": pa.array(words.values(), pa.int64())})

    base: dict[int, tuple[int, int]] = {}  # of a part: its first word's place, its first text's number
    words: dict[str, int] = {}
    at = number = 0
    # a row a partition and language; texts of a part stay in their order
    for r in sorted(reference.mapInArrow(count, "part int, lang string, texts long, words long").collect()):
        base.setdefault(r["part"], (at, number))
        at, number = at + r["words"] + r["texts"], number + r["texts"]
        words[r["lang"]] = words.get(r["lang"], 0) + r["words"]
    total = at
    for name, size in (("text", total + CAP + STEP), ("begins", number)):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(8 * size)
    buckets = max(1, -(-total // bucket_words))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number = base.get(TaskContext.get().partitionId(), (0, 0))
        with open(f"{folder}/text", "r+b") as f, open(f"{folder}/begins", "r+b") as g:
            g.seek(8 * number)
            for b in batches:
                parts, begins, firsts, here = [], [], [], at
                for t, salt in zip(b.column("text").to_pylist(), b.column("salt").to_pylist(), strict=True):
                    h = hashes(t.lower().split(), salt)
                    parts += [h, np.zeros(1, dtype=np.uint64)]
                    begins.append(np.full(len(h) + 1, here, dtype=np.int64))
                    firsts.append(here)
                    here += len(h) + 1
                if not parts:
                    continue
                text, begin = np.concatenate(parts), np.concatenate(begins)
                f.seek(8 * at)
                f.write(text.tobytes())
                starts = np.array(firsts, dtype=np.int64)
                g.write(starts.tobytes())
                alone = b.column("alone").to_numpy(zero_copy_only=False).astype(bool)
                key = int64s(b.column("key"))[alone]
                known = np.stack([key, starts[alone], np.append(starts[1:], here)[alone] - 1], axis=1)
                by = np.argsort(bucket_of(key.view(np.uint64), buckets), kind="stable")
                known = known[by]
                real = np.flatnonzero(text)
                order = real[np.lexsort((begin[real], text[real]))]
                first = np.flatnonzero(np.r_[True, text[order][1:] != text[order][:-1]])
                word, least, most = text[order[first]], begin[order[first]], begin[order[np.append(first[1:], len(order)) - 1]]
                inner = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0))
                home = bucket_of(pairs(text)[inner], buckets)
                order = np.argsort(home, kind="stable")
                inner, cuts, word_cuts = inner[order] + at, np.searchsorted(home[order], np.arange(buckets + 1)), np.searchsorted(bucket_of(word, buckets), np.arange(buckets + 1))
                text_cuts = np.searchsorted(bucket_of(known[:, 0].view(np.uint64), buckets), np.arange(buckets + 1))
                used = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(word_cuts) > 0) | (np.diff(text_cuts) > 0)).tolist()
                columns = [[a[c[k] : c[k + 1]].tobytes() for k in used] for a, c in ((inner, cuts), (word, word_cuts), (least, word_cuts), (most, word_cuts), (known, text_cuts))]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", *BLOBS])
                at = here

    def write(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        at, word, least, most = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("places", np.int64), ("words", np.uint64), ("least", np.int64), ("most", np.int64)))
        text, begins = np.memmap(f"{folder}/text", dtype=np.uint64, mode="r"), begins_of(folder)
        known = np.frombuffer(b"".join(table.column("texts").to_pylist()), dtype=np.uint64).reshape(-1, 3)
        known = known[np.argsort(known[:, 0])]
        at, keys, first = sorted_suffixes(text, at)
        begin = np.searchsorted(begins, at, side="right")
        last = np.flatnonzero(np.r_[begin[1:] != begin[:-1], True]) if len(at) else np.empty(0, dtype=np.int64)
        runs = last[np.searchsorted(last, np.arange(len(at)))] + 1 if len(at) else last
        order = np.argsort(word, kind="stable")
        word, least, most = word[order], least[order], most[order]
        new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, dtype=np.int64)
        number = small(total + CAP + STEP)
        least, most = (f.reduceat(x, new) if len(new) else x for f, x in ((np.minimum, least), (np.maximum, most)))
        parts = {"places": at.astype(number), "runs": runs.astype(number), "pairs": keys, "first": first[:-1].astype(number), "words": word[new], "least": least, "most": most, "texts": known[:, 0], "spans": known[:, 1:]}
        for name, values in parts.items():
            _save(folder, f"{name}-{b}", values)
        return pa.table([pa.array([b], pa.int32()), *(pa.array([len(parts[names[0]])], pa.int64()) for names in FILES)], ["bucket", *(names[0] for names in FILES)])

    # every bucket has files, if empty ones
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), *(F.lit(b"").alias(c) for c in BLOBS))
    rows = reference.mapInArrow(place, "bucket int, " + ", ".join(f"{c} binary" for c in BLOBS)).union(every)
    # texts are in their file before any bucket is sorted: a shuffle lies between
    out = "bucket int, " + ", ".join(f"{names[0]} long" for names in FILES)
    sizes = np.array(sorted(map(tuple, rows.groupBy("bucket").applyInArrow(write, out).collect())), dtype=np.int64)[:, 1:]
    ends = np.cumsum(sizes, axis=0)
    for names, end in zip(FILES, ends[-1].tolist(), strict=True):
        for name in names:
            with open(f"{folder}/{name}", "wb") as f:
                if name == "first":
                    f.seek(end * small(total + CAP + STEP)().itemsize)
                    f.write(ends[-1, :1].astype(small(total + CAP + STEP)).tobytes())
    begins = ends - sizes

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's own files go to their places in those for all."""
        for batch in batches:
            for b in batch.column("id").to_pylist():
                for names, begin in zip(FILES, begins[b].tolist(), strict=True):
                    for name in names:
                        path = f"{folder}/{name}-{b}.npy"
                        if not os.path.exists(path):  # the task is run twice
                            continue
                        values = np.load(path)
                        if name in ("first", "runs"):
                            values += values.dtype.type(begins[b, 0])
                        with open(f"{folder}/{name}", "r+b") as f:
                            f.seek(begin * values.itemsize * (values.shape[1] if values.ndim > 1 else 1))
                            f.write(values.tobytes())
                        os.remove(path)
            yield batch

    spark.range(buckets).mapInArrow(move, "id long").count()
    return words


def scores(docs: DataFrame, labels: DataFrame, bucket_words: int = BUCKET) -> DataFrame:
    """(doc_id, n_words, phrases, own_phrases, cross_entropy, relative_entropy) of every document with words."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text").filter(has_words(F.col("text")))
    docs = docs.withColumn("key", F.xxhash64("lang", "text"))
    best = (
        labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("q"), F.max(F.col("toxic").cast("int")).alias("t")).filter("q = 1 AND t = 0").select("doc_id")
    )
    best = sent_if_small(cut(best), 500_000)  # up to a few MB of ids go to the texts; beyond, both are shuffled
    referenced = docs.join(best, "doc_id", "left_semi").dropDuplicates(["key"])
    holders = docs.groupBy("key").agg((F.countDistinct("doc_id") + F.count_if(F.col("doc_id").isNull()) == 1).alias("alone"))
    reference = cut(referenced.join(holders, "key").select("key", "alone", "lang", F.xxhash64("lang").alias("salt"), "text"))
    home = shared_folder(spark)
    if ":" in home.removeprefix("file:").split("/")[0]:
        raise ValueError(f"the index needs a shared folder that is mounted as a file system, not {home}")
    folder = f"{home.removeprefix('file://').removeprefix('file:')}/ziv-merhav-{uuid.uuid4().hex}"
    os.makedirs(folder)
    try:
        return cut(_scored(docs, folder, indexed(reference, folder, bucket_words)))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _scored(docs: DataFrame, folder: str, words_of: dict[str, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder)
        for b in batches:
            texts = [t.lower().split() for t in b.column("text").to_pylist()]
            lines, begins, here = [], [], 0
            owns = index.own(int64s(b.column("key")).view(np.uint64))
            for words, salt in zip(texts, b.column("salt").to_pylist(), strict=True):
                lines += [hashes(words, salt), np.ones(1, dtype=np.uint64)]
                begins.append(here)
                here += len(words) + 1
            text = np.concatenate([*lines, np.ones(CAP + STEP, dtype=np.uint64)])
            at = np.flatnonzero(text > 1)
            lengths, low, high = index.lengths(text, at, np.repeat(owns, [len(w) for w in texts], axis=0))
            rows = []
            for i, lang, words, own, begin in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), texts, owns.tolist(), begins, strict=True):
                n, k, cross = len(words), 0, 0
                steps = lengths[begin : begin + n].tolist()
                while k < n:
                    step = steps[k]
                    if step == CAP:
                        step = index.longest(text, begin + k, int(low[begin + k]), int(high[begin + k]), own)
                    k += step or 1
                    cross += 1
                bits = max(1.0, math.log2(words_of.get(lang, 0) - (own[1] - own[0]) + 1))
                p = own_phrases(words)
                rows.append((i, n, cross, p, cross * bits / max(1, n), (cross * bits - p * math.log2(max(p, 1))) / max(1, n)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "phrases", "own_phrases", "cross_entropy", "relative_entropy"])

    out = "doc_id long, n_words long, phrases long, own_phrases long, cross_entropy double, relative_entropy double"
    return docs.withColumn("salt", F.xxhash64("lang")).mapInArrow(run, out)
