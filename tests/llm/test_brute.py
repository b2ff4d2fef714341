"""Operators that SQL can't express, against plain Python; ties, repeated rows, odd magnitudes, crowds and clashing names."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalweave.llm import ann, common, langid, mixing, packing, partenum, quality, suffix_dedup, topk, urlfilter, ziv_merhav

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def frame(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), "s", 0 if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


# packing


def brute_packs(lengths, limit):
    """Shortest-pack-first, a piece at a time, lengths falling: the words in each pack, sorted.

    A piece goes to the shortest open pack; once that has no room, the rest of its length open packs of their own.
    """
    opened, closed = [], []
    for n, pieces in sorted(Counter(lengths).items(), reverse=True):
        opening = False
        for _ in range(pieces):
            opening = opening or not opened or min(opened) + n > limit
            used = 0
            if not opening:
                opened.remove(used := min(opened))
            (closed if used + n == limit else opened).append(used + n)
    return sorted(closed + opened)


def test_packing_piece_by_piece(spark):
    rng = random.Random(4)
    texts = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 30, 47])))) for i in range(150)]
    texts += [(1, texts[1][1]), (None, "a b c"), (None, "a b c"), (200, None)]
    got = packing.packed_documents(frame(spark, texts), 20).collect()
    pieces = [min(20, n - k) for _, t in texts for n in [len((t or "").split())] for k in range(0, n, 20)]
    packs = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["pack_id"], r["pack_offset"])):
        packs[r["pack_id"]].append(r["n_words"])
    assert sorted(map(sum, packs.values())) == brute_packs(pieces, 20)
    assert Counter((r["doc_id"], r["start_word"], r["n_words"]) for r in got) == Counter((i, k, min(20, n - k)) for i, t in texts for n in [len((t or "").split())] for k in range(0, n, 20))


# suffix dedup


def brute_spans(rows, size):
    """(doc_id, start, end, keep) from whole lists of words."""
    places = defaultdict(list)
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            places[tuple(w[k : k + size])].append((i, t, k))
    marks = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for n, (i, t, k) in enumerate(found):
                marks[i, t, n == 0].add(k)
    out = set()
    for (i, _, keep), at in marks.items():
        begin = last = None
        for k in sorted(at):
            if last is not None and k > last + size:
                out.add((i, begin, last + size, keep))
                begin = None
            begin, last = k if begin is None else begin, k
        out.add((i, begin, last + size, keep))
    return out


def test_suffix_dedup_overlaps_repeats_and_ties(spark):
    rng = random.Random(9)
    shared = [" ".join(f"p{rng.randint(0, 500)}" for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = [(1, "a " * 40), (2, "b " + "a " * 12), (3, "x y " * 20), (4, "one two three"), (None, shared[0]), (5, None), (6, "a " * 40)]
    for i in range(10, 60):
        rows.append((i, " ".join(itertools.chain.from_iterable((f"u{rng.randint(0, 9999)}", rng.choice(shared)) for _ in range(rng.randint(1, 3))))))
    rows += [rows[0], rows[10], (11, "another text of eleven")]
    got = {tuple(r) for r in suffix_dedup.repeated_spans(frame(spark, rows), 9).collect()}
    assert got == brute_spans(rows, 9)


def test_suffixes_of_a_task_send_one_for_each_name():
    held = suffix_dedup.Suffixes(4)
    name = np.array([7, 7, 9], dtype=np.uint64)
    for item in range(100):
        held.add(name, name, item, 5, np.array([0, 3, 4]))
    (batch,) = held.flush()
    bucket, keys = batch.column("bucket").to_pylist(), [np.frombuffer(b, np.uint64) for b in batch.column("keys").to_pylist()]
    sent = np.concatenate([k for b, k in zip(bucket, keys, strict=True) if b >= 0])
    assert sorted(sent.tolist()) == [7, 9] and sum(map(len, keys)) == 300


def test_names_agree_with_passages():
    a = np.frombuffer(b"u v a b c d e f g", dtype=np.uint8)
    b = np.frombuffer(b"a b c d  e f\tg z", dtype=np.uint8)
    for q in (1, 2, 3, 5, 7):
        assert suffix_dedup.names(a, q)[2] == suffix_dedup.names(b, q)[0] and len(suffix_dedup.names(a, q)) == 10 - q
        assert len(set(suffix_dedup.names(a, q).tolist())) == 10 - q


# mixing


def test_mixing_ties_and_nulls(spark):
    rows = [(i % 50, "t", "en", None if i % 7 == 0 else "abc"[i % 3], None if i % 5 == 0 else i) for i in range(100)]
    df = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit("x"))
    got = mixing.mixed(df)
    assert got.columns == [*df.columns, "_copies"] and got.filter("source IS NULL").count() > 0
    assert mixing.mixed(df.limit(0)).count() == 0


# language ID


def brute_profile(text, table):
    size, shift = langid.SYMBOLS, table.shape[1]
    s = []
    raw = text.encode()
    for k, x in enumerate(raw):
        if 65 <= x <= 90 or 97 <= x <= 122:
            s.append((x | 32) - 96)
        elif 128 <= x < 192:
            s.append(27 + (raw[k - 1] * 64 + x) % 229)
        elif x < 128:
            s.append(0)
    s = [0, *s, 0]
    s = [x for k, x in enumerate(s) if k == 0 or x or s[k - 1]]
    total = [0] * shift
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        if b:
            for d in range(shift):
                total[d] += int(table[a][(d - 2) % shift]) * int(table[b][(d - 1) % shift]) * int(table[c][d])
    assert size > max(s)
    return np.array(total)


def test_profiles_are_bundles_of_bound_vectors():
    table = langid.letters()
    texts = ["Hello, world", "ça va été", "Привет мир", "", "42 !", "aaaa"]
    got = langid.profiles([np.frombuffer(t.encode(), dtype=np.uint8) for t in texts] + [None], table)
    for t, p in zip(texts, got, strict=False):
        assert np.array_equal(p, brute_profile(t, table)), t
    assert not got[-1].any()


def test_alphabets_are_told_apart_and_ties_go_to_the_first(spark):
    rows = [(1, "αβγ δεζ ηθι", "el"), (2, "привет как дела", "ru"), (3, "hello how are you", "en"), (4, "hello how are you", "xx"), (5, "δεζ αβγ", None), (6, "как привет", None), (7, "how are", None), (8, "12 3", None)]
    df = spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows], DOCS)
    got = {r["doc_id"]: r for r in langid.identify(df, langid.prototypes(df)).collect()}
    assert [got[i]["predicted"] for i in (5, 6, 7, 8)] == ["el", "ru", "en", None] and got[7]["margin"] == pytest.approx(0, abs=1e-6)


# URL filter


def test_first_tree_follows_the_gradients():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(60) < 0.1)).astype(float)
    weight = rng.uniform(0.5, 2, 60)
    model = urlfilter.boost(x, y, weight)
    mean = (weight * y).sum() / weight.sum()
    g, h = weight * (mean - y), weight * mean * (1 - mean)

    def gain(rows, j, at):
        left = rows & (x[:, j] <= at)
        parts = [(g[m].sum(), h[m].sum()) for m in (left, rows & ~left, rows)]
        return parts[0][0] ** 2 / (parts[0][1] + 1) + parts[1][0] ** 2 / (parts[1][1] + 1) - parts[2][0] ** 2 / (parts[2][1] + 1)

    everything = np.ones(60, dtype=bool)
    best = max((gain(everything, j, at), -j, -at) for j in range(3) for at in range(6))
    assert gain(everything, model.split[0][0], model.at[0][0]) == pytest.approx(best[0])
    node = np.zeros(60, dtype=int)
    for _ in range(urlfilter.DEPTH):
        node = 2 * node + 1 + (x[np.arange(60), model.split[0][node]] > model.at[0][node])
    for leaf in set(node):
        m = node == leaf
        assert model.leaf[0][leaf - len(model.split[0])] == pytest.approx(-urlfilter.RATE * g[m].sum() / (h[m].sum() + 1))


def test_url_labels_that_no_suffix_tells(spark):
    rng = random.Random(8)
    rows = []
    for k in range(1500):
        bad = k % 3 == 0
        host = f"{rng.choice(['shop', 'news', 'blog'])}{rng.randint(1, 30)}.{rng.choice(['com', 'org', 'net'])}"
        path = "/".join(f"{rng.randint(10**5, 10**7)}" if bad else rng.choice(["about", "read", "index"]) for _ in range(rng.randint(2, 5)))
        rows.append((k, f"http://{host}/{path}" + ("?a=1&b=2&c=3" if bad and k % 2 else ""), int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    model = urlfilter.fit(df.filter("page_id < 1000").withColumn("fold", F.lit("clash")))
    got = urlfilter.score(df.filter("page_id >= 1000"), model).join(df.select("page_id", "bad"), "page_id").collect()
    assert np.mean([r["blocked"] == bool(r["bad"]) for r in got]) > 0.97
    assert urlfilter.score(df.limit(0), model).count() == 0


def test_hosts_lose_port_and_user(spark):
    df = spark.createDataFrame([("http://u:p@spam-farm.x.com:80/a",), ("http://spam-farm.x.com",), ("http://x.com/@spam-farm.x.com/",)], "url string")
    assert sorted(r["bad"] for r in urlfilter.labelled(df).collect()) == [0, 1, 1]
    got = urlfilter.features(pa.array(["http://u:p@ab.x.com:80/a", "http://ab.x.com/a"]), {"x.com": (0.5, 1.0)}, 0.1)
    assert got[0][1] == got[1][1] == 8 and got[0][-2] == 0.5


# quality


def brute_grams(text):
    raw = b" " + text.encode() + b" "
    return {raw[k : k + 4] for k in range(len(raw) - 3)}


def test_hinge_loss_reaches_its_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, rng.integers(5, 20))).astype(np.uint32) for _ in range(120)]
    y = np.where([r[r < 20].size > r[r >= 20].size for r in rows], 1.0, -1.0)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    cost = 4.0
    w, ratio, bias, floor = quality.fit_linear(np.concatenate(rows), ends, y, cost, epochs=400)
    counts = np.ones((2, quality.SIZE))
    for r, s in zip(rows, y, strict=True):
        counts[int(s > 0)][r] += 1
    assert np.allclose(ratio, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()))
    x = np.zeros((len(rows), 41))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum() + floor)
        x[k, 40] = 1
    primal = lambda v: 0.5 * v @ v + cost * np.maximum(0, 1 - y * (x @ v)).sum()
    found = np.append(w[:40], bias)
    # projected gradient ascent on the dual gives a lower bound of the optimum
    a, gram = np.zeros(len(y)), (x * y[:, None]) @ (x * y[:, None]).T
    step = 1 / np.linalg.norm(gram, 2)
    for _ in range(30_000):
        a = np.clip(a + step * (1 - gram @ a), 0, cost)
    dual = a.sum() - 0.5 * a @ gram @ a
    assert dual - 1e-6 <= primal(found) <= dual * 1.01 + 1e-3


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.filter("doc_id % 3 > 0"), labels)
    held = docs.filter("doc_id % 3 = 0").withColumns({"q": F.lit(1), "keep": F.lit("x")})
    got = quality.score(held, model).join(labels, "doc_id").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1 and r["toxic"] == 0) for r in got]) > 0.9
    kept = quality.keep_good(held, model)
    assert kept.columns == held.columns and kept.count() < held.count()


def test_scores_follow_the_weights(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    scratch = np.zeros(1 << quality.BITS, dtype=np.int32)
    for text in ("plain words here", "!!! @@@ ###", "x"):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        f = quality.features(raw, scratch)
        grams = f[f < 1 << quality.BITS]
        assert len(set(f.tolist())) == len(f) and len(grams) <= max(1, len(brute_grams(text))) <= len(grams) + 2
        ((good, _),) = quality._scores((model.weights, model.ratios, model.bias, model.floor, model.fitted), iter([raw]))
        assert good == pytest.approx(model.weights[f, 0].astype(float).sum() / math.sqrt(model.ratios[f, 0].astype(float).sum() + model.floor[0]) + model.bias[0])


# nearest neighbours and exact search


def test_odd_magnitudes(spark):
    df = spark.createDataFrame([(1, [1e-200, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1e200, 1.0])], "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "block": F.lit("x"), "score": F.lit(0)})
    got = topk.top_k(df, 2).collect()
    assert Counter(r["vec_id"] for r in got) == dict.fromkeys((1, 2, 3, 4), 2)
    assert {(r["neighbour_id"], r["place"], r["score"]) for r in got if r["vec_id"] == 1} == {(2, 1, 1.0), (4, 2, 1.0)}


def test_top_k_over_many_blocks_and_ties(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 8))
    v[100:160] = v[99]
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, block=50)
    x = np.floor(v / np.linalg.norm(v, axis=1)[:, None] * 2.0**24 + 0.5)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(c), p + 1) for q in range(700) for p, c in enumerate(np.lexsort((np.arange(700), -s[q]))[:10])}
    assert {(r["vec_id"], r["neighbour_id"], r["place"]) for r in got.collect()} == want


def test_equal_neighbours_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [1.0, 0.0, 0.0, 0.0]) for k in range(100)] + [(500 + k, [float(x) for x in rng.standard_normal(4)]) for k in range(100)]
    want = None
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(0), "list": F.lit("x")})
        got = {(r["vec_id"], r["neighbour_id"]) for r in ann.neighbours(df).collect()}
        assert {n for q, n in got if q == 50} == set(range(10)) and (want is None or got == want)
        want = got


def test_scan_abandons_only_what_is_far():
    rng = np.random.default_rng(6)
    q, x = (rng.standard_normal((n, 64)).astype(np.float32) for n in (50, 400))
    q, x = (m / np.linalg.norm(m, axis=1)[:, None] for m in (q, x))
    far = ((q[:, None, :].astype(float) - x[None]) ** 2).sum(axis=2)
    limit = np.sort(far, axis=1)[:, 9]
    r, j = ann.scan(q, ann._norms(q), limit, x, ann._norms(x))
    left = np.zeros(far.shape, dtype=bool)
    left[r, j] = True
    close = far <= limit[:, None]
    assert (left & close).sum() >= 0.98 * close.sum() and not (left & (far > limit[:, None] * 1.001)).any()


# Jaccard join


def test_crowded_signatures_are_paired_in_tiles():
    names = np.arange(1, 3001, dtype=np.uint64) << np.uint64(24) | np.arange(3000, dtype=np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b"\0" + np.zeros(3000, np.uint32).tobytes()]), pa.array([names.tobytes()])], ["bucket", "keys", "names"])
    seen = set()
    for out in partenum.meet(iter([batch])):
        assert len(out) <= 2 * partenum.HELD
        seen |= set((out.column("a").to_numpy() * 4096 + out.column("b").to_numpy()).tolist())
    assert len(seen) == 3000 * 2999 // 2


def test_packed_signatures_come_back():
    rng = np.random.default_rng(14)
    for n, buckets in ((1, 1), (50, 3), (5000, 3), (200_000, 2)):
        token, names = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64)
        batch = partenum.packed_signatures(token, names, buckets)
        got = set()
        for k, b in enumerate(batch.column("bucket").to_pylist()):
            keys = partenum.unpacked_keys(pa.chunked_array([batch.column("keys").slice(k, 1)]))
            got |= {(b, *x) for x in zip(keys.tolist(), np.frombuffer(batch.column("names")[k].as_py(), dtype=np.uint64).tolist(), strict=True)}
        assert got == set(zip(partenum.bucket_of(token, buckets).tolist(), (token & np.uint64(0xFFFFFFFF)).tolist(), names.tolist(), strict=True))


def test_many_near_equal_texts(spark):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for i in range(700):
        words = list(base)
        words[i % 60] = f"n{i}"
        texts.append((i, " ".join(words)))
    texts += [(1000 + i, " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(50)]
    df = frame(spark, texts).withColumns({"entity": F.lit(1), "place": F.lit("x"), "lead": F.lit(2), "doc_a": F.lit(3)})
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in partenum.linked(df).collect()}
    assert got == dict.fromkeys(range(700), (0, 699)) | {1000 + i: (1000 + i, 0) for i in range(50)}


def test_signatures_of_all_sizes_and_thresholds():
    rng = np.random.default_rng(12)
    level = np.zeros(partenum.COUNTERS, dtype=np.uint8)
    level[rng.integers(0, partenum.COUNTERS, partenum.COUNTERS // 2)] = rng.integers(1, 60, partenum.COUNTERS // 2)
    for t in (0.55, 0.7, 0.9):
        for size in (1, 2, 3, 4, 5, 7, 12, 15, 16, 40, 63, 64, 200, 255, 256, 700):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            for _ in range(12):
                # a partner just at the threshold, by dropping or by exchanging features
                drop = rng.integers(0, size - math.ceil(t * size - 1e-9) + 1)
                kept = rng.permutation(a)[: len(a) - drop]
                add = int(len(kept) / t + 1e-9) - len(a)
                b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.integers(0, max(add, 0) + 1)).astype(np.uint64)]))
                common = len(np.intersect1d(a, b))
                if common >= t * (len(a) + len(b) - common) - 1e-9:
                    token, who = partenum.signatures([a, b], t, level)
                    assert set(token[who == 0].tolist()) & set(token[who == 1].tolist()), (t, size, len(b))
    with pytest.raises(ValueError):
        partenum.linked(None, threshold=0.5)


# LM scoring


def test_scores_don_t_hang_on_the_size_of_buckets(spark):
    rng = random.Random(13)
    texts = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 80)))) for i in range(40)]
    rows = [(i, t, "fr" if i % 9 == 0 else "en", "s", 1) for i, t in texts] + [(90, texts[1][1], "xx", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("x"), "salt": F.lit(1), "phrases": F.lit(0)})
    marks = spark.createDataFrame([(i, 1, 0) for i in range(1, 40, 2)] + [(3, 0, 0), (5, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = [sorted(map(tuple, ziv_merhav.scores(df, marks, size).collect())) for size in (50, 10**6)]
    assert got[0] == got[1] and len(got[0]) == 41
    alone = next(r for r in got[0] if r[0] == 90)
    assert alone[2] == alone[1]  # a language without reference: every word is a phrase


def test_suffixes_in_full_order():
    rng = random.Random(17)
    passage = [rng.randint(2, 9) for _ in range(90)]
    texts = [[*passage[rng.randint(0, 9) :], *(rng.randint(2, 4) for _ in range(rng.randint(0, 5)))] for _ in range(60)]
    texts += [[2, 3] * rng.randint(8, 40) for _ in range(20)] + [[5] * 300, passage]
    text = np.array([w for t in texts for w in [*t, 0]] + [0] * (ziv_merhav.CAP + ziv_merhav.STEP), dtype=np.uint64)
    at = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0))
    words = {p: tuple(text[p : p + np.flatnonzero(text[p:] == 0)[0]].tolist()) for p in at.tolist()}
    places, keys, first = ziv_merhav.sorted_suffixes(text, at)
    assert sorted(places.tolist()) == at.tolist() and len(first) == len(keys) + 1
    crowds = 0
    for x, y in itertools.pairwise(first.tolist()):
        run = [words[p] for p in places[x:y].tolist()]
        for head, some in itertools.groupby(run, lambda w: w[: ziv_merhav.CAP]):
            some = list(some)
            if len(head) == ziv_merhav.CAP and len(some) > ziv_merhav.FEW:
                crowds += 1
                assert some == sorted(some)
        heads = [w[: ziv_merhav.CAP] for w in run]
        assert heads == sorted(heads)
    assert crowds > 50


def crowded(texts: int, seed: int) -> list[str]:
    """Texts that hold one passage of 40 words among words of their own."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    return [" ".join([rng.choice("abcd"), *passage[rng.randint(0, 3) :], *(rng.choice("efgh") for _ in range(8))]) for _ in range(texts)]


def test_scores_of_passages_that_many_texts_hold(spark):
    texts = [*crowded(40, 19), *crowded(1, 23), "z " * 50, "z " * 49 + "y", *("u v " * (9 + k) for k in range(20))]
    df = frame(spark, list(enumerate(texts))).withColumn("lang", F.lit("en"))
    marks = spark.createDataFrame([(i, 1, 0) for i in range(len(texts)) if i not in (3, 40)], "doc_id long, quality int, toxic int")
    for size in (60, 10**6):
        got = {r["doc_id"]: r["phrases"] for r in ziv_merhav.scores(df, marks, size).collect()}
        for i, t in enumerate(texts):
            reference = {u for j, u in enumerate(texts) if j not in (3, 40)} - ({t} if texts.count(t) == 1 else set())
            steps = ziv_merhav.automaton([u.split() for u in reference])
            assert got[i] == ziv_merhav.cross_phrases(t.split(), steps), i


class Counted:
    """An array that counts what is read of it."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.reads, self.words = values, 0, 0

    def __getitem__(self, at):
        out = self.values[at]
        self.reads, self.words = self.reads + 1, self.words + np.size(out)
        return out


def test_reads_of_the_index_grow_with_the_logarithm_of_the_reference(spark, tmp_path):
    def reads(texts: int, bucket_words: int) -> tuple[int, int]:
        folder = tmp_path / f"{texts}-{bucket_words}"
        folder.mkdir()
        rows = [(i, True, "en", 1, t) for i, t in enumerate(sorted(set(crowded(texts, 29))))]
        df = spark.createDataFrame(rows, "key long, alone boolean, lang string, salt long, text string").repartition(2)
        ziv_merhav.indexed(common.cut(df), str(folder), bucket_words)
        index = ziv_merhav.Index(str(folder))
        index.text = read = Counted(index.text)
        words = ziv_merhav.hashes(crowded(1, 31)[0].split(), 1)
        text = np.concatenate([words, np.ones(1 + ziv_merhav.CAP + ziv_merhav.STEP, dtype=np.uint64)])
        at = np.arange(len(words))
        lengths, low, high = index.lengths(text, at, np.full((len(at), 2), -1))
        assert lengths[1] == ziv_merhav.CAP
        assert index.longest(text, 1, int(low[1]), int(high[1]), (-1, -1)) >= 37
        return read.reads, read.words

    few, many, parted = reads(50, 10**6), reads(3200, 10**6), reads(3200, 500)
    assert parted == many  # however many buckets there were
    assert many[0] < 4 * few[0] and many[1] < 4 * few[1]  # 64 times the texts


# pipeline


def brute_pipeline(rows, keep, limit):
    """What is left of (doc_id, text, source, n_chars) before packing, in plain Python."""
    rows = [r for r in rows if keep(r[1])]
    grams = {}
    for i, t, *_ in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t).split()
        grams[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))}
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(grams), 2):
        if len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b]) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rows = [r for r in rows if find(r[0]) == r[0]]
    gone = defaultdict(set)
    for i, a, z, kept in brute_spans([(r[0], r[1]) for r in rows], 50):
        if not kept:
            gone[i] |= set(range(a, z))
    rows = [(i, " ".join(w for k, w in enumerate(t.split()) if k not in gone[i]), s, n, bool(gone[i])) for i, t, s, n in rows]
    rows = [r for r in rows if r[1]]
    by = defaultdict(list)
    for i, t, s, n, touched in rows:
        by[s].append((i, t, touched, n))
    shares = {s: math.floor(math.sqrt(len(x)) * 1048576) for s, x in by.items()}
    out = Counter()
    for s, x in by.items():
        want = math.floor(len(rows) * shares[s] / sum(shares.values()) + 0.5)
        z = {i: max(math.floor(math.sqrt(n) * 16), 1) for i, _, _, n in x}
        whole, odds = {}, []
        for i, *_ in x:
            expected = want * z[i] / sum(z.values())
            whole[i], p = math.floor(expected), expected - math.floor(expected)
            u = (int(hashlib.md5(f"{i}|mix".encode()).hexdigest()[:12], 16) + 0.5) / 281474976710656.0
            if p > 0:
                odds.append((u * (1 - p) / (u * (1 - p) + (1 - u) * p), i))
        for _, i in sorted(odds)[: want - sum(whole.values())]:
            whole[i] += 1
        for i, t, *_ in x:
            out[i, len(t.split())] += whole[i]
    return Counter({(i, k, min(limit, n - k)): c for (i, n), c in out.items() if c for k in range(0, n, limit)})


def test_pipeline_against_plain_python(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    inner = (model.weights, model.ratios, model.bias, model.floor, model.fitted)
    keep = lambda t: bool(quality.kept(quality._scores(inner, iter([np.frombuffer(t.encode(), dtype=np.uint8)])))[0])
    # n_chars of a text that was cut is its new length, which the mix weighs
    stages = dict(corpus_pipeline.STAGES)
    third = docs
    for name in list(stages)[:3]:
        third = spark.createDataFrame(stages[name](spark, third, DATA).collect(), docs.schema)
    lengths = {r["doc_id"]: r["n_chars"] for r in third.collect()}
    rows = [(r["doc_id"], r["text"], r["source"], lengths.get(r["doc_id"], 0)) for r in docs.collect()]
    got = corpus_pipeline.run(spark, DATA).collect()
    want = brute_pipeline(rows, keep, packing.MAX_WORDS)
    assert Counter((r["doc_id"], r["start_word"], r["n_words"]) for r in got) == want
    packs = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["pack_id"], r["pack_offset"])):
        packs[r["pack_id"]].append(r["n_words"])
    assert sorted(map(sum, packs.values())) == brute_packs([n for (_, _, n), c in want.items() for _ in range(c)], packing.MAX_WORDS)


def test_pipeline_on_odd_tables(spark, docs, tmp_path):
    odd = [(None, None, None, None, None), (None, "null id, good words of prose", None, None, None), (1, "", "en", "a", 0), (2, " \n", "en", None, 1), (3, "same words here", "en", "a", 15), (3, "same words here", "en", "a", 15), (4, "same words here", "en", "a", 15), (5, "w " * 30_000, "en", "b", 60_000)]
    for name, df in (("odd", spark.createDataFrame(odd, DOCS).withColumns({"gone": F.lit(1), "copies": F.lit("x"), "entity": F.lit(2), "bucket": F.lit(3)})), ("none", docs.limit(0))):
        where = str(tmp_path / name)
        df.write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        got = corpus_pipeline.run(spark, where).collect()
        assert {r["doc_id"] for r in got} == ({None, 3, 5} if name == "odd" else set())
        kept = spark.read.parquet(f"{where}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, kept, where).columns == df.columns


def test_shared_folder_is_not_local_on_a_cluster():
    class Named:
        def __init__(self, master, folder=None):
            self.master, self.folder, self.set = master, folder, None
            self.sparkContext = self

        def getCheckpointDir(self):
            return self.set

        def setCheckpointDir(self, x):
            self.set = x

        def getConf(self):
            return self

        def get(self, _):
            return self.folder

    assert common.shared_folder(Named("spark://x", "/shared")) == "/shared"
    assert common.shared_folder(Named("local[2]"))
    for master in ("spark://x", "local-cluster[1,1,1]", "yarn"):
        with pytest.raises(ValueError):
            common.shared_folder(Named(master))
