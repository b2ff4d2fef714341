"""The training-data operators against brute force, and their edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalweave.llm import ann, langid, mixing, packing, partenum, quality, suffix_dedup, topk, urlfilter, ziv_merhav

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k}" for k in range(30_000))
ODD = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n", "en", "b", 2), (4, LONG, "en", "b", len(LONG)), (4, LONG, "en", "b", len(LONG)), (None, "some words here", None, None, -3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7) for r in ODD], DOCS + ", copies int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_patterns_pack_every_piece_once():
    rng = random.Random(1)
    for limit in (1, 7, 64):
        histogram = {n: rng.randint(1, 50) for n in range(1, limit + 1) if rng.random() < 0.7 or n == 1}
        found = packing.patterns(histogram, limit)
        used = {}
        for pattern, packs in found:
            assert packs > 0 and sum(n * k for n, k in pattern) <= limit
            for n, k in pattern:
                used[n] = used.get(n, 0) + k * packs
        assert used == histogram
    assert packing.patterns({}, 5) == []


def test_packs_don_t_overlap(spark, docs, odd, none):
    for df in (docs, odd, none):
        rows = packing.packed_documents(df, 100).collect()
        words = sum(len(r["text"].split()) for r in df.collect() if r["text"])
        assert sum(r["n_words"] for r in rows) == words
        for _, pack in itertools.groupby(sorted(rows, key=lambda r: (r["pack_id"], r["pack_offset"])), key=lambda r: r["pack_id"]):
            end = 0
            for r in pack:
                assert r["pack_offset"] == end
                end += r["n_words"]
            assert end <= 100


def test_suffix_dedup_odd(spark, odd, none):
    passage = " ".join(f"p{k}" for k in range(60))
    twice = spark.createDataFrame([(1, "x " + passage + " y", "en", "a", 1), (2, passage, "en", "a", 1), (3, "clean text", "en", "a", 1), (None, None, "en", "a", 1)], DOCS)
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["keep"]) for r in suffix_dedup.repeated_spans(twice).collect()}
    assert got == {(1, 1, 61, True), (2, 0, 60, False)}
    kept = {(r["doc_id"], r["text"]) for r in suffix_dedup.without_repeats(twice).collect()}
    assert kept == {(1, "x " + passage + " y"), (3, "clean text"), (None, None)}
    assert suffix_dedup.without_repeats(odd).count() == odd.count() and suffix_dedup.without_repeats(odd).schema == odd.schema
    assert suffix_dedup.repeated_spans(none).count() == 0


def test_least_is_the_first_least():
    v = np.array([3, 1, 2, 1, 5, 6, 7, 0], dtype=np.uint64)
    for w in (1, 2, 3, 5, 8):
        want = sorted({k + int(np.argmin(v[k : k + w])) for k in range(len(v) - w + 1)})
        assert sorted(set(suffix_dedup.least(v, w).tolist())) == want


def test_mixing_sizes(spark, docs, odd, none):
    goal = {r["s"]: r["want"] for r in mixing.goals(docs).collect()}
    got = {r["source"]: r["n"] for r in mixing.mixed(docs).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert got == {s: n for s, n in goal.items() if n}
    assert mixing.repeated(odd).columns == odd.columns and mixing.repeated(none).count() == 0
    assert mixing.repeated(docs, {"src1": 1.0}).select("source").distinct().count() == 1


def brute_cross(words, reference):
    at = count = 0
    grams = {tuple(d[i:j]) for d in reference for i in range(len(d)) for j in range(i + 1, len(d) + 1)}
    while at < len(words):
        n = 1
        while at + n <= len(words) and tuple(words[at : at + n]) in grams:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def test_cross_parsing():
    rng = random.Random(3)
    for _ in range(60):
        reference = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(3)]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        assert ziv_merhav.cross_phrases(words, ziv_merhav.automaton(reference)) == brute_cross(words, reference)
    assert ziv_merhav.own_phrases(list("aab")) == 2


def test_lm_scores(spark, docs, labels, odd, none):
    got = ziv_merhav.scores(docs, labels).collect()
    assert len(got) == docs.filter(F.trim("text") != "").count() and all(math.isfinite(r["relative_entropy"]) for r in got)
    assert ziv_merhav.scores(odd, labels).count() == 3 and ziv_merhav.scores(none, labels).count() == 0


def test_lm_scores_are_against_the_whole_reference(spark):
    rng = random.Random(7)
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for i in range(80)}
    texts |= {80: texts[3], 81: texts[4], 82: texts[5] + " x " + texts[6], 83: "z z z " * 30, 84: "Y " + "a b " * 40, 85: "a b " * 40, 86: texts[7][:-1] + "q"}
    good = {i for i in texts if i % 2 or i == 6}
    rows = [(i, t, "de" if i % 5 == 0 else "en", "s", 1) for i, t in texts.items()]
    marks = spark.createDataFrame([(i, 1, 0) for i in good] + [(2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ziv_merhav.scores(spark.createDataFrame(rows, DOCS), marks, 100).collect()}
    assert set(got) == set(texts)
    for i, t, lang, *_ in rows:
        alone = sum(u == t and g == lang for _, u, g, *_ in rows) == 1
        reference = [u.lower().split() for u in {u for j, u, g, *_ in rows if j in good and g == lang} if not (alone and u == t)]
        words = t.lower().split()
        assert got[i]["phrases"] == brute_cross(words, reference), i
        assert got[i]["cross_entropy"] == pytest.approx(got[i]["phrases"] * max(1, math.log2(sum(map(len, reference)) + 1)) / len(words))


def test_language_accuracy(spark, docs, odd, none):
    train = docs.filter("doc_id % 2 = 0")
    held = langid.identify(docs.filter("doc_id % 2 = 1 AND length(text) > 60"), langid.prototypes(train)).collect()
    assert np.mean([r["lang"] == r["predicted"] for r in held]) > 0.95
    assert langid.identify(odd, langid.prototypes(train)).count() == odd.count()
    assert langid.identify(odd, langid.prototypes(none)).filter("predicted IS NOT NULL").count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 16)) + 3 * rng.standard_normal((6, 16))[rng.integers(0, 6, 300)]
    v[10:14] = v[9]  # ties
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    rows += [(5, rows[5][1]), (None, rows[0][1]), (900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 3), (904, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_top_k_is_exact(spark, vectors):
    got = topk.top_k(vectors, 5, block=64)
    rows = {r["vec_id"]: r["embedding"] for r in vectors.collect() if r["vec_id"] is not None and r["vec_id"] < 900}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], dtype=np.float64)
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 2.0**24 + 0.5)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {(ids[q], ids[c], p + 1) for q in range(len(ids)) for p, c in enumerate(np.lexsort((ids, -s[q]))[:5])}
    assert {(r["vec_id"], r["neighbour_id"], r["place"]) for r in got.collect()} == want
    assert topk.top_k(vectors.limit(0)).count() == 0
    assert topk.top_k(vectors.filter("vec_id < 3"), 5).count() == 6


def test_neighbours_recall(spark, vectors):
    exact = {(r["vec_id"], r["neighbour_id"]) for r in topk.top_k(vectors, 10).collect()}
    got = {(r["vec_id"], r["neighbour_id"]) for r in ann.neighbours(vectors, 10).collect()}
    assert len(exact & got) / len(exact) >= 0.9
    assert ann.neighbours(vectors.limit(0)).count() == 0


def test_some_queries_against_all_vectors(spark, vectors):
    whole = [r for r in topk.top_k(vectors, 5, block=64).collect() if r["vec_id"] % 50 == 0]
    assert whole and sorted(topk.top_k(vectors, 5, block=64, every=50).collect()) == sorted(whole)
    exact = {(r["vec_id"], r["neighbour_id"]) for r in topk.top_k(vectors, 10, every=50).collect()}
    got = {(r["vec_id"], r["neighbour_id"]) for r in ann.neighbours(vectors, 10, every=50).collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)


def test_url_filter(spark):
    pages = spark.read.parquet(f"{DATA}/../sf0.01/pages.parquet")
    marked = urlfilter.labelled(pages)
    model = urlfilter.fit(marked.filter(F.crc32("url") % 3 > 0))
    got = urlfilter.score(pages, model).join(marked.distinct(), "url").filter(F.crc32("url") % 3 == 0).collect()
    assert np.mean([r["blocked"] == bool(r["bad"]) for r in got]) > 0.95
    strange = spark.createDataFrame([(1, None), (2, ""), (3, "é"), (4, "http://" + "a/" * 9000), (4, "x"), (None, "://?#")], "page_id long, url string")
    assert urlfilter.score(strange, model).count() == 6
    assert urlfilter.score(strange, urlfilter.fit(marked.limit(0))).filter("blocked").count() == 0


def test_url_labels_and_statistics(spark):
    bad = [f"https://{at}{name}.example.{end}/x{k}" for name in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x") for at in ("", "m.") for k, end in enumerate(("com", "net", "org"))]
    good = [f"http://site{k}.example.{'com' if k % 4 else 'org'}/spam-farm.example.org/{k}" for k in range(300)] + ["http://not-spam-farm.example.org/"]
    marked = urlfilter.labelled(spark.createDataFrame([(u,) for u in bad + good], "url string"))
    assert {r["url"] for r in marked.filter("bad = 1").collect()} == set(bad)
    _, stats, prior = urlfilter.fit(marked, train=20)
    assert prior == len(bad) / len(bad + good)
    for end in ("com", "net", "org"):
        b, n = (sum(u.split("/")[2].endswith(f".example.{end}") for u in us) for us in (bad, bad + good))
        assert stats[f"example.{end}"] == pytest.approx(((b + 20 * prior) / (n + 20), math.log1p(n)))
    small = spark.read.parquet(f"{DATA}/pages.parquet")
    assert urlfilter.score(small, urlfilter.fit(urlfilter.labelled(small))).filter("blocked").count() == 3


def test_quality(spark, docs, labels, odd, none):
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1 and r["toxic"] == 0) for r in got]) > 0.95
    assert quality.keep_good(odd, model).columns == odd.columns and quality.score(odd, model).count() == odd.count()
    assert quality.score(odd, quality.fit(none, labels)).filter("keep").count() == 3


def brute_pairs(rows):
    sets = {i: set(partenum.features(np.frombuffer(t.encode(), np.uint8), 2).tolist()) for i, t in rows.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9}


def brute_links(rows):
    """(doc_id, class, links) of (doc_id, text), from all pairs."""
    rows = sorted(set(rows))
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    for a, b in brute_pairs(dict(enumerate(t for _, t in rows))):
        (i, _), (j, _) = rows[a], rows[b]
        links[i] += 1
        links[j] += 1
        low, high = sorted((root[i], root[j]))
        root = {k: low if r == high else r for k, r in root.items()}
    return sorted((i, root[i], n) for i, n in links.items())


def test_links_between_texts_with_one_smallest_id(spark):
    # texts a and b are similar and both have document 1, which is the least of each
    a = " ".join(f"w{k}" for k in range(40))
    rows = [(1, a), (1, a + " z"), (2, a), (3, a + " z"), (9, "other words")]
    got = sorted(map(tuple, partenum.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_links(rows) and (2, 1, 3) in got and (9, 9, 0) in got


def test_links_across_chunks_of_a_crowd(spark, monkeypatch):
    rng = random.Random(15)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(300):
        far = rng.choice([1, 3, 6, 12])
        words = [f"n{rng.randint(0, 10**6)}" if rng.random() < far / 60 else w for w in base]
        rows.append((i, " ".join(words)))
        rows += [(1000 + i, rows[-1][1])] * (i % 7 == 0)
    for limit in (4096, 40):
        monkeypatch.setattr(partenum, "CHUNK", limit)
        monkeypatch.setattr(partenum, "COLUMNS", limit)
        monkeypatch.setattr(partenum, "SENT", 500_000 if limit > 40 else 0)
        assert sorted(map(tuple, partenum.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_links(rows)


def test_jaccard_join(spark, odd, none):
    rng = random.Random(5)
    rows = {}
    for i in range(0, 400, 4):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 40)}" for _ in range(rng.choice([1, 2, 3, 8, 30, 90, 200]))]
        for k in range(4):
            changed = [w if rng.random() > 0.04 * k else f"n{rng.randint(0, 99)}" for w in words]
            rows[i + k] = " ".join(changed) + " " * k
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert sorted(map(tuple, partenum.linked(df).collect())) == brute_links(list(rows.items()))
    assert sorted(map(tuple, partenum.linked(odd).collect())) == [(i, i, 0) for i in (1, 2, 3, 4)]
    assert partenum.linked(none).count() == 0 and partenum.one_of_each(none).count() == 0
    assert partenum.one_of_each(odd).count() == odd.count()


def test_groups_are_components(spark):
    edges = [(1, 9), (2, 9), (9, 30), (30, 31), (31, 32), (5, 6)]
    got = {r["doc_id"]: r["leader"] for r in partenum.groups(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 9, 30, 31, 32], 1), 5: 5, 6: 5}


def test_pipeline(spark, docs):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and len(corpus_pipeline.STAGES) == 5
    ends = {}
    for r in sorted(rows, key=lambda r: (r["pack_id"], r["pack_offset"])):
        assert r["pack_offset"] == ends.get(r["pack_id"], 0)
        ends[r["pack_id"]] = r["pack_offset"] + r["n_words"]
    assert max(ends.values()) <= packing.MAX_WORDS
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DATA)
        assert after.columns == docs.columns
        kept = spark.createDataFrame(after.collect(), docs.schema)
    assert sum(len(r["text"].split()) for r in kept.collect()) == sum(r["n_words"] for r in rows)
