"""Chunking in bounded memory: long texts are split a window at a time, and pieces handed on as they come."""

import random
import tracemalloc

import pytest

from evalweave.operators import retrieval


def test_a_long_text_is_split_bit_by_bit():
    text = "word " * 400_000
    tracemalloc.start()
    n = sum(1 for _ in retrieval._pieces(text, 500, 50, retrieval.SEPARATORS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 4000 and peak < len(text)  # a list of its words takes over ten times that


@pytest.mark.parametrize("window", [1, 2, 5, 64])
def test_windows_split_as_a_whole(monkeypatch, window):
    monkeypatch.setattr(retrieval, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(300):
        text, mark = "".join(rng.choice("ab\n\n ") for _ in range(rng.randint(0, 60))), rng.choice(["\n\n", "\n", " ", "ab", "aa", "aba"])
        assert list(retrieval._parts(text, mark)) == text.split(mark)


def test_batches_are_bounded(spark):
    for name in ("maxBytesPerBatch", "maxRecordsPerBatch"):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", "1000000000")
    texts = [None, "", "one two " * 90_000, "\n\n".join("three" * k for k in range(90))]
    df = spark.createDataFrame([(f"s{k}", k, t) for k, t in enumerate(texts)], "source string, page int, text string").coalesce(1)
    got = retrieval.recursive_chunks(df)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20 and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 4096
    want = [(f"s{k}", k, n, x) for k, t in enumerate(texts) for n, x in enumerate(retrieval.split_recursively(t or ""))]
    assert [tuple(r) for r in got.collect()] == want and sum(len(r[3]) for r in want) > 700_000
