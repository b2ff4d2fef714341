"""URL filter: gradient-boosted trees on lexical features, trained from labelled URLs.

Features: lengths of URL, host, path and query, path depth, digit ratios of URL and host, character
entropy, counts of parameters, of dots and hyphens of the host, whether the scheme is https, and two
statistics of the host's last two labels among all labelled URLs: the smoothed share of bad ones and
the log of their number (for a URL that trains, among those of other folds only, so that no label speaks for itself). A host is
without user and port. Trees of fixed depth are grown on binned features by the gradients of the
logistic loss, on the driver, from a bounded sample of the labelled URLs (at most about TRAIN of each
label, by a hash of the URL), weighted so that each label counts as among all labelled URLs; scoring is
one pass without shuffle that reads only ids and URLs.

Where no labels are at hand, labelled() marks URLs of blocked names as bad, whatever stands before or after
the name in the host, and all others as good.

Edge cases: null or blank URLs have a null score and aren't blocked. Repeated rows score alike. With labels
of one kind only, or none, nothing is blocked. Malformed URLs are scored on what parses. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import arrow_batches, has_words, share

TRAIN = 10_000
TREES, DEPTH, RATE, CELLS = 40, 3, 0.2, 32
FEATURES = 14
BLOCKED = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
FOLDS = 5
_START = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?"
_PARTS = _START + r"(?P<host>[^/?#:]*)(?::[^/?#]*)?(?P<path>[^?#]*)(?P<query>[^#]*)"


def labelled(pages: DataFrame, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """(url, bad): 1 for URLs whose host has a blocked name among its labels, under any suffix, else 0."""
    host = F.lower(F.regexp_extract("url", _START + "([^/?#:]*)", 1))
    bad = F.lit(False)
    for name in blocked:
        bad = bad | F.concat(F.lit("."), host, F.lit(".")).contains(f".{name}.")
    return pages.filter(F.col("url").isNotNull()).select("url", bad.cast("int").alias("bad"))


def _suffixes(host: pa.Array) -> list[str]:
    return [".".join(h.split(".")[-2:]) for h in host.to_pylist()]


def _suffixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(suffix, fold, bad, n) of each batch of (url, bad, fold)."""
    for b in batches:
        host = pc.struct_field(pc.extract_regex(pc.utf8_lower(b.column("url").cast(pa.string())), _PARTS), "host")
        suffixes = pa.table({"suffix": pa.array(_suffixes(pc.fill_null(host, "")), pa.string()), "fold": b.column("fold"), "bad": b.column("bad").cast(pa.int64())})
        sums = suffixes.group_by(["suffix", "fold"]).aggregate([("bad", "sum"), ("bad", "count")])
        yield from sums.select(["suffix", "fold", "bad_sum", "bad_count"]).rename_columns(["suffix", "fold", "bad", "n"]).to_batches()


def features(urls: pa.Array, stats: dict[str, tuple[float, float]], prior: float) -> np.ndarray:
    """A row of features for each URL, which must not be null."""
    urls = urls.cast(pa.string())
    low = pc.utf8_lower(urls)
    parts = pc.extract_regex(low, _PARTS)
    host, path, query = (pc.fill_null(pc.struct_field(parts, c), "") for c in ("host", "path", "query"))
    n = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.float64)
    raw = np.frombuffer("".join(low.to_pylist()).encode(), dtype=np.uint8)
    entropy = np.zeros(len(n))
    row = np.repeat(np.arange(len(n)), n.astype(np.int64))
    counts = np.bincount(row * 256 + raw, minlength=len(n) * 256).reshape(len(n), 256)
    p = counts / np.maximum(n, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)
    num = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float64)
    ratio = lambda a: num(pc.count_substring_regex(a, "[0-9]")) / np.maximum(num(pc.binary_length(a)), 1)
    length = lambda a: num(pc.binary_length(a))
    known = [stats.get(s, (prior, 0.0)) for s in _suffixes(host)]
    params = np.where(length(query) > 1, num(pc.count_substring(query, "&")) + 1, 0)
    cols = [n, length(host), length(path), length(query), num(pc.count_substring(path, "/")), ratio(low), ratio(host), entropy, params]
    cols += [num(pc.count_substring(host, c)) for c in ".-"]
    cols += [num(pc.starts_with(low, "https:")), np.array([k[0] for k in known]), np.array([k[1] for k in known])]
    return np.stack(cols, axis=1)


@dataclass
class Trees:
    """Complete trees: inner nodes by level, then leaves; `bias` is the first log-odds."""

    bias: float = -8.0
    split: list[np.ndarray] = field(default_factory=list)
    at: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return log_odds(self.plain(), x)

    def plain(self) -> tuple:
        return self.bias, self.split, self.at, self.leaf


def log_odds(trees: tuple, x: np.ndarray) -> np.ndarray:
    bias, splits, ats, leaves = trees
    out = np.full(len(x), bias)
    rows = np.arange(len(x))
    for split, at, leaf in zip(splits, ats, leaves, strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, split[node]] > at[node])
        out += leaf[node - len(split)]
    return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Fit the trees by gradients and curvatures of the weighted logistic loss on binned features."""
    mean = np.average(y, weights=weight)
    model = Trees(bias=float(np.log(mean / (1 - mean))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CELLS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(len(y), model.bias)
    inner = (1 << DEPTH) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        split, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            start, width = (1 << level) - 1, 1 << level
            local = node - start
            gain, best = np.full(width, 1e-6), np.full((width, 2), -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * CELLS + binned[:, j]
                gs, hs = (np.bincount(key, weights=v, minlength=width * CELLS).reshape(width, CELLS) for v in (g, h))
                gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                value = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                value = value[:, : len(e)]
                top = value.argmax(axis=1)
                better = value[np.arange(width), top] > gain
                gain[better], best[better, 0], best[better, 1] = value[np.arange(width), top][better], j, top[better]
            for k in np.flatnonzero(best[:, 0] >= 0):
                split[start + k], at[start + k] = best[k, 0], edges[best[k, 0]][best[k, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), split[node]] > at[node])
        leaf_of = node - inner
        gs, hs = (np.bincount(leaf_of, weights=v, minlength=inner + 1) for v in (g, h))
        leaf = -RATE * gs / (hs + 1)
        score = score + leaf[leaf_of]
        model.split.append(split), model.at.append(at), model.leaf.append(leaf)
    return model


def statistics(tally: list, prior: float) -> dict[str, tuple[float, float]]:
    """(smoothed share of bad URLs, log of their number) of each suffix, from rows (suffix, bad, n)."""
    sums: dict[str, tuple[int, int]] = {}
    for r in tally:
        b, n = sums.get(r["suffix"], (0, 0))
        sums[r["suffix"]] = b + r["bad"], n + r["n"]
    return {s: ((b + 20 * prior) / (n + 20), float(np.log1p(n))) for s, (b, n) in sums.items()}


def fit(urls: DataFrame, train: int = TRAIN) -> tuple[Trees, dict[str, tuple[float, float]], float]:
    """(trees, suffix statistics, prior) from (url, bad): trees by at most about `train` URLs of each label, the rest by all."""
    arrow_batches(urls.sparkSession)
    urls = urls.filter(has_words(F.col("url")) & F.col("bad").isNotNull()).select("url", F.col("bad").cast("int").alias("bad"), share(F.col("url"), FOLDS, 9).cast("int").alias("fold"))
    sizes = {r["bad"]: r["count"] for r in urls.groupBy("bad").count().collect()}  # two rows
    rate = F.lit(0)
    for b, n in sizes.items():
        rate = F.when(F.col("bad") == b, F.lit(min(1 << 20, -(-(train << 20) // n)))).otherwise(rate)
    got = urls.filter(share(F.col("url"), 1 << 20, 7) < rate).toArrow().combine_chunks()
    y, fold = got.column("bad").to_numpy().astype(np.float64), got.column("fold").to_numpy()
    if not len(y) or y.min() == y.max():
        return Trees(), {}, 0.0
    order = np.argsort(np.array(got.column("url").to_pylist(), dtype=object), kind="stable")
    text, y, fold = got.column("url").take(pa.array(order)).combine_chunks(), y[order], fold[order]
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    prior = sizes[1] / (sizes[0] + sizes[1])
    tally = urls.mapInArrow(_suffixed, "suffix string, fold int, bad long, n long").groupBy("suffix", "fold").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).collect()
    stats = statistics(tally, prior)
    x = np.empty((len(y), FEATURES))
    for k in range(FOLDS):
        mine = fold == k
        if mine.any():
            x[mine] = features(text.filter(pa.array(mine)), statistics([r for r in tally if r["fold"] != k], prior), prior)
    return boost(x, y, weight), stats, prior


def score(pages: DataFrame, model: tuple[Trees, dict[str, tuple[float, float]], float]) -> DataFrame:
    """(page_id, url, score, blocked): the probability that a URL is bad; it is blocked from one half."""
    arrow_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((model[0].plain(), model[1], model[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, stats, prior = shared.value
        for b in batches:
            urls = b.column("url")
            given = pc.fill_null(pc.greater(pc.binary_length(pc.utf8_trim_whitespace(urls)), 0), False).to_numpy(zero_copy_only=False)
            p = np.full(len(urls), np.nan)
            if given.any():
                p[given] = 1 / (1 + np.exp(-log_odds(trees, features(urls.filter(pa.array(given)), stats, prior))))
            with np.errstate(invalid="ignore"):
                yield pa.RecordBatch.from_arrays([b.column("page_id"), urls, pa.array(p, from_pandas=True), pa.array(p >= 0.5)], ["page_id", "url", "score", "blocked"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, url string, score double, blocked boolean")
