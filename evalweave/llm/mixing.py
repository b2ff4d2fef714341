"""Mixing sources to target weights by Pareto order sampling.

Each source is to give a fixed number of documents: its share of the total, the shares being the
square roots of the sources' sizes (temperature 1/2) unless targets are given. Within a source a
document's expected copies are proportional to the root of its length. The whole part of that is
certain; the rest p is an inclusion probability, and the places left are filled by the documents with
the least ratio of random odds u/(1-u) to inclusion odds p/(1-p). u is a hash of doc_id.

The least k ratios of a source are found without sorting it: counts over 2**15 bins locate the bin of
the kth ratio, counts over 2**15 parts of that bin its part, and only that part is ranked. This yields
one threshold row a source; documents are then judged where they are, so no text is shuffled, and the
passes before read only doc_id, source and n_chars.

Edge cases: a null source is a source of its own; null or negative n_chars counts as 0, and each
document weighs at least 1. Null doc_id comes first among equals. Rows equal in all three are taken
together, so repeated rows can exceed a target. Other columns are untouched; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import cut, fresh, sent_if_small

BINS = 1 << 15


def _weight(n_chars: Column) -> Column:
    return F.greatest(F.floor(F.sqrt(F.greatest(F.coalesce(n_chars.cast("long"), F.lit(0)), F.lit(0)).cast("double")) * 16.0).cast("long"), F.lit(1))


def _weighed(docs: DataFrame) -> DataFrame:
    """(s, d, z): source, id and weight of each document."""
    return docs.select(F.col("source").alias("s"), F.col("doc_id").cast("long").alias("d"), _weight(F.col("n_chars")).alias("z"))


def _uniform(doc_id: Column) -> Column:
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|mix"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(281474976710656.0)


def goals(docs: DataFrame, targets: dict[str, float] | None = None, ratio: float = 1.0) -> DataFrame:
    """(s, zs, want): of each source the weight of all its documents and the copies it is to give.

    targets: weights of sources, scaled to sum to 1 over those present; absent sources get none.
    ratio: copies in all, as a multiple of the documents.
    """
    per = _weighed(docs).groupBy("s").agg(F.count("*").alias("n"), F.sum("z").alias("zs"))
    if targets is None:
        share = F.floor(F.sqrt(F.col("n").cast("double")) * 1048576.0).cast("long")
    else:
        share = F.lit(0).cast("long")
        for name, weight in targets.items():
            share = F.when(F.col("s") == name, F.lit(round(weight * 1048576)).cast("long")).otherwise(share)
    per = per.withColumn("r", share)
    total = per.agg(F.sum("n").alias("m"), F.sum("r").alias("rs"))
    want = F.col("m").cast("double") * F.lit(ratio) if ratio != 1.0 else F.col("m").cast("double")
    return per.crossJoin(F.broadcast(total)).select("s", "zs", F.coalesce(F.floor(F.try_divide(want * F.col("r").cast("double"), F.col("rs").cast("double")) + 0.5), F.lit(0)).cast("long").alias("want"))


def _order(d: Column, z: Column, zs: Column, want: Column) -> tuple[Column, Column, Column]:
    """(certain copies, inclusion probability of one more, its ratio mapped to 0..1) of a document."""
    expected = want.cast("double") * z.cast("double") / zs.cast("double")
    certain = F.floor(expected).cast("long")
    p = expected - F.floor(expected)
    u = _uniform(d)
    near, far = u * (F.lit(1.0) - p), (F.lit(1.0) - u) * p
    return certain, p, near / (near + far)


def thresholds(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """(s, zs, want, last_x, last_d): of each source the ratio and id up to which one more copy is given; null: none."""
    # one row a source, sent to the documents while sources are few; beyond, thin rows are shuffled
    w = _weighed(docs).alias("w").join(sent_if_small(goal).alias("g"), F.col("w.s").eqNullSafe(F.col("g.s"))).select("w.s", "d", "z", "zs", "want")
    certain, p, x = _order(F.col("d"), F.col("z"), F.col("zs"), F.col("want"))
    w = w.select("s", F.coalesce("d", F.lit(-(2**63))).alias("d"), "zs", "want", certain.alias("certain"), p.alias("p"), x.alias("x"))
    fine = F.floor(F.col("x") * float(BINS * BINS)).cast("long")
    w = w.withColumn("b", F.least(F.floor(fine / BINS).cast("long"), F.lit(BINS - 1))).withColumn("f", fine)
    # every step below leaves little: it is cut off, so that no later plan holds the earlier ones
    counts = cut(w.groupBy("s", "b").agg(F.sum("certain").alias("c"), F.sum((F.col("p") > 0).cast("long")).alias("k"), F.max("want").alias("want")))
    rest = counts.groupBy("s").agg((F.max("want") - F.sum("c")).alias("rest"))
    coarse = cut(_locate(counts.filter("k > 0").select("s", "b", "k"), rest, "b"))
    inside = cut(w.filter("p > 0").alias("w").join(sent_if_small(coarse).alias("c"), F.col("w.s").eqNullSafe(F.col("c.s")) & (F.col("w.b") == F.col("c.b"))).select("w.s", "w.f", "w.x", "w.d", "c.rest"))
    parts = inside.groupBy("s", "f").agg(F.count("*").alias("k"), F.first("rest").alias("rest"))
    exact = _locate(parts.select("s", "f", "k"), parts.groupBy("s").agg(F.first("rest").alias("rest")), "f")
    few = inside.drop("rest").alias("w").join(exact.alias("c"), F.col("w.s").eqNullSafe(F.col("c.s")) & (F.col("w.f") == F.col("c.f"))).select("w.s", "w.x", "w.d", "c.rest")
    ranked = few.withColumn("place", F.row_number().over(Window.partitionBy("s").orderBy("x", "d")))
    last = ranked.filter("place = rest").select("s", F.col("x").alias("last_x"), F.col("d").alias("last_d"))
    return goal.alias("g").join(last.alias("l"), F.col("g.s").eqNullSafe(F.col("l.s")), "left").select("g.s", "zs", "want", "last_x", "last_d")


def _locate(counts: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """(s, key, rest) of the bin that holds each source's rest-th ratio, rest then counting within it."""
    order = Window.partitionBy("s").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("upto", F.sum("k").over(order)).alias("c")
    both = upto.join(rest.alias("r"), F.col("c.s").eqNullSafe(F.col("r.s")))
    # a rest beyond all ratios, which rounding can bring, takes the last bin whole
    return (
        both.withColumn("all", F.max("upto").over(Window.partitionBy("c.s")))
        .withColumn("need", F.least("rest", "all"))
        .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("k") < F.col("need")))
        .select("c.s", key, (F.col("need") - F.col("upto") + F.col("k")).alias("rest"))
    )


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, ratio: float = 1.0) -> DataFrame:
    """docs with a column of the copies to take (the name: see copies_name), without the rows that get none."""
    limit = cut(thresholds(docs, cut(goals(docs, targets, ratio))))
    names = {c: fresh(docs, f"mix_{c}") for c in limit.columns}
    limit = sent_if_small(limit).select(*(F.col(c).alias(n) for c, n in names.items()))
    s, zs, want, last_x, last_d = (F.col(n) for n in names.values())
    certain, p, x = _order(docs["doc_id"].cast("long"), _weight(docs["n_chars"]), zs, want)
    d = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    more = (p > 0) & ((x < last_x) | ((x == last_x) & (d <= last_d)))
    copies = certain + F.coalesce(more, F.lit(False)).cast("long")
    name = copies_name(docs)
    return docs.join(limit, docs["source"].eqNullSafe(s)).withColumn(name, copies).filter(F.col(name) > 0).select(*(docs[c] for c in docs.columns), name)


def copies_name(docs: DataFrame) -> str:
    return fresh(docs, "copies")


def repeated(docs: DataFrame, targets: dict[str, float] | None = None, ratio: float = 1.0) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    name = copies_name(docs)
    return mixed(docs, targets, ratio).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)))).drop(name)
