"""From documents to packed training sequences: five stages, each over all that the one before kept.

Labels, like documents, are read from sf_dir. SQL can't express the fitted classifier, the connected
components or the packing, so ORACLE_SQL is None and tests/llm compares run() with plain Python.

Edge cases. Null and blank texts have no quality and go in the first stage; without labels of both kinds, all
others stay. Rows with null doc_id aren't near copies of anything. Rows that repeat another whole row stay or go with it.
A document of which the third stage leaves nothing goes. Null sources are one source. Every stage but the
last keeps the columns of documents, in their order, whatever other columns there are; an empty table
gives an empty result. Ties are settled by doc_id in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evalweave.llm import mixing, packing, partenum, quality, suffix_dedup
from evalweave.llm.common import read, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = read(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return partenum.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each repeated passage, one occurrence stays."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in their target shares."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again.

    A stage's result is deleted when the next has been written; the last one's is what is returned, so it stays.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
