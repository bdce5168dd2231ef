"""A corpus pipeline: quality, near duplicates, benchmark leaks, mixing, sharding.

Each stage works on all that the stage before it kept; results are written as Parquet between stages by whoever runs STAGES, and
by run() below. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioform.llm import decontamination, mixing, quality, sharding, similar
from folioform.llm.common import checkpoint_folder, remove_folder, table

SHARDS = 40


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays.

    Wide SimHash fingerprints propose pairs; the similarity of the sets of five-word shingles, 0.8 or more, decides.
    """
    return similar.drop_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; each row is judged by itself."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0 to 3 rows with its doc_id."""
    return mixing.repeat(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", shards),
]

#: Training a network is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's folder goes when the next is written.

    The last one that is written stays, as the result reads it. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            here = f"{folder}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if before:
                remove_folder(spark, before)
            before = here
    return docs
