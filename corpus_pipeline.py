"""From raw documents to packed sequences: five stages, each on what the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of the documents.

In every stage NULL counts as an empty text, texts are taken whole at any length, a NULL or repeated id is an id like others, the
documents may have more columns under any names, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost.llm import decontamination, exact_dedup, near_dedup, packing, quality
from varcost.llm.common import fold, place_of, positional
from varcost.sinks.scratch import scratch_folder
from workload.local import prepare

# Documents less likely to be good than this are rejected.
MIN_QUALITY = 0.7


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the limit; the classifier learns as in op1. All stay if nothing could be learned.

    NULL and empty texts share one score, repeated rows too, so they stay or go together.
    """
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, key = positional(docs), place_of(docs, "doc_id")
    labels = labels.select(F.col("doc_id").alias(key), "quality")
    scored = quality.quality_scores(
        plain, labels, learn=fold(key, 4) != 2, id_col=key, text_col=place_of(docs, "text"), unlearned=1.0
    )
    return scored.filter(F.col("score") >= MIN_QUALITY).select(*plain.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text up to blanks: the longest, then that of the smallest id, then the first stored.

    NULL, empty and blank texts are one group.
    """
    prepare(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id (NULL is the largest), then the first stored.

    Texts with the same words are always one class, so NULL, empty and blank texts are one.
    """
    prepare(spark)
    return near_dedup.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; those without words contain none."""
    prepare(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; a document without words is a piece of one token, its end."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

# The classifier, the near duplicates and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES):
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
