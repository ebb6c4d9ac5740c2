"""From raw documents to a mixed, encoded corpus: five stages, each one operator of ``tessera.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of ``documents``, extra ones included. Results and checkpoints are written in few files (``packed``).

Defined results: a null text counts as empty in every stage (an empty text gets the quality of its features, groups
with all wordless texts, holds no secret, counts one token, has no ids); a null id keeps its row apart from others;
repeated rows are one group in near-dedup, so one stays; empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op4_mixing, op5_bpe, op6_quality, op7_secrets, op9_simhash
from tessera.llm.shared import clearing, packed, remove, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return packed(op6_quality.accepted(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return packed(op9_simhash.keep_one(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific, live-looking credentials are masked; every document stays."""
    return packed(op7_secrets.redacted(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the budgets of their domain, language and source say."""
    return packed(op4_mixing.mixed(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with character offsets, and the text decoded from them."""
    return packed(op5_bpe.encoded(docs))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", encoding),
]

#: Learned models, components over fingerprints and BPE merges are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage.

    Once a stage's result stands there whole, what it read and its checkpoints are removed; the last result stays,
    for the returned rows are read from it.
    """
    docs, place, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        with clearing(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if before:
            remove(spark, before)
        before = f"{place}/{k}"
    return docs
