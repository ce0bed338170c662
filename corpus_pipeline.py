"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All of them take null
doc_ids, null, empty and very long texts, repeated rows, empty tables and further columns of any name; what
becomes of each is said below. Rows are never cut off by a count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pressmill.llm import packing, quality, secrets, simhash, substrings
from pressmill.llm.common import shared_dir
from pressmill.llm.registry import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant rejects go.

    Null and empty texts go or stay by the score of no words, repeated rows alike; a null doc_id has no label. Without
    labels of both classes all rows stay. An empty table stays empty; all columns stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal SimHash fingerprints stays: that of the smallest doc_id.

    The shingles and the bits are those of the operator's own query. Null, empty and blank texts are one group. Null
    doc_ids come after all others; rows that share one stay or go each by its own text, and equal rows are copies.
    An empty table stays empty; all columns stay.
    """
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows of 20 words are cut, wherever they occurred before.

    No row goes, even where no word is left; n_chars follows the text. Null texts stay null. Documents rank by doc_id, null first,
    then by the CRC-32 of their texts. An empty table stays empty; all columns stay.
    """
    return substrings.remove_repeats(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark.

    No row goes; n_chars follows the text. Null and empty texts stay. An empty table stays empty; all columns stay.
    """
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens.

    A null or empty text is its end id alone; rows that share or lack a doc_id are documents of their own. An empty table gives no pieces.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The classifier, fingerprints and byte-level BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between two, the table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
