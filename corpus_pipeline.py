"""The corpus pipeline: quality rules, exact and near de-duplication, mixing of sources, and tokenisation.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again for the next one. All stages but the last return the columns of documents.

Documents that a stage keeps come through with all their columns. The mixing stage repeats rows, so the last stage's
result has a row for each repetition. An empty table gives empty results; null texts fail the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ruleweave.llm import common, exact_dedup, mixing, near_dedup, quality, sentencepiece_codec


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds."""
    return quality.filtered(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the least id."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similarities of 0.8 or more on 5-word shingles, the one with the least id."""
    return near_dedup.deduplicated(docs, k=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row, and digests of the ids and of the text that they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encoded(docs, path, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=("lang", "source"))


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("encoding", encode),
]

#: SQL can't express the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents below ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
