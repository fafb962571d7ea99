"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, mixing, near_dedup, ngram_lm, quality, sentencepiece_codec, substring_dedup, token_counts, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_lm": ngram_lm.op1_ngram_lm,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_warc": warc.op3_warc,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
        "op6_language_id": language_id.op6_language_id,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op8_mix_sources": mixing.OP8_SQL,
        "op9_near_dedup": near_dedup.OP9_SQL,
    }
