"""The operators' queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parchment.llm import ann, embedding_dedup, licenses, mixing, near_dedup, quality, sentencepiece_codec, token_counts, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality": quality.op5_quality,
        "op6_mix": mixing.op6_mix,
        "op7_ann": ann.op7_ann,
        "op8_url_filters": url_filters.op8_url_filters,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_url_filters": url_filters.ORACLE,
        "op9_embedding_dedup": embedding_dedup.ORACLE,
        "op10_licenses": licenses.ORACLE,
    }
