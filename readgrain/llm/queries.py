"""The queries of this subpackage, each thin over its operator, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readgrain.llm import forest, langid, licences, mix, pieces, pii, quality, rules, simhash, tokens
from readgrain.llm.common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(documents(spark, sf_dir)).drop("source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_personal_data": pii.op3_personal_data,
    "op4_jaccard_join": forest.op4_jaccard_join,
    "op5_language_id": langid.op5_language_id,
    "op6_fingerprints": simhash.op6_fingerprints,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_licences": licences.op9_licences,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mix.ORACLE_SQL,
}
