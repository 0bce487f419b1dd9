"""Queries of the quality operators (1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvet.llm import pu_quality, quality_rules
from tabvet.llm.common import table
from tabvet.llm.registry import register


@register("op3_quality_rules", quality_rules.SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judged(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op1_pu_quality")
def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = pu_quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out
