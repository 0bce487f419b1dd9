"""Query of the personal-data operator (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvet.llm import pii
from tabvet.llm.common import table
from tabvet.llm.registry import register


@register("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents").select("doc_id", "text"))
