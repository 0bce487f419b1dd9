"""Queries of the page operators (6 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvet.llm import html_crf, warc
from tabvet.llm.common import table
from tabvet.llm.registry import register


@register("op8_warc")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.verified(spark, warc.write(table(spark, sf_dir, "pages"), min_bytes=0))


@register("op6_html_crf")
def op6_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(table(spark, sf_dir, "pages"))
