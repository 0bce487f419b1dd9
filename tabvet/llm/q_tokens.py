"""Queries of the token operators (5 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvet.llm import bpe_chunks, simple8b
from tabvet.llm.common import table
from tabvet.llm.registry import register


@register("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_chunks.encode_decode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    )


#: Id appended to each document.
END_ID = 2


@register("op5_simple8b")
def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks = simple8b.write_blocks(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return simple8b.read_documents(blocks)
