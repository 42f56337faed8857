"""Problem 6: documents as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maldure.llm.bpe import encode_corpus
from maldure.llm.queries import query
from maldure.tables import load


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k; empty lists for empty and null texts."""
    return encode_corpus(load(spark, sf_dir, "documents"), "doc_id", "text")
