"""Problem 8: documents that stop before their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.llm.queries import query
from maldure.llm.truncation import judge_truncation
from maldure.tables import load


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut inside a word, a sentence or an open structure."""
    return judge_truncation(load(spark, sf_dir, "documents"), "doc_id", "text", "source").where("truncated").select("doc_id")


#: Why a text counts as cut; see judge_truncation.
REASONS = ("limit", "transfer", "ending", "structure")


@query
def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates: documents with text, truncated ones and their share, and how many for each reason."""
    judged = judge_truncation(load(spark, sf_dir, "documents"), "doc_id", "text", "source").where("chars > 0")
    by_reason = [F.count_if(F.col("reason") == r).alias(f"by_{r}") for r in REASONS]
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("truncated").alias("truncated"), F.avg(F.col("truncated").cast("double")).alias("share"), *by_reason)
