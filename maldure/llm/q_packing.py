"""Problem 7: documents in containers of a fixed number of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.llm.bpe import count_tokens
from maldure.llm.packing import CAPACITY, pack
from maldure.llm.queries import query
from maldure.tables import checkpoint, load


@query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container of 2048 tokens by byte_bpe_50k, with the offset and size of its pieces."""
    sizes = checkpoint(count_tokens(load(spark, sf_dir, "documents"), "doc_id", "text"))
    return pack(sizes, "doc_id", "tokens")


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled: their number, the least possible number, and the unused share."""
    held = p7_containers(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("items"))
    total = F.sum("held")
    return held.agg(F.count(F.lit(1)).alias("containers"), F.ceil(total / CAPACITY).alias("least"), F.max("held").alias("fullest"), (1 - total / (F.count(F.lit(1)) * CAPACITY)).alias("unused"), F.sum("items").alias("items"))
