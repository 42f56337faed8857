"""Problem 5: garbled values of telephone_labels.label_name and manifest_rows.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.llm.mojibake import restore_values
from maldure.llm.queries import query
from maldure.tables import load


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "telephone_labels").select(F.lit("telephone_labels").alias("table_name"), F.col("label_id").alias("row_key"), F.col("label_name").alias("value"))
    rows = load(spark, sf_dir, "manifest_rows").select(F.lit("manifest_rows").alias("table_name"), F.col("utt_id").alias("row_key"), F.col("text").alias("value"))
    return labels.unionByName(rows)


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values garbled by a wrong decoding, recoverable or not."""
    return restore_values(_values(spark, sf_dir)).select("table_name", "row_key")


@query
def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled values with what could be restored, and how."""
    return restore_values(_values(spark, sf_dir))
