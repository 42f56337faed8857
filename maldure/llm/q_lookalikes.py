"""Problem 3: sample_results.reference and .prediction in one consistent form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maldure.llm.lookalikes import find_lookalikes, rewrite_lookalikes
from maldure.llm.queries import query
from maldure.tables import load

FIELDS = ("reference", "prediction")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored values written with look-alike or invisible characters; see TESTDATA.md."""
    return find_lookalikes(load(spark, sf_dir, "sample_results").select("row_id", *FIELDS), "row_id", FIELDS)


@query
def p3_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's texts in one form."""
    return rewrite_lookalikes(load(spark, sf_dir, "sample_results").select("row_id", *FIELDS), "row_id", FIELDS)
