"""Run aggregates over a stream of sample results, with late rows and resends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maldure.operators.aggregate import count_columns, macro_columns, micro_columns


def without_resends(samples: DataFrame, time: str = "ingested_at", delay: str = "7 days") -> DataFrame:
    """One row per run_id and sample_index among those that arrive within the delay of each other."""
    return samples.withWatermark(time, delay).dropDuplicatesWithinWatermark(["run_id", "sample_index"])


def running_aggregates(samples: DataFrame) -> DataFrame:
    """Counts, macro and micro averages per run, for a stream in update or complete mode. Percentiles keep all
    values, so they are no part of the state; take them in ``foreachBatch`` from stored digests."""
    return samples.groupBy("run_id").agg(*count_columns(), *macro_columns(), *micro_columns())


def arrivals(samples: DataFrame, time: str = "finished_at", delay: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Samples and outliers per window of finishing, for a stream in append mode; rows later than the delay are dropped by the watermark."""
    timed = samples.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    own = timed.groupBy(F.window("_t", window)).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.coalesce("is_outlier", F.lit(False))).alias("outliers"))
    return own.select(F.col("window.start").alias("starts"), "samples", "outliers")
