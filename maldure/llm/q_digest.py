"""Problem 4: percentiles of sample_results.processing_time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.llm.digest import FAN, PERCENTS, brackets, certified_percentiles, certify, finite, group_digests, merge_digests, spread
from maldure.llm.queries import SQL, query
from maldure.tables import checkpoint, load

NAMES = dict(zip(PERCENTS, ("p50", "p90", "p95", "p99")))
TOLERANCE = 0.1


def own_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid processing times (run_id, _v), one row per run_id and sample_index; each run, or part of a hot one, in one task.

    Of resends the one with the least row_id counts; rows without a sample_index count each for themselves.
    """
    rows = load(spark, sf_dir, "sample_results").select("run_id", "sample_index", "row_id", "processing_time", "is_outlier")
    key = F.coalesce(F.col("sample_index").cast("long"), -F.col("row_id") - 1)
    rows, width = spread(rows.where(F.col("run_id").isNotNull()).withColumn("_i", key), ["run_id"], F.col("_i"))
    own = ["run_id"] if width == 1 else ["run_id", "_part"]
    one = rows.repartition(*own).groupBy(*own, "_i").agg(F.min_by("processing_time", "row_id").alias("_v"), F.min_by(F.coalesce("is_outlier", F.lit(False)), "row_id").alias("_out"))
    return checkpoint(one.where(finite(F.col("_v")) & ~F.col("_out")).select("run_id", "_v"))


def own_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = own_times(spark, sf_dir)
    return certified_percentiles(rows, ["run_id"], "_v", tasks=rows.rdd.getNumPartitions())


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose stored percentiles differ from their own by more than a tenth; see TESTDATA.md.

    Runs without a valid time, and stored percentiles that are all null, are none.
    """
    own = own_percentiles(spark, sf_dir)
    stored = load(spark, sf_dir, "run_aggregates").select("run_id", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"latency_percentiles.{name}").alias("stored")) for q, name in NAMES.items()])).alias("s")).select("run_id", "s.*").where("stored IS NOT NULL")
    off = F.abs(F.col("stored") - F.col("exact")) > TOLERANCE * F.abs("exact")
    return own.join(stored, ["run_id", "q"]).where(off | F.isnan("stored")).select("run_id").distinct()


SQL["p4_found"] = """
WITH one AS (
  SELECT run_id, min_by(struct_pack(t := processing_time, o := is_outlier), row_id) AS s
  FROM sample_results WHERE run_id IS NOT NULL
  GROUP BY run_id, coalesce(sample_index::BIGINT, -row_id - 1)
), own AS (
  SELECT run_id, quantile_cont(s.t, [0.5, 0.9, 0.95, 0.99]) AS q
  FROM one WHERE s.t IS NOT NULL AND isfinite(s.t) AND NOT coalesce(s.o, false) GROUP BY run_id
)
SELECT a.run_id FROM run_aggregates a JOIN own USING (run_id)
WHERE abs(a.latency_percentiles.p50 - q[1]) > 0.1 * abs(q[1]) OR abs(a.latency_percentiles.p90 - q[2]) > 0.1 * abs(q[2])
   OR abs(a.latency_percentiles.p95 - q[3]) > 0.1 * abs(q[3]) OR abs(a.latency_percentiles.p99 - q[4]) > 0.1 * abs(q[4])
"""


@query
def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of each run: the digest's estimate, the exact value and the certified rank error."""
    return own_percentiles(spark, sf_dir)


@query
def p4_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of each model, dataset and subset, over all of its runs."""
    runs = load(spark, sf_dir, "runs").select("run_id", F.col("model_name").alias("model"), F.col("dataset_name").alias("dataset"), F.coalesce("dataset_subset", F.lit("default")).alias("subset"))
    return certified_percentiles(own_times(spark, sf_dir).join(runs, "run_id"), ["model", "dataset", "subset"], "_v")


def _exact(certified: DataFrame) -> DataFrame:
    return certified.withColumn("exact", F.round("exact", 9)).drop("estimate", "rank_error", "bracket_rows")


@query
def p4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact values of p4_percentiles alone, for which there is SQL."""
    return _exact(p4_percentiles(spark, sf_dir))


@query
def p4_exact_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact values of p4_by_slice alone, for which there is SQL."""
    return _exact(p4_by_slice(spark, sf_dir))


def _exact_sql(keys: dict[str, str], join: str = "") -> str:
    names = ", ".join(keys)
    return f"""
WITH one AS (
  SELECT run_id, min_by(struct_pack(t := processing_time, o := is_outlier), row_id) AS s FROM sample_results WHERE run_id IS NOT NULL GROUP BY run_id, coalesce(sample_index::BIGINT, -row_id - 1)
), own AS (SELECT {", ".join(f"{v} AS {k}" for k, v in keys.items())}, s.t AS t FROM one {join} WHERE s.t IS NOT NULL AND isfinite(s.t) AND NOT coalesce(s.o, false)),
grouped AS (SELECT {names}, count(*) AS n, quantile_cont(t, [0.5, 0.9, 0.95, 0.99]) AS v FROM own GROUP BY {names})
SELECT {names}, n, unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q, round(unnest(v), 9) AS exact FROM grouped
"""


SQL["p4_exact"] = _exact_sql({"run_id": "one.run_id"})
SQL["p4_exact_by_slice"] = _exact_sql({"model": "model_name", "dataset": "dataset_name", "subset": "coalesce(dataset_subset, 'default')"}, "JOIN runs USING (run_id)")


@query
def p4_from_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all valid arrivals per model, combined from one stored digest per model and day of finishing, with the certified rank error."""
    runs = load(spark, sf_dir, "runs").select("run_id", F.col("model_name").alias("model"))
    rows = load(spark, sf_dir, "sample_results").where("NOT coalesce(is_outlier, false)").select("run_id", "processing_time", F.to_date("finished_at").alias("day")).join(runs, "run_id")
    days = group_digests(rows, ["model", "day"], "processing_time")
    # blocks of days, then all of them
    blocks = merge_digests(days.withColumn("_block", F.floor(F.unix_date("day") / FAN)), ["model", "_block"])
    return certify(rows, ["model"], "processing_time", brackets(merge_digests(blocks, ["model"]), ["model"]))
