"""Leaderboards: union, deduplication, ranking, best run per slice, the overall board, coverage and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maldure.functions.metrics import finite, outlier_rate
from maldure.functions.text import TELEPHONE, slice_label, subset_or_default
from maldure.operators.order import ranked

BOARD_METRICS = ("cer", "wer", "mer", "jer", "ser", "rtf", "latency")
# The order of subsets on a board; others follow by name.
SUBSET_ORDER = ("clean", "other", "D01", "D02", "D03", "D04", "all", "default")
NO_SOURCE = "run artifact"


def is_full(flag: str = "is_full_evaluation") -> Column:
    """For building: a missing flag is false."""
    return F.coalesce(F.col(flag), F.lit(False))


def not_partial(flag: str = "is_full_evaluation") -> Column:
    """For showing: only an explicit false is partial."""
    return ~F.col(flag).eqNullSafe(F.lit(False))


def is_generated(artifact: Column) -> Column:
    """Whether a path is of a run's own artifact."""
    path = F.translate(F.coalesce(artifact, F.lit("")), "\\", "/")
    return path.endswith("/leaderboard_row.json") | path.startswith("results/")


def union_rows(*boards: DataFrame) -> DataFrame:
    """All rows of several boards, with an ``arrival`` column that ranks the boards in the given order."""
    out = None
    for i, board in enumerate(boards):
        own = board.withColumn("arrival", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def dedupe(rows: DataFrame, arrival: str = "entry_id") -> DataFrame:
    """One row per model, dataset and subset: generated artifacts first, then the greatest run_id, then the first to arrive.

    Rows without model or dataset are only duplicates of rows with the same run_id. The choice is a partial aggregate, so
    many copies of one key don't meet in one task.
    """
    order = F.struct(is_generated(F.col("artifact")).alias("g"), F.coalesce("run_id", F.lit("")).alias("r"), (-F.col(arrival)).alias("a"))
    apart = F.col("model").isNull() | F.col("dataset").isNull()
    keys = {"_d0": F.when(apart, F.struct("run_id")), "_d1": F.col("model"), "_d2": F.col("dataset"), "_d3": F.col("subset")}
    best = rows.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.max(order).alias("best")).select((-F.col("best.a")).alias(arrival))
    return rows.join(best, arrival, "left_semi")


def metric(name: str) -> Column:
    """A board's metric of a row; the outlier rate among them."""
    if name == "outlier_rate":
        return outlier_rate(F.col("outlier_count"), F.col("evaluated_samples"), F.col("total_samples"))
    return F.col(f"metrics.macro.{name}")


def sort_key(name: str) -> Column:
    """The metric for sorting; missing values are last."""
    value = metric(name)
    return value if name == "outlier_rate" else F.coalesce(finite(value), F.lit(float("inf")))


def best_per_slice(rows: DataFrame, by: str = "cer", arrival: str = "entry_id") -> DataFrame:
    """The best row of each model, dataset and subset by a metric; of equals the first. Rows without model or dataset are out."""
    named = rows.where((F.coalesce("model", F.lit("")) != "") & (F.coalesce("dataset", F.lit("")) != "")).withColumn("_s", subset_or_default(F.col("subset")))
    best = named.groupBy("model", "dataset", "_s").agg(F.min(F.struct(sort_key(by).alias("k"), F.col(arrival).alias("a"))).alias("best")).select(F.col("best.a").alias(arrival))
    return named.join(best, arrival, "left_semi").drop("_s")


def overall_board(rows: DataFrame, by: str = "cer", arrival: str = "entry_id") -> DataFrame:
    """One row per model: means of the metrics over its best runs, its coverage, and its best run."""
    best = best_per_slice(rows, by, arrival).withColumn("_label", slice_label(F.col("dataset"), F.col("subset"))).withColumn("_subset", subset_or_default(F.col("subset")))
    mean = lambda c: F.avg(finite(c))
    first = F.min(F.struct(sort_key(by).alias("k"), F.col("_label").alias("l"), F.col(arrival).alias("a"), F.col("run_id"), F.col("model_repo"))).alias("_best")
    pairs = F.collect_set(F.struct(F.col("dataset"), F.col("_subset").alias("subset")))
    return best.groupBy("model").agg(
        F.count(F.lit(1)).alias("slices"), *[mean(metric(m)).alias(m) for m in BOARD_METRICS], mean(metric("outlier_rate")).alias("outlier_rate"),
        F.array_sort(F.collect_list("_label")).alias("labels"), F.array_sort(F.collect_set(F.coalesce(F.nullif("source", F.lit("")), F.lit(NO_SOURCE)))).alias("sources"),
        F.array_sort(pairs).alias("coverage"), first,
    ).withColumn("best_run_id", F.col("_best.run_id")).withColumn("model_repo", F.col("_best.model_repo")).drop("_best")


def subset_place(subset: Column) -> Column:
    """The place of a subset on a board; unknown ones share the last."""
    at = F.array_position(F.array(*[F.lit(x) for x in SUBSET_ORDER]), subset)
    return F.when(at > 0, at).otherwise(len(SUBSET_ORDER) + 1).cast("int")


def board_filter(rows: DataFrame, dataset: str, subset: str | None = None, model: str | None = None, search: str = "") -> DataFrame:
    """Rows of a dataset, perhaps of one subset or model, whose search text contains a string."""
    from maldure.functions.text import search_text

    out = rows.where(F.col("dataset") == dataset)
    if subset is not None:
        out = out.where(subset_or_default(F.col("subset")) == subset)
    if model is not None:
        out = out.where(F.col("model") == model)
    if search:
        label = slice_label(F.col("dataset"), F.col("subset"))
        fields = [F.col(c) for c in ("model", "model_repo", "dataset", "subset")] + [label] + [F.col(c) for c in ("gpu", "run_id", "command", "source")]
        out = out.where(search_text(*fields).contains(search.lower()))
    return out


def default_subset(rows: DataFrame) -> DataFrame:
    """The subset with which each dataset's board opens: ``all`` of the telephone dataset, if there is one; else all slices (null)."""
    has_all = F.max((subset_or_default(F.col("subset")) == "all").cast("int")) == 1
    return rows.where("dataset IS NOT NULL").groupBy("dataset").agg(F.when((F.first("dataset") == TELEPHONE) & has_all, "all").alias("opens_on"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: rows, models, slices, the least error rate and whose it is."""
    label = slice_label(F.col("dataset"), F.col("subset"))
    cer = finite(F.col("metrics.macro.cer"))
    best = F.min(F.when(cer.isNotNull(), F.struct(cer.alias("cer"), F.col("entry_id"), F.col("model"), label.alias("label")))).alias("best")
    own = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.nullif("model", F.lit(""))).alias("models"), F.count_distinct(label).alias("slices"), best)
    return own.select("rows", "models", "slices", F.col("best.cer").alias("best_cer"), F.col("best.model").alias("best_model"), F.col("best.label").alias("best_label"))


def markdown_table(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The board's rows as lines of a Markdown table, in order of error rate. Columns: place, line. ``outliers`` is a column of counts."""
    counts = F.concat(F.coalesce("outlier_count", F.lit(0)).cast("string"), F.lit(" / "), F.coalesce("evaluated_samples", "total_samples", F.lit(0)).cast("string"))

    def cell(name: str) -> Column:
        if name == "outliers":
            return counts
        return F.when(metric(name).isNull(), "").otherwise(F.format_string("%.4f", metric(name))) if name in BOARD_METRICS else F.coalesce(F.col(name), F.lit(""))

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    own = rows.select(metric("cer").alias("_c"), F.col("entry_id"), line.alias("line"))
    return ranked(own, [F.asc_nulls_last("_c"), F.col("entry_id").asc()], "place").select("place", "line")
