"""Run aggregates: counts, macro and micro averages, exact percentiles, and the roll-up of domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maldure.functions.metrics import finite
from maldure.operators.order import running_totals

RATES = ("wer", "cer", "mer", "jer", "ser", "rtf", "latency")
EDIT_RATES = ("wer", "cer", "mer", "jer")
PERCENTS = (0.5, 0.9, 0.95, 0.99)
# The telephone dataset's domains.
DOMAINS = ("D01", "D02", "D03", "D04")
FULL_SET = "all"


def valid() -> Column:
    """Whether a sample counts: it isn't marked as an outlier."""
    return ~F.coalesce(F.col("is_outlier"), F.lit(False))


def count_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_samples"), F.count_if(valid()).alias("valid_samples"), F.count_if(~valid()).alias("outlier_count")]


def macro_columns(source: str = "metrics", prefix: str = "macro_") -> list[Column]:
    """Means of the rates over the valid samples, finite values only; null where there is none."""
    return [F.avg(F.when(valid(), finite(F.col(f"{source}.{m}")))).alias(prefix + m) for m in RATES]


def micro_columns(source: str = "metrics", prefix: str = "micro_") -> list[Column]:
    """Sums of errors over sums of references over the valid samples; null where there is no reference."""
    total = lambda f: F.sum(F.when(valid(), F.coalesce(F.col(f"{source}.{f}"), F.lit(0))))
    out = []
    for m in EDIT_RATES:
        hits, s, d, i = (total(f"{m}_{x}") for x in ("hits", "substitutions", "deletions", "insertions"))
        out.append(F.try_divide(s + d + i, hits + s + d).alias(prefix + m))
    return [*out, F.try_divide(total("ser_error_sentences"), total("ser_total_sentences")).alias(prefix + "ser")]


def exact_percentiles(samples: DataFrame, keys: Sequence[str], time: str = "processing_time", percents: Sequence[float] = PERCENTS) -> DataFrame:
    """Exact percentiles of the valid samples' finite times, with linear interpolation. Columns: keys, p50, p90, ...

    Equal values are counted first, by a partial aggregate; the counts are then added up in order over range partitions, so
    no task sorts or holds a group. Groups without a finite time have no row; null keys form a group.
    """
    value = finite(F.col(time))
    counts = samples.where(valid() & value.isNotNull()).groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    summed = running_totals(counts, keys, ["_v"], "_c")
    spots, fields = [], []
    for p in percents:
        at = F.lit(p) * (F.col("_total") - 1)
        low = F.floor(at)
        # the first value at or behind a rank, and whether this row has it
        has = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
        spots.append(has(low) | has(low + 1))
        first, second = (F.min(F.when(F.col("_upto") > low + k, F.col("_v"))) for k in (0, 1))
        part = F.first(at - low)
        fields.append((first + F.when(part > 0, part * (second - first)).otherwise(0)).alias(f"p{int(100 * p)}"))
    wanted = spots[0]
    for spot in spots[1:]:
        wanted = wanted | spot
    return summed.where(wanted).groupBy(*keys).agg(*fields)


def aggregate_samples(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, macro and micro averages and percentiles of each group; null keys form a group."""
    own = samples.groupBy(*keys).agg(*count_columns(), *macro_columns(), *micro_columns())
    times = exact_percentiles(samples, keys)
    same, right = None, times.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in times.columns if c not in keys])
    for i, k in enumerate(keys):
        equal = own[k].eqNullSafe(right[f"_k{i}"])
        same = equal if same is None else same & equal
    return own.join(right, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def eligible_runs(rows: DataFrame, dataset: str, subsets: Sequence[str] = DOMAINS) -> DataFrame:
    """Full runs of the dataset's subsets."""
    return rows.where((F.col("dataset") == dataset) & F.col("subset").isin(*subsets) & F.col("is_full_evaluation").eqNullSafe(True))


def complete_groups(runs: DataFrame, keys: Sequence[str], subsets: Sequence[str] = DOMAINS) -> DataFrame:
    """Each group's subsets, those it lacks, and whether it has exactly the given ones."""
    wanted = F.array(*[F.lit(x) for x in sorted(subsets)])
    seen = runs.groupBy(*keys).agg(F.array_sort(F.collect_set("subset")).alias("subsets"))
    return seen.select(*keys, "subsets", F.array_except(wanted, "subsets").alias("missing"), (F.col("subsets") == wanted).alias("complete"))


def roll_up(runs: DataFrame, samples: DataFrame, subsets: Sequence[str] = DOMAINS) -> DataFrame:
    """One row for each model and repository whose runs cover all subsets: the samples of all of its runs, put together.

    runs: run_id, model, model_repo, subset, gpu, torch, cuda, dataset_total_samples, evaluated_samples; eligible ones only.
    Runs without a sample are left out. Base fields come from the run with the least subset, then the least run_id.
    """
    keys = ["model", "model_repo"]
    runs = runs.join(samples.select("run_id").distinct(), "run_id", "left_semi")
    whole = complete_groups(runs, keys, subsets).where("complete")
    same = lambda a, b: a["model"].eqNullSafe(b["model"]) & a["model_repo"].eqNullSafe(b["model_repo"])
    runs = runs.join(whole, same(runs, whole), "left_semi")
    base = F.min_by(F.struct("gpu", "torch", "cuda"), F.struct("subset", "run_id"))
    heads = runs.groupBy(*keys).agg(
        base.alias("base"), F.sum(F.coalesce("dataset_total_samples", F.lit(0))).alias("dataset_total_samples"), F.sum(F.coalesce("evaluated_samples", F.lit(0))).alias("evaluated_samples"),
        F.transform(F.array_sort(F.collect_list(F.struct("subset", "run_id"))), lambda x: x["run_id"]).alias("source_run_ids"),
    )
    facts = aggregate_samples(samples.join(runs.select("run_id", *keys), "run_id"), keys)
    heads = heads.select(F.col("model").alias("_m"), F.col("model_repo").alias("_r"), "base.gpu", "base.torch", "base.cuda", "dataset_total_samples", "evaluated_samples", "source_run_ids")
    joined = facts.join(heads, facts["model"].eqNullSafe(F.col("_m")) & facts["model_repo"].eqNullSafe(F.col("_r"))).drop("_m", "_r")
    return joined.withColumn("subset", F.lit(FULL_SET)).withColumn("is_full_evaluation", F.lit(True))
