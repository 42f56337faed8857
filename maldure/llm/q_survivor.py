"""Problem 1: one row per model, dataset and subset of leaderboard_rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.llm.queries import SQL, query
from maldure.llm.survivor import PLACEHOLDERS, best_representatives, leaves, nested, spelled
from maldure.tables import load

FIELDS = ("run_id", "model_repo", "gpu", "torch", "cuda", "command", "source")


def _slices(rows: DataFrame, others: Sequence[str] = (), completeness: str = "fields") -> DataFrame:
    """The groups of two rows or more; others: what is to be carried besides FIELDS, by its paths."""
    path = F.translate("artifact", "\\", "/")
    keyed = rows.select(
        "entry_id", *FIELDS, *dict.fromkeys(f.split(".")[0] for f in others),
        spelled(F.element_at(F.split(F.trim("model"), "/"), -1)).alias("_model"), spelled(F.col("dataset")).alias("_dataset"),
        F.coalesce(spelled(F.regexp_replace(F.trim("subset"), r"(?i)^(domain|eval)[_\- ]+", "")), F.lit("default")).alias("_subset"),
        (path.endswith("/leaderboard_row.json") | path.startswith("results/")).alias("_generated"),
    )
    return best_representatives(keyed, ["_model", "_dataset", "_subset"], "entry_id", F.col("_generated"), F.col("run_id"), FIELDS, others, completeness).where("rows > 1")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group and field, whose value survives; see TESTDATA.md."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`.donor").alias("donor_id")) for f in FIELDS])).alias("d")
    return _slices(load(spark, sf_dir, "leaderboard_rows")).select(F.col("survivor").alias("survivor_id"), each).select("survivor_id", "d.field_name", "d.donor_id").where("donor_id IS NOT NULL")


@query
def p1_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p1_found, with completeness as the number of filled fields: donors may be of later layers. Further columns: layer, and layers of the group."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`.donor").alias("donor_id"), F.col(f"`{f}`.layer").alias("layer")) for f in FIELDS])).alias("d")
    kept = _slices(load(spark, sf_dir, "leaderboard_rows"), completeness="count")
    return kept.select(F.col("survivor").alias("survivor_id"), "layers", each).select("survivor_id", "d.field_name", "d.donor_id", "d.layer", "layers").where("donor_id IS NOT NULL")


@query
def p1_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each field of each surviving row comes from, structs field by field: survivor_id, path, donor_id."""
    rows = load(spark, sf_dir, "leaderboard_rows")
    paths = [p for p, _ in leaves(rows.drop("entry_id").schema)]
    kept = _slices(rows, [p for p in paths if p not in FIELDS])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"`{p}`.donor").alias("donor_id")) for p in paths])).alias("d")
    return kept.select(F.col("survivor").alias("survivor_id"), each).select("survivor_id", "d.path", "d.donor_id").where("donor_id IS NOT NULL")


@query
def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving row of each group of two or more: every column of leaderboard_rows, every field with its best value."""
    return survivors(load(spark, sf_dir, "leaderboard_rows"))


def survivors(rows: DataFrame) -> DataFrame:
    """One row per group. Columns: those of ``rows`` (entry_id is the first row's), rows, survivor, skyline, filled_from.

    Each field inside of a struct is filled on its own; filled_from has the entry_id of each field's donor, by its path,
    where that isn't the survivor. model, dataset and subset come as the best row spells them; a subset that no row
    has is the default one.
    """
    held = rows.drop("entry_id")
    paths = [p for p, _ in leaves(held.schema)]
    kept = _slices(rows, [p for p in paths if p not in FIELDS])
    donors = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"`{p}`.donor").alias("donor")) for p in paths])
    lent = F.map_from_entries(F.filter(donors, lambda x: x["donor"] != F.col("survivor")))
    record = nested(held.schema, lambda p: F.coalesce(F.col(f"`{p}`.value"), F.lit("default")) if p == "subset" else F.col(f"`{p}`.value"))
    return kept.select(F.col("survivor").alias("entry_id"), *record, "rows", "survivor", "skyline", lent.alias("filled_from"))


_MISSING = ", ".join(f"'{x}'" for x in PLACEHOLDERS)
_RANKED = rf"""
WITH named AS (
  SELECT *, regexp_replace(lower(trim(list_last(string_split(trim(model), '/')))), '[^\p{{L}}\p{{N}}]+', '', 'g') AS m,
         regexp_replace(lower(trim(dataset)), '[^\p{{L}}\p{{N}}]+', '', 'g') AS d,
         CASE WHEN subset IS NULL OR lower(trim(subset)) IN ({_MISSING}) THEN 'default'
              ELSE regexp_replace(regexp_replace(lower(trim(subset)), '^(domain|eval)[_\- ]+', ''), '[^\p{{L}}\p{{N}}]+', '', 'g') END AS s,
         coalesce(replace(artifact, '\', '/') LIKE '%/leaderboard_row.json' OR replace(artifact, '\', '/') LIKE 'results/%', false) AS g
  FROM leaderboard_rows
  WHERE lower(trim(model)) NOT IN ({_MISSING}) AND lower(trim(dataset)) NOT IN ({_MISSING})
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY m, d, s ORDER BY g DESC, run_id DESC NULLS LAST, entry_id) AS place,
         count(*) OVER (PARTITION BY m, d, s) AS n, first_value(entry_id) OVER (PARTITION BY m, d, s ORDER BY g DESC, run_id DESC NULLS LAST, entry_id) AS survivor_id
  FROM named
)"""


def _donors(texts: Sequence[str], others: Sequence[str], name: str) -> str:
    """SQL: of each group and field, the first row with a real value."""
    given = {**{f: f"{f} IS NOT NULL AND lower(trim({f})) NOT IN ({_MISSING})" for f in texts}, **{f: f"{f} IS NOT NULL AND CAST({f} AS VARCHAR) <> 'nan'" for f in others}}
    cells = " UNION ALL ".join(f"SELECT survivor_id, entry_id, place, '{f}' AS {name} FROM ranked WHERE n > 1 AND {has}" for f, has in given.items())
    return f"{_RANKED}, cells AS ({cells}) SELECT survivor_id, {name}, min_by(entry_id, place) AS donor_id FROM cells GROUP BY survivor_id, {name}"


_RATES = ("wer", "cer", "mer", "jer", "ser", "rtf", "latency")
_METRICS = [f"metrics.macro.{m}" for m in _RATES] + [f"metrics.micro.{m}" for m in _RATES[:5]] + [f"metrics.latency_percentiles.p{p}" for p in (50, 90, 95, 99)]
SQL["p1_found"] = _donors(FIELDS, (), "field_name")
SQL["p1_donors"] = _donors(
    [*FIELDS, "model", "dataset", "subset", "artifact", "model_metrics.flops", "model_metrics.macs", "model_metrics.params", "outlier_policy.metric"],
    [*_METRICS, "model_metrics.total_parameters", "model_metrics.trainable_parameters", "total_samples", "dataset_total_samples", "evaluated_samples", "valid_samples", "outlier_count", "is_full_evaluation", "outlier_policy.threshold", "collected_at"],
    "path",
)
