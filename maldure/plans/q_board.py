"""Leaderboards over the collected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.functions.metrics import outlier_rate as outlier_rate_of
from maldure.functions.text import subset_or_default
from maldure.operators import aggregate as A
from maldure.operators import leaderboard as L
from maldure.operators import quality as Q
from maldure.plans import q_text  # noqa: F401  (its SQL is used here)
from maldure.plans.registry import SQL, query, rounded
from maldure.sources.sinks import HEADINGS
from maldure.tables import load


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "leaderboard_rows")


_GENERATED = "(replace(coalesce(artifact, ''), '\\', '/') LIKE '%/leaderboard_row.json' OR replace(coalesce(artifact, ''), '\\', '/') LIKE 'results/%')"
_RATE = "CASE WHEN coalesce(nullif(evaluated_samples, 0), nullif(total_samples, 0)) > 0 THEN coalesce(outlier_count, 0) / coalesce(nullif(evaluated_samples, 0), nullif(total_samples, 0))::DOUBLE ELSE 'inf'::DOUBLE END"
_CER = "CASE WHEN metrics.macro.cer IS NOT NULL AND isfinite(metrics.macro.cer) THEN metrics.macro.cer ELSE 'inf'::DOUBLE END"


@query(f"SELECT entry_id, {_RATE} AS rate FROM leaderboard_rows")
def outlier_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("entry_id", outlier_rate_of(F.col("outlier_count"), F.col("evaluated_samples"), F.col("total_samples")).alias("rate"))


@query("SELECT entry_id FROM leaderboard_rows WHERE coalesce(is_full_evaluation, false)")
def full_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where(L.is_full()).select("entry_id")


@query("SELECT entry_id FROM leaderboard_rows WHERE is_full_evaluation IS DISTINCT FROM false")
def not_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where(L.not_partial()).select("entry_id")


@query(f"""
WITH run AS (SELECT r.run_id, model_name AS model, dataset_name AS dataset, dataset_subset AS subset, a.macro_average.cer AS cer, 0 AS arrival FROM runs r LEFT JOIN run_aggregates a USING (run_id)),
curated AS (SELECT run_id, model, dataset, subset, metrics.macro.cer AS cer, 1 AS arrival FROM leaderboard_rows WHERE coalesce(is_full_evaluation, false) AND NOT {_GENERATED})
SELECT * FROM run UNION ALL SELECT * FROM curated
""")
def union_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows and curated rows as one board."""
    runs = load(spark, sf_dir, "runs").join(load(spark, sf_dir, "run_aggregates"), "run_id", "left")
    runs = runs.select("run_id", F.col("model_name").alias("model"), F.col("dataset_name").alias("dataset"), F.col("dataset_subset").alias("subset"), F.col("macro_average.cer").alias("cer"))
    curated = _rows(spark, sf_dir).where(L.is_full() & ~L.is_generated(F.col("artifact"))).select("run_id", "model", "dataset", "subset", F.col("metrics.macro.cer").alias("cer"))
    return L.union_rows(runs, curated)


@query(f"""
SELECT entry_id FROM (SELECT entry_id, row_number() OVER (PARTITION BY CASE WHEN model IS NULL OR dataset IS NULL THEN coalesce(run_id, '') END, model IS NULL OR dataset IS NULL, model, dataset, subset
  ORDER BY {_GENERATED} DESC, coalesce(run_id, '') DESC, entry_id) AS place FROM leaderboard_rows) WHERE place = 1
""")
def dedupe_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dedupe(_rows(spark, sf_dir)).select("entry_id")


@query("SELECT entry_id, row_number() OVER (ORDER BY metrics.macro.cer NULLS LAST, entry_id) AS rank FROM leaderboard_rows WHERE coalesce(is_full_evaluation, false)")
def rank_by_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _rows(spark, sf_dir).where(L.is_full()).select("entry_id", F.col("metrics.macro.cer").alias("cer"))
    return L.ranked(own, [F.asc_nulls_last("cer"), F.col("entry_id").asc()]).select("entry_id", "rank")


_SLICE = "coalesce(nullif(subset, ''), 'default')"
_BEST = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset, {_SLICE} ORDER BY {_CER}, entry_id) AS place
  FROM leaderboard_rows WHERE coalesce(model, '') <> '' AND coalesce(dataset, '') <> '') WHERE place = 1
"""


@query(f"SELECT entry_id FROM ({_BEST})")
def best_per_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_per_slice(_rows(spark, sf_dir)).select("entry_id")


_LABELLED = f"SELECT b.*, l.label FROM ({_BEST}) b JOIN ({SQL['dataset_label'] if 'dataset_label' in SQL else ''}) l USING (entry_id)"


def _mean(sql: str) -> str:
    return f"round(avg({sql}) FILTER (WHERE {sql} IS NOT NULL AND isfinite({sql})), 9)"


_OVERALL = ", ".join(f"{_mean(f'metrics.macro.{m}')} AS {m}" for m in L.BOARD_METRICS)


@query(f"""
SELECT model, count(*) AS slices, {_OVERALL}, {_mean(_RATE)} AS outlier_rate,
  arg_min(run_id, struct_pack(a := {_CER}, b := label, c := entry_id)) AS best_run_id FROM ({_LABELLED}) GROUP BY model
""")
def overall_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.overall_board(_rows(spark, sf_dir))
    return rounded(own.select("model", "slices", *L.BOARD_METRICS, "outlier_rate", "best_run_id"))


@query(f"""
SELECT row_number() OVER (ORDER BY coalesce(cer, 'inf'::DOUBLE), model) AS rank, model, slices, cer FROM (
  SELECT model, count(*) AS slices, {_mean('metrics.macro.cer')} AS cer FROM ({_BEST}) GROUP BY model)
""")
def ranked_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall board with its ranks."""
    own = rounded(L.overall_board(_rows(spark, sf_dir)).select("model", "slices", "cer"))
    return L.ranked(own, [F.coalesce("cer", F.lit(float("inf"))).asc(), F.col("model").asc()]).select("rank", "model", "slices", "cer")


@query(f"""
SELECT model, dataset, array_to_string(list_sort(list_distinct(list({_SLICE}))), ',') AS subsets,
  array_to_string(list_sort(list_distinct(list(coalesce(nullif(source, ''), 'run artifact')))), ',') AS sources FROM ({_BEST}) GROUP BY model, dataset
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which subsets and sources each model's best runs cover."""
    best = L.best_per_slice(_rows(spark, sf_dir))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return best.groupBy("model", "dataset").agg(joined(subset_or_default(F.col("subset"))).alias("subsets"), joined(F.coalesce(F.nullif("source", F.lit("")), F.lit(L.NO_SOURCE))).alias("sources"))


@query(f"""
SELECT count(*) AS rows, count(DISTINCT nullif(model, '')) AS models, count(DISTINCT label) AS slices, min(metrics.macro.cer) FILTER (WHERE isfinite(metrics.macro.cer)) AS best_cer,
  arg_min(model, struct_pack(a := metrics.macro.cer, b := entry_id)) FILTER (WHERE isfinite(metrics.macro.cer)) AS best_model,
  arg_min(label, struct_pack(a := metrics.macro.cer, b := entry_id)) FILTER (WHERE isfinite(metrics.macro.cer)) AS best_label
FROM (SELECT b.*, l.label FROM leaderboard_rows b JOIN ({SQL.get('dataset_label', '')}) l USING (entry_id))
""")
def summary_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summary(_rows(spark, sf_dir))


@query(f"SELECT dataset, {_SLICE} AS subset, count(*) AS n FROM leaderboard_rows WHERE dataset IS NOT NULL GROUP BY ROLLUP (dataset, {_SLICE})")
def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per dataset and subset, with totals."""
    own = _rows(spark, sf_dir).where("dataset IS NOT NULL").select("dataset", subset_or_default(F.col("subset")).alias("subset"))
    return own.rollup("dataset", "subset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS row_count, count_if(is_full_evaluation IS DISTINCT FROM false) AS full_run_count FROM leaderboard_rows")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(L.not_partial()).alias("full_run_count"))


@query(f"""
SELECT entry_id, row_number() OVER (ORDER BY {_CER}, label, model NULLS FIRST, entry_id) AS place FROM (SELECT b.*, l.label FROM leaderboard_rows b JOIN ({SQL.get('dataset_label', '')}) l USING (entry_id))
""")
def board_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board's order: error rate, slice, model."""
    from maldure.functions.text import slice_label

    own = _rows(spark, sf_dir).select("entry_id", "model", L.sort_key("cer").alias("k"), slice_label(F.col("dataset"), F.col("subset")).alias("label"))
    return L.ranked(own, [F.col("k").asc(), F.col("label").asc(), F.asc_nulls_first("model"), F.col("entry_id").asc()], "place").select("entry_id", "place")


@query(f"""
SELECT DISTINCT dataset, s AS subset, CAST(CASE s WHEN 'clean' THEN 1 WHEN 'other' THEN 2 WHEN 'D01' THEN 3 WHEN 'D02' THEN 4 WHEN 'D03' THEN 5 WHEN 'D04' THEN 6 WHEN 'all' THEN 7 WHEN 'default' THEN 8 ELSE 9 END AS INT) AS place
FROM (SELECT dataset, {_SLICE} AS s FROM leaderboard_rows)
""")
def subset_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _rows(spark, sf_dir).select("dataset", subset_or_default(F.col("subset")).alias("subset")).distinct()
    return own.withColumn("place", L.subset_place(F.col("subset")))


@query(f"SELECT b.entry_id FROM leaderboard_rows b JOIN ({SQL.get('search_text', '')}) t USING (entry_id) WHERE dataset = 'AIHubLowQualityTelephone' AND {_SLICE} = 'D03' AND contains(searched, 'tiny')")
def board_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.board_filter(_rows(spark, sf_dir), "AIHubLowQualityTelephone", "D03", search="Tiny").select("entry_id")


@query(f"SELECT dataset, CASE WHEN dataset = 'AIHubLowQualityTelephone' AND bool_or({_SLICE} = 'all') THEN 'all' END AS opens_on FROM leaderboard_rows WHERE dataset IS NOT NULL GROUP BY dataset")
def board_default_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.default_subset(_rows(spark, sf_dir))


_CELLS = " || ' | ' || ".join([
    *(f"coalesce({c}, '')" for c in ("model", "dataset", "subset")), *(f"coalesce(printf('%.4f', metrics.macro.{m}), '')" for m in ("wer", "cer", "mer", "jer", "ser", "rtf", "latency")),
    "coalesce(gpu, '')", "coalesce(outlier_count, 0) || ' / ' || coalesce(evaluated_samples, total_samples, 0)", "coalesce(run_id, '')",
])


@query(f"""
SELECT row_number() OVER (ORDER BY metrics.macro.cer NULLS LAST, entry_id) AS place, '| ' || {_CELLS} || ' |' AS line FROM leaderboard_rows WHERE coalesce(is_full_evaluation, false)
""")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.markdown_table(_rows(spark, sf_dir).where(L.is_full()), tuple(HEADINGS))


_RULES = {
    "mock": "coalesce(model = 'mock', false) OR coalesce(dataset = 'mock', false)",
    "is_full_evaluation": "is_full_evaluation IS NOT TRUE",
    "evaluated_samples": "coalesce(evaluated_samples <= 0, true)",
    "dataset_total_samples": "coalesce(dataset_total_samples <= 0, true)",
    "total_samples": "coalesce(total_samples <= 0, true)",
    "evaluated_differs": "coalesce(evaluated_samples <> dataset_total_samples, false)",
    "metrics": "metrics IS NULL",
    "metrics.macro": "metrics.macro IS NULL",
    "outlier_policy": "outlier_policy IS NULL",
    **{f"metrics.macro.{m}": f"metrics.macro.{m} IS NULL" for m in Q.REQUIRED_METRICS},
    **{f"command.{n}": f"coalesce(regexp_matches(command, '{p}'), false)" for n, p in Q.LOCAL_PATHS.items()},
}
_PROBLEMS = " UNION ALL ".join(f"SELECT entry_id, '{n}' AS problem FROM leaderboard_rows WHERE {c}" for n, c in _RULES.items())


@query(_PROBLEMS)
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate_rows(_rows(spark, sf_dir))


@query(f"SELECT problem, count(*) AS n FROM ({_PROBLEMS}) GROUP BY problem")
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate_rows(_rows(spark, sf_dir)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# as text, what is null is missing, and numbers that are not finite are no numbers
_TEXT_RULES = {
    **_RULES, **{f"missing.{n}": f"{n} IS NULL" for n in Q.REQUIRED},
    **{f"metrics.macro.{m}": f"coalesce(NOT isfinite(metrics.macro.{m}), true)" for m in Q.REQUIRED_METRICS},
    **{f"metrics.macro.{m}": f"coalesce(NOT isfinite(metrics.macro.{m}), false)" for m in Q.OPTIONAL_METRICS},
    "outlier_policy": "outlier_policy.metric IS NULL OR outlier_policy.threshold IS NULL",
}


@query(" UNION ALL ".join(f"SELECT entry_id, '{n}' AS problem FROM leaderboard_rows WHERE {c}" for n, c in _TEXT_RULES.items()))
def validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as JSON text, validated by types and presence."""
    whole = _rows(spark, sf_dir)
    return Q.validate_json(whole.select("entry_id", F.to_json(F.struct(*[c for c in whole.columns if c != "collected_at"])).alias("raw")), "entry_id", "raw")


@query("""
SELECT entry_id, array_to_string(list_sort(list_filter([CASE WHEN run_id IS NULL THEN 'run_id' END, CASE WHEN model IS NULL THEN 'model' END, CASE WHEN model_repo IS NULL THEN 'model_repo' END, CASE WHEN dataset IS NULL THEN 'dataset' END], lambda x: x IS NOT NULL)), ',') AS missing
FROM leaderboard_rows WHERE run_id IS NULL OR model IS NULL OR model_repo IS NULL OR dataset IS NULL
""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the required text fields a row lacks."""
    names = ("run_id", "model", "model_repo", "dataset")
    wanted = F.array(*[F.lit(n) for n in names])
    have = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))
    own = _rows(spark, sf_dir).select("entry_id", F.array_join(F.array_sort(F.array_except(wanted, have)), ",").alias("missing"))
    return own.where("missing <> ''")


_PATTERNS = {**Q.SECRETS, **Q.LOCAL_PATHS}
_TEXTS = "SELECT 'documents:' || doc_id AS place, text FROM documents UNION ALL SELECT 'runs:' || run_id, command FROM runs"
_HITS = " UNION ALL ".join("SELECT place, '{}' AS rule, CAST(len(regexp_extract_all(text, '{}')) AS INT) AS hits FROM ({})".format(n, p.replace("'", "''"), _TEXTS) for n, p in _PATTERNS.items())


@query(f"SELECT * FROM ({_HITS}) WHERE hits > 0")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and local paths in documents and in the runs' commands."""
    texts = load(spark, sf_dir, "documents").select(F.concat(F.lit("documents:"), F.col("doc_id")).alias("place"), "text")
    commands = load(spark, sf_dir, "runs").select(F.concat(F.lit("runs:"), F.col("run_id")).alias("place"), F.col("command").alias("text"))
    return Q.scan_texts(texts.unionByName(commands), "place", "text")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = load(spark, sf_dir, "runs")
    return runs.select(
        "run_id", F.col("model_name").alias("model"), "model_repo", F.col("dataset_name").alias("dataset"), F.col("dataset_subset").alias("subset"), F.col("environment").getItem("gpu").alias("gpu"),
        F.col("environment").getItem("torch").alias("torch"), F.col("environment").getItem("cuda").alias("cuda"), "dataset_total_samples", "evaluated_samples", "is_full_evaluation",
    )


_ELIGIBLE = "SELECT run_id, model_name AS model, model_repo, dataset_subset AS subset, dataset_total_samples, evaluated_samples FROM runs WHERE dataset_name = 'AIHubLowQualityTelephone' AND dataset_subset IN ('D01', 'D02', 'D03', 'D04') AND is_full_evaluation IS TRUE AND run_id IN (SELECT run_id FROM sample_results)"


@query(_ELIGIBLE)
def rollup_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.eligible_runs(_runs(spark, sf_dir), "AIHubLowQualityTelephone").join(load(spark, sf_dir, "sample_results").select("run_id"), "run_id", "left_semi")
    return runs.select("run_id", "model", "model_repo", "subset", "dataset_total_samples", "evaluated_samples")


@query(f"""
SELECT model, model_repo, array_to_string(s, ',') AS subsets, array_to_string(list_filter(['D01', 'D02', 'D03', 'D04'], lambda x: NOT list_contains(s, x)), ',') AS missing, len(s) = 4 AS complete
FROM (SELECT model, model_repo, list_sort(list_distinct(list(subset))) AS s FROM ({_ELIGIBLE}) GROUP BY model, model_repo)
""")
def rollup_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.complete_groups(rollup_eligible(spark, sf_dir), ["model", "model_repo"])
    return own.select("model", "model_repo", F.array_join("subsets", ",").alias("subsets"), F.array_join("missing", ",").alias("missing"), "complete")


_ROLLUP_COLUMNS = ("total_samples", "valid_samples", "outlier_count")


def _rollup_sql(subsets: tuple[str, ...]) -> str:
    from maldure.plans import q_metrics as M

    wanted = ", ".join(f"'{s}'" for s in subsets)
    eligible = _ELIGIBLE.replace("('D01', 'D02', 'D03', 'D04')", f"({wanted})")
    facts = f"{M._COUNTS}, {M._MACRO}, {M._MICRO}, {M._PCT}"
    return f"""
WITH e AS ({eligible}), g AS (SELECT model, model_repo FROM e GROUP BY model, model_repo HAVING count(DISTINCT subset) = {len(subsets)}),
k AS (SELECT e.* FROM e JOIN g ON e.model IS NOT DISTINCT FROM g.model AND e.model_repo IS NOT DISTINCT FROM g.model_repo),
f AS (SELECT k.model, k.model_repo, {facts} FROM sample_results s JOIN k USING (run_id) GROUP BY k.model, k.model_repo),
h AS (SELECT model, model_repo, sum(coalesce(dataset_total_samples, 0))::BIGINT AS dataset_total_samples, sum(coalesce(evaluated_samples, 0))::BIGINT AS evaluated_samples, string_agg(run_id, ',' ORDER BY subset, run_id) AS source_run_ids FROM k GROUP BY model, model_repo)
SELECT f.*, h.dataset_total_samples, h.evaluated_samples, h.source_run_ids FROM f JOIN h ON f.model IS NOT DISTINCT FROM h.model AND f.model_repo IS NOT DISTINCT FROM h.model_repo
"""


def _rollup(spark: SparkSession, sf_dir: str, subsets: tuple[str, ...]) -> DataFrame:
    runs = A.eligible_runs(_runs(spark, sf_dir), "AIHubLowQualityTelephone", subsets)
    samples = load(spark, sf_dir, "sample_results").select("run_id", "metrics", "processing_time", "is_outlier")
    own = A.roll_up(runs, samples, subsets).drop("gpu", "torch", "cuda", "subset", "is_full_evaluation")
    return rounded(own.withColumn("source_run_ids", F.array_join("source_run_ids", ",")))


@query(_rollup_sql(A.DOMAINS))
def domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of each model's complete set of domains, as one row."""
    return _rollup(spark, sf_dir, A.DOMAINS)


@query(_rollup_sql(("D01", "D02")))
def domain_rollup_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over two domains, which more models of the small tables have."""
    return _rollup(spark, sf_dir, ("D01", "D02"))


@query("SELECT s.run_id, s.row_id, r.model_name AS model FROM sample_results s JOIN runs r USING (run_id)")
def run_samples_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample with its run."""
    return load(spark, sf_dir, "sample_results").select("run_id", "row_id").join(load(spark, sf_dir, "runs").select("run_id", F.col("model_name").alias("model")), "run_id")
