"""Error rates, outliers and run aggregates of the recognition results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.functions import metrics as M
from maldure.operators import aggregate as A
from maldure.operators.leaderboard import ranked
from maldure.plans.registry import query, rounded
from maldure.tables import load, spread_out

_BOTH = "normalized_reference IS NOT NULL AND normalized_prediction IS NOT NULL"


def _rows(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    rows = load(spark, sf_dir, "sample_results").where(_BOTH)
    return rows.select("row_id", *[c.alias(n) for n, c in columns.items()])


def _pair() -> tuple[Column, Column]:
    return F.col("normalized_prediction"), F.col("normalized_reference")


def _stored(name: str) -> str:
    return f"SELECT row_id, metrics.{name} AS {name} FROM sample_results WHERE {_BOTH}"


@query(_stored("wer"))
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, wer=M.wer(*_pair()))


@query(_stored("cer"))
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, cer=M.cer(*_pair()))


@query(_stored("jer"))
def jer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, jer=M.jer(*_pair()))


@query(f"SELECT row_id, CASE WHEN normalized_prediction <> normalized_reference THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ser FROM sample_results WHERE {_BOTH}")
def ser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, ser=M.ser(*_pair()))


@query()
def mer_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morpheme error rate with a tokenizer handed in; here words without a final particle, since none is installed."""
    import re

    particle = re.compile("(에서|까지|부터|으로도|이랑|랑|은|는|이|가|을|를|도|만)$")
    return _rows(spark, sf_dir, mer=M.mer(*_pair(), lambda t: [x for w in t.split() for x in particle.split(w, maxsplit=1) if x]))


_EDITS = ("hits", "substitutions", "deletions", "insertions")
_NAMES = [f"{m}_{x}" for m in ("wer", "cer", "jer") for x in _EDITS]


@query(f"SELECT row_id, {', '.join(f'metrics.{n} AS {n}' for n in _NAMES)} FROM sample_results WHERE {_BOTH}")
def edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and the counts of edit operations of all three metrics, against the stored ones."""
    rows = spread_out(load(spark, sf_dir, "sample_results").where(_BOTH).select("row_id", "normalized_reference", "normalized_prediction"))
    own = rows.select("row_id", *[M.counts(m, *_pair()).alias(m) for m in ("wer", "cer", "jer")])
    return own.select("row_id", *[F.col(f"{n[:3]}.{n[4:]}").cast("long").alias(n) for n in _NAMES])


@query("""
SELECT row_id, CASE WHEN normalized_prediction = '' THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END AS cer,
  CASE WHEN regexp_matches(normalized_prediction, '\\S') THEN 'inf'::DOUBLE ELSE 0.0::DOUBLE END AS wer
FROM sample_results WHERE normalized_reference = '' AND normalized_prediction IS NOT NULL
""")
def err_empty_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "sample_results").where("normalized_reference = '' AND normalized_prediction IS NOT NULL")
    return rows.select("row_id", M.cer(*_pair()).alias("cer"), M.wer(*_pair()).alias("wer"))


@query(f"SELECT row_id, metrics.wer AS wer, metrics.cer AS cer, metrics.jer AS jer, metrics.ser AS ser FROM sample_results WHERE {_BOTH}")
def evaluate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics by name; a name that is none is passed over."""
    return _rows(spark, sf_dir, **M.evaluate(*_pair(), ["wer", "cer", "jer", "ser", "flops", "no_such_metric"]))


@query("SELECT row_id, CASE WHEN audio_duration = 0 THEN 'inf'::DOUBLE ELSE processing_time / audio_duration END AS rtf, processing_time AS latency FROM sample_results WHERE processing_time IS NOT NULL AND isfinite(processing_time)")
def rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "sample_results").where(M.finite(F.col("processing_time")).isNotNull())
    return rows.select("row_id", M.rtf(F.col("processing_time"), F.col("audio_duration")).alias("rtf"), F.col("processing_time").alias("latency"))


@query("SELECT row_id, coalesce(nullif(sample_rate, 0), 16000) AS rate, CASE WHEN sample_rate <= 0 THEN 0.0::DOUBLE ELSE round(audio_duration * 16000) / sample_rate END AS duration FROM sample_results")
def audio_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate with its default, and the duration of as many samples as the utterance has at 16 kHz."""
    n = F.round(F.col("audio_duration") * 16000)
    return load(spark, sf_dir, "sample_results").select("row_id", M.sample_rate(F.col("sample_rate")).alias("rate"), M.audio_duration(n, F.col("sample_rate")).alias("duration"))


@query("SELECT row_id, coalesce(metadata['id'], metadata['sample_id'], metadata['utt_id'], metadata['audio_path'], sample_id, CAST(sample_index AS VARCHAR)) AS sample_id FROM sample_results")
def sample_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [F.try_element_at("metadata", F.lit(k)) for k in ("id", "sample_id", "utt_id", "audio_path")]
    return load(spark, sf_dir, "sample_results").select("row_id", F.coalesce(*named, "sample_id", F.col("sample_index").cast("string")).alias("sample_id"))


@query("""
SELECT s.row_id FROM sample_results s JOIN runs r USING (run_id)
WHERE CASE r.outlier_policy.metric WHEN 'wer' THEN s.metrics.wer WHEN 'cer' THEN s.metrics.cer WHEN 'mer' THEN s.metrics.mer WHEN 'jer' THEN s.metrics.jer WHEN 'ser' THEN s.metrics.ser WHEN 'rtf' THEN nullif(s.metrics.rtf, 'nan'::DOUBLE) WHEN 'latency' THEN nullif(s.metrics.latency, 'nan'::DOUBLE) END > r.outlier_policy.threshold
""")
def outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that their run's own policy excludes."""
    rows = load(spark, sf_dir, "sample_results").join(load(spark, sf_dir, "runs").select("run_id", "outlier_policy"), "run_id")
    value = F.coalesce(*[F.when(F.col("outlier_policy.metric") == m, F.col(f"metrics.{m}")) for m in A.RATES])
    return rows.where(M.is_outlier(value, F.col("outlier_policy.threshold"))).select("row_id")


@query("SELECT run_id, limit_samples IS NULL AND coalesce(dataset_total_samples = evaluated_samples, false) AS is_full FROM runs")
def is_full_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.col("limit_samples").isNull() & F.coalesce(F.col("dataset_total_samples") == F.col("evaluated_samples"), F.lit(False))
    return load(spark, sf_dir, "runs").select("run_id", full.alias("is_full"))


@query("SELECT row_id FROM sample_results s JOIN runs r USING (run_id) WHERE sample_index = 0 OR (r.log_interval > 0 AND (sample_index + 1) % r.log_interval = 0) OR sample_index + 1 = r.evaluated_samples OR coalesce(is_outlier, false)")
def log_sample_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that a run logs: the first, each so-many-th, the last, and outliers."""
    rows = load(spark, sf_dir, "sample_results").join(load(spark, sf_dir, "runs").select("run_id", "log_interval", "evaluated_samples"), "run_id")
    every = F.when(F.col("log_interval") > 0, (F.col("sample_index") + 1) % F.col("log_interval") == 0)
    pick = (F.col("sample_index") == 0) | F.coalesce(every, F.lit(False)) | (F.col("sample_index") + 1 == F.col("evaluated_samples")) | F.coalesce("is_outlier", F.lit(False))
    return rows.where(pick).select("row_id")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "sample_results").select("run_id", "metrics", "processing_time", "is_outlier")


_VALID = "NOT coalesce(is_outlier, false)"
_COUNTS = f"count(*) AS total_samples, count_if({_VALID}) AS valid_samples, count(*) - count_if({_VALID}) AS outlier_count"
_MACRO = ", ".join(f"round(avg(metrics.{m}) FILTER (WHERE {_VALID} AND metrics.{m} IS NOT NULL AND isfinite(metrics.{m})), 9) AS macro_{m}" for m in A.RATES)


def _total(field: str) -> str:
    return f"coalesce(sum(metrics.{field}) FILTER (WHERE {_VALID}), 0)::DOUBLE"


def _micro(m: str) -> str:
    h, s, d, i = (_total(f"{m}_{x}") for x in _EDITS)
    return f"CASE WHEN {h} + {s} + {d} > 0 THEN round(({s} + {d} + {i}) / ({h} + {s} + {d}), 9) END AS micro_{m}"


_MICRO = ", ".join(_micro(m) for m in A.EDIT_RATES) + f", round({_total('ser_error_sentences')} / nullif({_total('ser_total_sentences')}, 0), 9) AS micro_ser"
_PCT = ", ".join(f"round(quantile_cont(processing_time, {p}) FILTER (WHERE {_VALID} AND processing_time IS NOT NULL AND isfinite(processing_time)), 9) AS p{int(100 * p)}" for p in A.PERCENTS)


@query(f"SELECT run_id, {_COUNTS} FROM sample_results GROUP BY run_id")
def agg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).groupBy("run_id").agg(*A.count_columns())


@query(f"SELECT run_id, {_MACRO} FROM sample_results GROUP BY run_id")
def macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_samples(spark, sf_dir).groupBy("run_id").agg(*A.macro_columns()))


@query(f"SELECT run_id, {_MICRO} FROM sample_results GROUP BY run_id")
def micro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_samples(spark, sf_dir).groupBy("run_id").agg(*A.micro_columns()))


@query(f"SELECT * FROM (SELECT run_id, {_PCT} FROM sample_results GROUP BY run_id) WHERE p50 IS NOT NULL")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.exact_percentiles(_samples(spark, sf_dir), ["run_id"]))


@query(f"SELECT run_id, {_COUNTS}, {_MACRO}, {_MICRO}, {_PCT} FROM sample_results GROUP BY run_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: everything about each run."""
    return rounded(A.aggregate_samples(_samples(spark, sf_dir), ["run_id"]))


@query("""
SELECT row_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY sample_index NULLS LAST, row_id) - 1 AS INT) AS position FROM sample_results
""")
def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running position of each row in its run."""
    rows = load(spark, sf_dir, "sample_results").select("row_id", "run_id", "sample_index")
    order = [F.asc_nulls_last("sample_index"), F.col("row_id").asc()]
    return ranked(rows, order, "place", ["run_id"]).select("row_id", (F.col("place") - 1).cast("int").alias("position"))


@query("SELECT s.row_id, s.run_id FROM sample_results s JOIN runs r USING (run_id) WHERE r.limit_samples IS NULL OR s.sample_index < r.limit_samples")
def limit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples within each run's own limit."""
    rows = load(spark, sf_dir, "sample_results").select("row_id", "run_id", "sample_index").join(load(spark, sf_dir, "runs").select("run_id", "limit_samples"), "run_id")
    return rows.where("limit_samples IS NULL OR sample_index < limit_samples").select("row_id", "run_id")
