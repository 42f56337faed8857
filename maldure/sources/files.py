"""File sources: manifests, transcript lists, run artifacts and curated rows, all under explicit schemas."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.functions.text import spontaneous

MANIFEST = "audio_path string, audio_filepath string, path string, text string, transcript string, sentence string, id string, sample_id string, utt_id string, sample_rate int, speaker string, duration double"
RATES = "struct<wer: double, cer: double, mer: double, jer: double, ser: double, rtf: double, latency: double>"
ERRORS = "struct<wer: double, cer: double, mer: double, jer: double, ser: double>"
PERCENTILES = "struct<p50: double, p90: double, p95: double, p99: double>"
BOARD_ROW = (
    "run_id string, model string, model_repo string, dataset string, subset string, gpu string, torch string, cuda string, "
    f"metrics struct<macro: {RATES}, micro: {ERRORS}, latency_percentiles: {PERCENTILES}>, "
    "model_metrics struct<flops: string, macs: string, params: string, total_parameters: bigint, trainable_parameters: bigint>, "
    "total_samples bigint, dataset_total_samples bigint, evaluated_samples bigint, valid_samples bigint, outlier_count bigint, "
    "is_full_evaluation boolean, outlier_policy struct<metric: string, threshold: double>, command string, source string, "
    "aggregation struct<subsets: array<string>, source_run_ids: array<string>>"
)
#: The row that an evaluation writes.
RUN_ROW = (
    "run_id string, model string, model_repo string, dataset string, subset string, gpu string, torch string, cuda string, dataset_total_samples bigint, evaluated_samples bigint, "
    "is_full_evaluation boolean, outlier_policy struct<metric: string, threshold: double>, command string, "
    f"metrics struct<macro: {RATES}, micro: {ERRORS}, latency_percentiles: {PERCENTILES}>, "
    "model_metrics struct<flops: string, macs: string, params: string, total_parameters: bigint, trainable_parameters: bigint>, total_samples bigint, valid_samples bigint, outlier_count bigint"
)
_EDITS = ", ".join(f"{m}_{x}: bigint" for m in ("wer", "cer", "mer", "jer") for x in ("hits", "substitutions", "deletions", "insertions"))
SAMPLE = (
    "index int, sample_id string, reference string, prediction string, normalized_reference string, normalized_prediction string, "
    f"metrics {RATES[:-1]}, {_EDITS}, ser_error_sentences: bigint, ser_total_sentences: bigint>, processing_time double, audio_duration double, sample_rate int, is_outlier boolean, metadata map<string, string>"
)


def resolve_path(path: Column, root: str) -> Column:
    """An absolute path, or one below the root."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), path))


def with_aliases(rows: DataFrame, root: str = "", *keep: str | Column) -> DataFrame:
    """``audio_path`` (resolved) and ``text`` from the first alias that isn't empty; ``sample_id`` from the first that is there; the columns ``keep``."""
    filled = lambda names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    audio, text = filled(("audio_path", "audio_filepath", "path")), filled(("text", "transcript", "sentence"))
    own = rows.select(
        *keep, (resolve_path(audio, root) if root else audio).alias("audio_path"), F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce("id", "sample_id", "utt_id", audio).alias("sample_id"), F.coalesce(F.nullif("sample_rate", F.lit(0)), F.lit(16000)).alias("sample_rate"), "speaker", "duration",
    )
    return own


def read_manifest(spark: SparkSession, path: str, root: str | None = None, *keep: str | Column) -> DataFrame:
    """A manifest of JSON lines or CSV with a header, told by its suffix; another suffix is an error. keep: as in with_aliases."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".jsonl":
        rows = spark.read.schema(MANIFEST).json(path)
    elif suffix == ".csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        kinds = dict(x.split() for x in MANIFEST.split(", "))
        rows = raw.select(*[(F.col(n).try_cast(k) if n in raw.columns else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()])
    else:
        raise ValueError(f"a manifest ends in .jsonl or .csv, not {suffix!r}")
    return with_aliases(rows, os.path.dirname(path) if root is None else root, *keep)


def parse_transcripts(lines: DataFrame, root: str = "", column: str = "value") -> DataFrame:
    """Lines ``path :: text``: the path without its last character, the text between the first two ``::`` without its first, normalized."""
    parts = F.split(F.col(column), "::")
    first = F.try_element_at(parts, F.lit(1))
    path, text = F.substr(first, F.lit(1), F.greatest(F.length(first) - 1, F.lit(0))), F.substr(F.try_element_at(parts, F.lit(2)), F.lit(2))
    rows = lines.where(F.size(parts) > 1)
    return rows.select((resolve_path(path, root) if root else path).alias("audio_path"), spontaneous(text).alias("text"))


def read_transcripts(spark: SparkSession, folder: str, subset: str, root: str = "") -> DataFrame:
    """The transcript list of a subset, ``eval_<subset>.trn``."""
    return parse_transcripts(spark.read.text(f"{folder}/eval_{subset}.trn"), root)


def read_board_rows(spark: SparkSession, folder: str, tolerant: bool = False) -> DataFrame:
    """Every ``leaderboard_row.json`` below a folder, with its path as ``artifact``; unreadable ones fail, or are left out."""
    reader = spark.read.schema(BOARD_ROW + (", _corrupt_record string" if tolerant else "")).option("recursiveFileLookup", True).option("pathGlobFilter", "leaderboard_row.json").option("multiLine", True)
    rows = reader.option("mode", "PERMISSIVE" if tolerant else "FAILFAST").json(folder).withColumn("artifact", F.col("_metadata.file_path"))
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record") if tolerant else rows


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of board rows; an absent file has no rows, anything but an array of objects is an error."""
    import json

    from maldure.sources.sinks import exists, read_text

    if not exists(spark, path):
        return spark.createDataFrame([], BOARD_ROW)
    held = json.loads(read_text(spark, path))
    if not isinstance(held, list) or not all(isinstance(x, dict) for x in held):
        raise ValueError(f"{path} isn't a list of objects")
    return spark.read.schema(BOARD_ROW).option("multiLine", True).json(path).withColumn("artifact", F.lit(path))


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of every run below a folder, with the run's folder as ``run_dir``.

    A run's ``samples.jsonl`` is one file, or the folder of part files that this package writes.
    """
    reader = spark.read.schema(SAMPLE).option("recursiveFileLookup", True).option("pathGlobFilter", "{samples.jsonl,part-*}")
    path = F.col("_metadata.file_path")
    rows = reader.json(folder).where(path.rlike(r"/samples\.jsonl(/part-[^/]*)?$"))
    return rows.withColumn("run_dir", F.regexp_replace(path, r"/samples\.jsonl(/.*)?$", ""))


# The mock dataset's rows.
MOCK_ROWS = (("mock-0001", "안녕하세요 테스트입니다"), ("mock-0002", "오늘 날씨가 좋습니다"), ("mock-0003", "hello korean asr"))


def mock_rows(spark: SparkSession, rows=MOCK_ROWS, sample_rate: int = 16000, seconds: float = 1.0) -> DataFrame:
    """A dataset in memory: id, text, prediction (the text), and silence."""
    n = int(-(-sample_rate * seconds // 1))
    own = spark.createDataFrame([(a, b, b) for a, b in rows], "id string, text string, prediction string")
    silence = F.array_repeat(F.lit(0.0).cast("float"), n)
    return own.select(F.col("id").alias("sample_id"), "text", silence.alias("audio"), F.lit(sample_rate).alias("sample_rate"), F.create_map(F.lit("id"), "id", F.lit("prediction"), "prediction").alias("metadata"))
