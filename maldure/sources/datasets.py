"""Datasets by name: each gives the utterances that a model transcribes, in the source's order.

Columns: place (increasing in the source's order), sample_id, text, audio, sample_rate, metadata.
"""

from __future__ import annotations

from argparse import Namespace
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.sources import audio, files
from maldure.sources.zip_pairs import ZipPairs

RATE = 16000
DATASETS: dict[str, Callable[[SparkSession, Namespace], DataFrame]] = {}


def register_dataset(name: str):
    """Register what reads a dataset under its name. It is given the session and dataset_rootpath, dataset_subset and manifest_path."""

    def add(reader):
        DATASETS[name] = reader
        return reader

    return add


def load_dataset(spark: SparkSession, name: str, args: Namespace) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; there are {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, args)


def _needed(args: Namespace, option: str) -> str:
    value = getattr(args, option, None)
    if not value:
        raise ValueError(f"this dataset needs --{option}")
    return value


def _rows(rows: DataFrame, sample_id: Column, text: Column, samples: Column, rate: Column, metadata: dict[str, Column], place: Column | None = None) -> DataFrame:
    held = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))])
    silent = F.coalesce(samples, F.array().cast("array<float>"))  # of a row without audio
    return rows.select((F.monotonically_increasing_id() if place is None else place).alias("place"), sample_id.alias("sample_id"), text.alias("text"), silent.alias("audio"), rate.alias("sample_rate"), held.alias("metadata"))


@register_dataset("mock")
def mock(spark: SparkSession, args: Namespace) -> DataFrame:
    return files.mock_rows(spark).select(F.monotonically_increasing_id().alias("place"), "sample_id", "text", "audio", "sample_rate", "metadata")


@register_dataset("manifest")
def manifest(spark: SparkSession, args: Namespace) -> DataFrame:
    """A manifest's rows; a rate that the manifest gives stands for that of a raw file."""
    given = F.nullif("sample_rate", F.lit(0)).alias("given_rate")
    rows = files.read_manifest(spark, _needed(args, "manifest_path"), args.dataset_rootpath, given).withColumn("_read", audio.read_audio("audio_path"))
    rate = F.coalesce("given_rate", "_read.sample_rate", "sample_rate")
    return _rows(rows, F.col("sample_id"), F.col("text"), F.col("_read.samples"), rate, {"audio_path": F.col("audio_path"), "speaker": F.col("speaker")})


@register_dataset("KsponSpeech")
def transcripts(spark: SparkSession, args: Namespace) -> DataFrame:
    """A subset's transcript list with raw 16 kHz audio below the root."""
    root = _needed(args, "dataset_rootpath")
    rows = files.read_transcripts(spark, root, args.dataset_subset or "clean", root).withColumn("_read", audio.read_audio("audio_path"))
    return _rows(rows, F.col("audio_path"), F.col("text"), F.col("_read.samples"), F.lit(RATE), {"audio_path": F.col("audio_path")})


@register_dataset("AIHubLowQualityTelephone")
def telephone(spark: SparkSession, args: Namespace) -> DataFrame:
    """The label and audio archives of a domain, or of all; audio is brought to 16 kHz."""
    spark.dataSource.register(ZipPairs)
    reader = spark.read.format("zip_pairs").option("audio", "true")
    if args.dataset_subset:
        reader = reader.option("domains", args.dataset_subset)
    rows = reader.load(_needed(args, "dataset_rootpath")).withColumn("_read", audio.wav_decode("audio"))
    samples = audio.resample_linear("_read.samples", "_read.sample_rate", F.lit(RATE))
    held = {"domain": F.col("domain"), "label_name": F.col("label_name"), "audio_name": F.col("audio_name"), "original_sample_rate": F.col("_read.sample_rate")}
    return _rows(rows, F.col("id"), F.col("text"), samples, F.lit(RATE), held, F.struct("domain", "number"))
