"""Models as Arrow-batched functions over rows, and the evaluation of a model on a dataset."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maldure.functions import metrics as M
from maldure.functions.text import normalize

#: name -> function that loads a model (once per worker) and returns its batch function: list of samples to list of texts.
MODELS: dict[str, Callable[[], Callable[[Sequence[dict]], Sequence[str]]]] = {}
#: name -> what is known of a model: its repository, and its size (flops, macs, params, total_parameters, trainable_parameters).
FACTS: dict[str, dict] = {}
SIZES = ("flops", "macs", "params", "total_parameters", "trainable_parameters")


def register_model(name: str, repo: str | None = None, **sizes):
    """Register a loader under a name, with its repository and what is known of its size (SIZES)."""
    if not name:
        raise ValueError("a model needs a name")
    if unknown := set(sizes) - set(SIZES):
        raise ValueError(f"not among {', '.join(SIZES)}: {', '.join(sorted(unknown))}")

    def add(loader):
        MODELS[name] = loader
        FACTS[name] = {"repo": repo, **dict.fromkeys(SIZES), **sizes}
        return loader

    return add


@register_model("mock")
def _mock():
    return lambda samples: [s["metadata"].get("prediction") or s["text"] for s in samples]


@register_model("mock_echo")
def _mock_echo():
    return lambda samples: [s["text"] for s in samples]


def mock_prediction(text: Column, metadata: Column, echo: bool = False) -> Column:
    """The mock model without Python: the prediction held in the metadata, else the text."""
    return text if echo else F.coalesce(F.nullif(F.try_element_at(metadata, F.lit("prediction")), F.lit("")), text)


def transcribe(rows: DataFrame, model: str, batch: int = 8, warmup: int = 0) -> DataFrame:
    """Rows with ``prediction`` and ``processing_time`` (a batch's seconds over its rows). The model is loaded once per task.

    Rows of a batch have one sample rate: a batch is split where the rate changes. warmup: so many of a task's first rows are
    transcribed once before, untimed. Columns besides: sample_id, text, sample_rate, metadata, n_samples, and place where rows have it.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; there are {', '.join(sorted(MODELS))}")
    load = MODELS[model]
    rows = rows if "place" in rows.columns else rows.withColumn("place", F.monotonically_increasing_id())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer, warm = load(), warmup > 0
        for frame in frames:
            texts, times = [], []
            samples = [{**r, "metadata": dict(r.get("metadata") or {})} for r in frame.to_dict("records")]
            if warm and samples:
                for s in samples[:warmup]:
                    infer([s])
                warm = False
            start = 0
            while start < len(samples):
                end = start + 1
                while end < min(start + batch, len(samples)) and samples[end].get("sample_rate") == samples[start].get("sample_rate"):
                    end += 1
                began = time.perf_counter()
                texts += infer(samples[start:end])
                times += [(time.perf_counter() - began) / max(1, end - start)] * (end - start)
                start = end
            yield pd.DataFrame({"place": frame["place"], "sample_id": frame["sample_id"], "text": frame["text"], "metadata": frame["metadata"], "n_samples": frame["audio"].map(len), "sample_rate": frame["sample_rate"], "prediction": texts, "processing_time": times})

    kind = rows.schema["place"].dataType.simpleString()
    return rows.mapInPandas(run, f"place {kind}, sample_id string, text string, metadata map<string, string>, n_samples int, sample_rate int, prediction string, processing_time double")


def evaluate_rows(rows: DataFrame, preset: str = "punctuation_agnostic", metric: str = "cer", threshold: float = 1.0, tokenizer: Callable[[str], Sequence[str]] | None = None) -> DataFrame:
    """Fact rows of transcribed rows: normalized texts, metrics, and the outlier flag. Morpheme rates need a tokenizer (text to tokens)."""
    own = rows.select(
        *[c for c in ("place", "metadata") if c in rows.columns], "sample_id", F.coalesce("text", F.lit("")).alias("reference"), F.coalesce("prediction", F.lit("")).alias("prediction"), "processing_time", "sample_rate",
        M.audio_duration(F.col("n_samples"), M.sample_rate(F.col("sample_rate"))).alias("audio_duration"),
    )
    own = own.withColumn("normalized_reference", normalize(F.col("reference"), preset)).withColumn("normalized_prediction", normalize(F.col("prediction"), preset))
    p, r = F.col("normalized_prediction"), F.col("normalized_reference")
    names = ("wer", "cer", "mer", "jer") if tokenizer else ("wer", "cer", "jer")
    own = own.withColumns({f"_{name}": M.measured(name, p, r, tokenizer) for name in names})
    kinds = ("hits", "substitutions", "deletions", "insertions")
    rate = {name: F.col(f"_{name}.rate") for name in names} | {"ser": M.ser(p, r)}
    edits = {f"{name}_{x}": F.col(f"_{name}.{x}").cast("long") for name in names for x in kinds}
    rates = [rate.get(name, F.lit(None).cast("double")).alias(name) for name in ("wer", "cer", "mer", "jer", "ser")]
    speed = [M.rtf(F.col("processing_time"), F.col("audio_duration")).alias("rtf"), F.col("processing_time").alias("latency")]
    every = [edits.get(f"{name}_{x}", F.lit(None).cast("long")).alias(f"{name}_{x}") for name in ("wer", "cer", "mer", "jer") for x in kinds]
    sentence = [(p != r).cast("long").alias("ser_error_sentences"), F.lit(1).cast("long").alias("ser_total_sentences")]
    own = own.withColumn("metrics", F.struct(*rates, *speed, *every, *sentence)).drop(*[f"_{name}" for name in names])
    return own.withColumn("is_outlier", M.is_outlier(F.col(f"metrics.{metric}"), threshold))
