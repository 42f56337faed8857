"""Evaluation jobs: the matrix of models and slices, what is done, what is pending, and each job's command."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maldure.functions.text import ROOTS, model_family

# Batch sizes by model family.
BATCH = {"whisper": 8, "qwen3_asr": 32}
PROGRAM = "maldure.cli"


def job_matrix(models: DataFrame, slices: DataFrame) -> DataFrame:
    """Every model with every slice (columns model; dataset, subset). Both lists are made by hand, so every pair is wanted."""
    return models.select("model").distinct().join(slices.select("dataset", "subset").distinct())


def pending(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs without a run; a null subset equals a null subset."""
    same = (jobs["model"] == done["model"]) & (jobs["dataset"] == done["dataset"]) & jobs["subset"].eqNullSafe(done["subset"])
    return jobs.join(done.select("model", "dataset", "subset"), same, "left_anti")


def with_commands(jobs: DataFrame, program: str = PROGRAM, extra: Sequence[str] = ()) -> DataFrame:
    """Jobs with their batch size and command line."""
    batch, root = F.lit(1), F.lit("$DATASET_ROOT")
    for family, size in BATCH.items():
        batch = F.when(model_family(F.col("model")) == family, size).otherwise(batch)
    for name, place in ROOTS.items():
        root = F.when(F.col("dataset") == name, place).otherwise(root)
    parts = [F.lit(f"python -m {program} evaluate --dataset_name"), F.col("dataset"), F.lit("--dataset_rootpath"), root]
    parts += [F.when(F.col("subset").isNotNull(), F.concat(F.lit("--dataset_subset "), F.col("subset"))), F.lit("--model_name"), F.col("model")]
    parts += [F.concat(F.lit("--batch_size "), batch.cast("string")), F.lit("--normalization_preset kspon --warmup_samples 1 --log_outliers"), *map(F.lit, extra)]
    return jobs.withColumn("batch_size", batch).withColumn("command", F.concat_ws(" ", *parts))


def slug(name: str | None) -> str:
    """A name for a folder: runs of anything but letters, digits, dots, dashes and underscores as one dash."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", name or "").strip("-")


# The models and slices of a full evaluation.
MODELS = ("whisper_tiny", "whisper_base", "whisper_small", "whisper_medium", "qwen3_asr_0_6b", "qwen3_asr_1_7b")
SLICES = {"KsponSpeech": ("clean", "other"), "AIHubLowQualityTelephone": ("D01", "D02", "D03", "D04")}


def run_jobs(jobs: list[dict], run, done: set[tuple] = frozenset(), dry: bool = False, say=print) -> int:
    """Run each job's arguments (``arguments``) one after another; those in ``done`` (model, dataset, subset) are passed over.

    With ``dry`` they are only listed. Returns how many were run; a job that fails (its status isn't 0) is an error.
    """
    ran = 0
    say(f"{len(jobs)} jobs")
    for i, job in enumerate(jobs, 1):
        key = (job["model"], job["dataset"], job["subset"])
        if key in done:
            say(f"{i}/{len(jobs)} is done: {' '.join(map(str, key))}")
            continue
        say(f"{i}/{len(jobs)} {' '.join(job['arguments'])}")
        if not dry:
            if run(job["arguments"]):
                raise RuntimeError(f"job {i} failed: {' '.join(job['arguments'])}")
            ran += 1
    return ran
