"""Sinks: the files of a run, a board as JSON and Markdown, and the static page's data."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maldure.functions.text import characters, words
from maldure.operators.error_analysis import blocks
from maldure.operators.leaderboard import markdown_table, not_partial, sort_key

TEXT_COLUMNS = ("reference", "prediction", "normalized_reference", "normalized_prediction")
# The columns of predictions.csv, and those that are metrics.
CSV_COLUMNS = ("index", "sample_id", "reference", "prediction", "normalized_reference", "normalized_prediction", "is_outlier", "wer", "cer", "mer", "jer", "ser", "rtf", "latency")
CSV_METRICS = ("wer", "cer", "mer", "jer", "ser", "rtf", "latency")
ANALYSIS_METRICS = ("wer", "cer", "mer", "jer", "ser")
#: How it is written: quotes doubled, blanks kept, empty and missing texts both as nothing.
CSV = {"header": "true", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# A board's table.
HEADINGS = {
    "model": "Model", "dataset": "Dataset", "subset": "Subset", "wer": "WER", "cer": "CER", "mer": "MER", "jer": "JER", "ser": "SER",
    "rtf": "RTFx", "latency": "Latency(s)", "gpu": "GPU", "outliers": "Outliers", "run_id": "Run",
}
LEFT = ("model", "dataset", "subset", "gpu", "run_id")
NO_ROWS = "| _No runs yet_ |" + "  |" * (len(HEADINGS) - 1)


def json_safe(df: DataFrame) -> DataFrame:
    """Doubles that JSON has no form for as nulls, in structs, arrays and maps too."""

    def safe(column, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(column) & (F.abs(column) < F.lit(float("inf"))), column)
        if isinstance(kind, T.StructType):
            return F.when(column.isNotNull(), F.struct(*[safe(column[f.name], f.dataType).alias(f.name) for f in kind]))
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: safe(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(column, lambda _, x: safe(x, kind.valueType))
        return column

    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def predictions(samples: DataFrame) -> DataFrame:
    """The rows of predictions.csv; numbers that are not finite are empty."""
    return json_safe(samples.select(*[F.col(f"metrics.{c}") if c in CSV_METRICS else F.col(c) for c in CSV_COLUMNS]))


def error_analysis(samples: DataFrame) -> DataFrame:
    """The rows of error_analysis.jsonl: every sample's rates, and the blocks in which its words and characters differ."""
    reference, prediction = F.col("normalized_reference"), F.col("normalized_prediction")
    rates = F.struct(*[F.col(f"metrics.{m}").alias(m) for m in ANALYSIS_METRICS])
    return json_safe(samples.select("index", "sample_id", rates.alias("metrics"), blocks(words(reference), words(prediction)).alias("word_ops"), blocks(characters(reference), characters(prediction)).alias("char_ops")))


def write_samples(samples: DataFrame, folder: str, texts: bool = False) -> None:
    """``samples``, ``outliers`` and, with texts, ``predictions`` (CSV) and ``error_analysis`` of one or more runs, written by the executors."""
    own = json_safe(samples if texts else samples.drop(*TEXT_COLUMNS))
    own.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/samples.jsonl")
    own.where(F.coalesce("is_outlier", F.lit(False))).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/outliers.jsonl")
    if texts:
        predictions(samples).write.mode("overwrite").options(**CSV).csv(f"{folder}/predictions.csv")
        error_analysis(samples).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/error_analysis.jsonl")


def _path(spark: SparkSession, path: str):
    """A path and its file system, by Hadoop: what the driver writes is where the workers' files are."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    own, system = _path(spark, path)
    return system.exists(own)


def remove(spark: SparkSession, path: str) -> None:
    own, system = _path(spark, path)
    system.delete(own, True)


def read_text(spark: SparkSession, path: str) -> str:
    own, system = _path(spark, path)
    stream = system.open(own)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written by the driver to wherever Spark's own files go."""
    own, system = _path(spark, path)
    stream = system.create(own, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON text, nulls too. Column: value."""
    return json_safe(rows).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_run(row: DataFrame, samples: DataFrame, folder: str, texts: bool = False, summary: dict | None = None) -> None:
    """A run's folder: its board row, summary, samples and outliers. ``row`` has one row. summary: what its file says; else the row."""
    spark = row.sparkSession
    board = json.loads(as_json(row).first()[0])
    write_json(spark, f"{folder}/leaderboard_row.json", board)
    write_json(spark, f"{folder}/summary.json", {"leaderboard_row": board} if summary is None else summary)
    write_samples(samples, folder, texts)


def write_board(rows: DataFrame, folder: str) -> None:
    """A board as ``leaderboard.json`` and ``leaderboard.md``, in order of error rate. A board is small: it is shown on one page."""
    spark = rows.sparkSession
    ordered = rows.orderBy(sort_key("cer"), "entry_id")
    write_json(spark, f"{folder}/leaderboard.json", [json.loads(r[0]) for r in as_json(ordered).toLocalIterator()])
    lines = [r["line"] for r in markdown_table(rows, tuple(HEADINGS)).orderBy("place").toLocalIterator()] or [NO_ROWS]
    head = ["| " + " | ".join(HEADINGS.values()) + " |", "| " + " | ".join(":--" if c in LEFT else "--:" for c in HEADINGS) + " |"]
    write_text(spark, f"{folder}/leaderboard.md", "\n".join(["# Leaderboard", "", "Full evaluation runs only.", "", *head, *lines]) + "\n")


def write_page_data(rows: DataFrame, folder: str) -> dict:
    """The board's data and its metadata for a static page."""
    write_board(rows, folder)
    counts = rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(not_partial()).alias("full_run_count")).first().asDict()
    held = {"built_at": datetime.now(timezone.utc).isoformat(), **counts}
    write_json(rows.sparkSession, f"{folder}/metadata.json", held)
    write_text(rows.sparkSession, f"{folder}/.nojekyll", "")
    return held
