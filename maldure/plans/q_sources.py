"""Sources, sinks, joins, jobs, inference and streams over the project's tables."""

from __future__ import annotations

import struct
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.operators import inference as I
from maldure.operators import jobs as J
from maldure.operators.aggregate import aggregate_samples
from maldure.operators.badrows import classify_records, csv_fields, held
from maldure.operators.error_analysis import error_blocks
from maldure.operators.leaderboard import ranked
from maldure.plans import q_metrics as M
from maldure.plans.q_badrows import CLASSIFIED
from maldure.plans.registry import query, rounded
from maldure.sources import audio, files, sinks
from maldure.streaming import rollup
from maldure.tables import ensure_checkpoint_dir, load


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/staged-{uuid4().hex}"


_MANIFEST_SQL = "SELECT nullif(audio_path, '') AS audio_path, coalesce(text, '') AS text, coalesce(id, nullif(audio_path, '')) AS sample_id, coalesce(nullif(sample_rate, 0), 16000) AS sample_rate, speaker FROM manifest_rows"
_MANIFEST = ("audio_path", "text", "id", "sample_rate", "speaker")


@query(_MANIFEST_SQL)
def scan_manifest_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded utterances, written as a JSON lines manifest and scanned."""
    folder = _folder(spark) + ".jsonl"
    load(spark, sf_dir, "manifest_rows").select(*_MANIFEST).write.json(folder)
    return files.read_manifest(spark, folder, "").drop("duration")


@query(_MANIFEST_SQL)
def scan_manifest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as CSV with a header and RFC 4180 quoting."""
    folder = _folder(spark) + ".csv"
    rows = load(spark, sf_dir, "manifest_rows").select(*_MANIFEST)
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return files.read_manifest(spark, folder, "").drop("duration")


_PATH = "coalesce(nullif(audio_path, ''), nullif(audio_filepath, ''), nullif(path, ''))"


@query(f"""{CLASSIFIED}
SELECT line_id, CASE WHEN {_PATH} LIKE '/%' THEN {_PATH} ELSE '/data/' || {_PATH} END AS audio_path, coalesce(nullif(text, ''), nullif(transcript, ''), nullif(sentence, ''), '') AS text FROM judged WHERE reason IS NULL
""")
def manifest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of manifest_lines that loads (p2_found has the others), under its own file's column names."""
    listed = load(spark, sf_dir, "manifest_files")
    rows = classify_records(load(spark, sf_dir, "manifest_lines").select("line_id", "file_name", "raw_line"), listed).where("reason IS NULL").select("line_id", "file_name", "raw_record")
    own = listed.select("file_name", "fmt", "header_columns").dropDuplicates(["file_name"])
    rows = rows.join(F.broadcast(own), "file_name", "left")
    is_csv = F.coalesce(F.col("fmt") == "csv", F.col("file_name").endswith(".csv"), F.lit(False))
    kinds = dict(x.split() for x in files.MANIFEST.split(", "))
    csv = held(rows.where(is_csv), named=F.map_from_arrays("header_columns", csv_fields(F.col("raw_record"))))
    csv = csv.select("line_id", *[F.try_element_at("named", F.lit(n)).alias(n) for n in kinds])
    jsonl = held(rows.where(~is_csv), named=F.from_json("raw_record", ", ".join(f"{n} string" for n in kinds)))
    jsonl = jsonl.select("line_id", *[F.col(f"named.{n}").alias(n) for n in kinds])
    typed = csv.unionByName(jsonl).select("line_id", *[F.trim(n).try_cast(k).alias(n) if k != "string" else n for n, k in kinds.items()])
    return files.with_aliases(typed, "/data", "line_id").select("line_id", "audio_path", "text")


@query()
def scan_trn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded utterances as a transcript list, parsed. The text is normalized, for which there is no SQL."""
    folder = _folder(spark)
    rows = load(spark, sf_dir, "manifest_rows").where("audio_path IS NOT NULL AND text IS NOT NULL AND NOT contains(text, '\n')")
    rows.select(F.concat("audio_path", F.lit(" :: "), "text")).write.text(folder)
    return files.parse_transcripts(spark.read.text(folder))


#: 24 bytes of every row, some of them above 127: a hash and half of it.
_BYTES = "SELECT row_id, md5(CAST(row_id AS VARCHAR)) || substr(md5(CAST(row_id AS VARCHAR)), 1, 16) AS h FROM sample_results"


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.md5(F.col("row_id").cast("string"))
    return load(spark, sf_dir, "sample_results").select("row_id", F.unhex(F.concat(own, F.substring(own, 1, 16))).alias("data"))


def _total(samples) -> F.Column:
    return F.round(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double")), 9).alias("total")


def _sample(i: int, width: int) -> str:
    """SQL: the i-th little-endian sample of ``width`` bytes, between -1 and 1; of one byte unsigned."""
    value = " + ".join(f"('0x' || substr(h, {2 * (i * width + k) + 1}, 2))::BIGINT * {256**k}" for k in range(width))
    if width == 1:
        return f"(({value}) - 128) / 128.0"
    half = 256**width // 2
    signed = f"(CASE WHEN {value} >= {half} THEN {value} - {2 * half} ELSE {value} END)"
    return f"{signed}::FLOAT::DOUBLE / {half}.0" if width == 4 else f"{signed} / {half}.0"


def _samples(width: int, n: int, channels: int = 1) -> str:
    return f"round(({' + '.join(_sample(i, width) for i in range(n))}) / {channels}.0::DOUBLE, 9)"


@query(f"SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 12 ELSE 11 END AS n, CASE WHEN row_id % 2 = 0 THEN {_samples(2, 12)} ELSE {_samples(2, 11)} END AS total FROM ({_BYTES})")
def pcm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 bytes of every row as samples; of odd rows 23, whose last byte is left out."""
    rows = _bytes(spark, sf_dir).withColumn("data", F.when(F.col("row_id") % 2 == 0, F.col("data")).otherwise(F.substring("data", 1, 23)))
    return rows.select("row_id", audio.pcm_decode("data").alias("s")).select("row_id", F.size("s").alias("n"), _total(F.col("s")))


#: Bytes a sample and channels.
_FORMATS = ((1, 1), (2, 1), (3, 1), (4, 1), (1, 2), (2, 2))


def _header(width: int, channels: int, rate: int = 8000, size: int = 24) -> str:
    """The header of a WAV file, in hexadecimal digits."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * width * channels, width * channels, 8 * width, b"data", size).hex()


_WAV_N = " ".join(f"WHEN {k} THEN {24 // (w * c)}" for k, (w, c) in enumerate(_FORMATS))
_WAV_TOTAL = " ".join(f"WHEN {k} THEN {_samples(w, 24 // w, c)}" for k, (w, c) in enumerate(_FORMATS))


@query(f"SELECT row_id, 8000 AS sample_rate, CASE row_id % 6 {_WAV_N} END AS n, CASE row_id % 6 {_WAV_TOTAL} END AS total FROM ({_BYTES})")
def wav_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bytes inside of WAV files of 8, 16, 24 and 32 bits, and of two channels."""
    headers = F.array(*[F.unhex(F.lit(_header(*x))) for x in _FORMATS])
    rows = _bytes(spark, sf_dir).select("row_id", audio.wav_decode(F.concat(headers[(F.col("row_id") % len(_FORMATS)).cast("int")], "data")).alias("w"))
    return rows.select("row_id", "w.sample_rate", F.size("w.samples").alias("n"), _total(F.col("w.samples")))


@query("""
WITH wave AS (SELECT row_id, CAST(row_id % 50 + 1 AS INT) AS len, CASE WHEN row_id % 3 = 0 THEN 8000 ELSE 16000 END AS rate, CASE WHEN row_id % 3 = 0 THEN 16000 ELSE 8000 END AS target FROM sample_results),
sized AS (SELECT row_id, len, CAST(greatest(1, round_even(len / rate::DOUBLE * target, 0)) AS INT) AS n FROM wave),
spots AS (SELECT row_id, len, unnest(generate_series(0, n - 1)) AS place, n FROM sized),
near AS (SELECT row_id, place, len, place * (len / n::DOUBLE) AS x FROM spots)
SELECT row_id, CAST(place AS INT) AS place,
  round(least(floor(x), len - 1) ^ 2 % 7 + (least(x, len - 1) - least(floor(x), len - 1)) * (least(floor(x) + 1, len - 1) ^ 2 % 7 - least(floor(x), len - 1) ^ 2 % 7), 4) AS value FROM near
""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of a wave of 1 to 50 samples per row, from 8 to 16 kHz and from 16 to 8 kHz."""
    wave = F.transform(F.sequence(F.lit(0), (F.col("row_id") % 50).cast("int")), lambda x: (x * x % 7).cast("float"))
    up = F.col("row_id") % 3 == 0
    rows = load(spark, sf_dir, "sample_results").select("row_id", audio.resample_linear(wave, F.when(up, 8000).otherwise(16000), F.when(up, 16000).otherwise(8000)).alias("s"))
    return rows.select("row_id", F.posexplode("s").alias("place", "v")).select("row_id", "place", F.round(F.col("v").cast("double"), 4).alias("value"))


@query("SELECT * FROM (VALUES ('mock-0001', '안녕하세요 테스트입니다', 16000, 16000), ('mock-0002', '오늘 날씨가 좋습니다', 16000, 16000), ('mock-0003', 'hello korean asr', 16000, 16000)) t(sample_id, text, n, sample_rate)")
def scan_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.mock_rows(spark).select("sample_id", "text", F.size("audio").alias("n"), "sample_rate")


@query("SELECT count(*) AS total_samples, 0::BIGINT AS outlier_count, 0.0::DOUBLE AS macro_wer, 0.0::DOUBLE AS macro_cer, 0.0::DOUBLE AS micro_cer, 0.0::DOUBLE AS macro_ser FROM range(3)")
def evaluate_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mock model on the mock dataset, evaluated and aggregated."""
    facts = I.evaluate_rows(I.transcribe(files.mock_rows(spark), "mock"), "strict").withColumn("run_id", F.lit("mock"))
    return aggregate_samples(facts, ["run_id"]).select("total_samples", "outlier_count", "macro_wer", "macro_cer", "micro_cer", "macro_ser")


_FIELDS = ", ".join(f"CASE WHEN isfinite(metrics.{m}) THEN metrics.{m} END AS {m}" for m in ("wer", "cer", "jer", "ser", "rtf"))


@query(f"SELECT sample_id, reference, prediction, {_FIELDS}, metrics.wer_hits AS wer_hits, CASE WHEN isfinite(processing_time) THEN processing_time END AS processing_time, is_outlier FROM sample_results")
def scan_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples written as a run's JSON lines (numbers that JSON lacks become null) and scanned."""
    folder = _folder(spark)
    rows = load(spark, sf_dir, "sample_results").withColumnRenamed("sample_index", "index").drop("row_id", "run_id", "finished_at", "ingested_at")
    sinks.json_safe(rows).write.json(folder)
    got = spark.read.schema(files.SAMPLE).json(folder)
    return got.select("sample_id", "reference", "prediction", *[F.col(f"metrics.{m}") for m in ("wer", "cer", "jer", "ser", "rtf", "wer_hits")], "processing_time", "is_outlier")


@query("SELECT entry_id, metrics.macro.cer AS cer, metrics.micro.wer AS micro_wer, outlier_policy.threshold AS threshold, is_full_evaluation, command FROM leaderboard_rows")
def scan_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All board rows as JSON, scanned under the board's schema."""
    folder = _folder(spark)
    sinks.json_safe(load(spark, sf_dir, "leaderboard_rows")).write.json(folder)
    got = spark.read.schema(files.BOARD_ROW + ", entry_id bigint").json(folder)
    return got.select("entry_id", F.col("metrics.macro.cer").alias("cer"), F.col("metrics.micro.wer").alias("micro_wer"), F.col("outlier_policy.threshold").alias("threshold"), "is_full_evaluation", "command")


_STEMS = "SELECT domain_id, label_id, label_name, regexp_replace(label_name, '\\.txt$', '') AS label_stem, regexp_replace(audio_name, '\\.wav$', '') AS audio_stem FROM telephone_labels"


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = lambda c, s: F.regexp_replace(c, rf"\.{s}$", "")
    return load(spark, sf_dir, "telephone_labels").select("domain_id", "label_id", "label_name", stem("label_name", "txt").alias("label_stem"), stem("audio_name", "wav").alias("audio_stem"))


@query(f"WITH s AS ({_STEMS}) SELECT l.domain_id, l.label_id FROM s l WHERE EXISTS (SELECT 1 FROM s a WHERE a.domain_id = l.domain_id AND a.audio_stem = l.label_stem)")
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that have audio of the same stem in their domain."""
    rows = _stems(spark, sf_dir)
    sound = rows.select("domain_id", F.col("audio_stem").alias("label_stem")).where("label_stem IS NOT NULL")
    return rows.join(sound, ["domain_id", "label_stem"], "left_semi").select("domain_id", "label_id")


@query(f"WITH s AS ({_STEMS}) SELECT l.domain_id, l.label_id FROM s l WHERE NOT EXISTS (SELECT 1 FROM s a WHERE a.domain_id = l.domain_id AND a.audio_stem = l.label_stem)")
def pair_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that lack audio."""
    rows = _stems(spark, sf_dir)
    sound = rows.select("domain_id", F.col("audio_stem").alias("label_stem")).where("label_stem IS NOT NULL")
    return rows.join(sound, ["domain_id", "label_stem"], "left_anti").select("domain_id", "label_id")


@query("SELECT label_id, label_zip, audio_zip, CAST(row_number() OVER (PARTITION BY domain_id, substr(label_name, 1, 7) ORDER BY label_name, label_id) - 1 AS INT) AS place FROM telephone_labels")
def zip_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's place among the labels of its archive's folder, by name."""
    rows = load(spark, sf_dir, "telephone_labels").select("label_id", "label_zip", "audio_zip", "label_name", "domain_id", F.substring("label_name", 1, 7).alias("folder"))
    placed = ranked(rows, [F.col("label_name").asc(), F.col("label_id").asc()], "place", ["domain_id", "folder"])
    return placed.select("label_id", "label_zip", "audio_zip", (F.col("place") - 1).cast("int").alias("place"))


@query("SELECT run_id, unnest(CASE WHEN lower(coalesce(dataset_subset, 'all')) IN ('all', 'validation', 'valid') THEN ['D01', 'D02', 'D03', 'D04'] ELSE [upper(dataset_subset)] END) AS domain FROM runs WHERE dataset_name = 'AIHubLowQualityTelephone'")
def domain_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domains that each run of the telephone dataset covers."""
    subset = F.lower(F.coalesce("dataset_subset", F.lit("all")))
    domains = F.when(subset.isin("all", "validation", "valid"), F.array(*[F.lit(d) for d in ("D01", "D02", "D03", "D04")])).otherwise(F.array(F.upper("dataset_subset")))
    return load(spark, sf_dir, "runs").where("dataset_name = 'AIHubLowQualityTelephone'").select("run_id", F.explode(domains).alias("domain"))


_JOBS = "SELECT m.model, d.dataset, d.subset FROM (SELECT DISTINCT model_name AS model FROM runs) m, (SELECT DISTINCT dataset_name AS dataset, dataset_subset AS subset FROM runs) d"


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = load(spark, sf_dir, "runs").select(F.col("model_name").alias("model"), F.col("dataset_name").alias("dataset"), F.col("dataset_subset").alias("subset"), "is_full_evaluation")
    return J.job_matrix(runs, runs), runs.where("is_full_evaluation")


@query(_JOBS)
def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir)[0]


@query(f"SELECT * FROM ({_JOBS}) j WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.is_full_evaluation AND r.model_name = j.model AND r.dataset_name = j.dataset AND r.dataset_subset IS NOT DISTINCT FROM j.subset)")
def jobs_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs without a full run."""
    return J.pending(*_jobs(spark, sf_dir))


@query("""
SELECT DISTINCT model_name AS model, dataset_name AS dataset, dataset_subset AS subset, CASE WHEN contains(lower(model_name), 'whisper') THEN 8 WHEN contains(lower(model_name), 'qwen3_asr') OR contains(lower(model_name), 'qwen3-asr') THEN 32 ELSE 1 END AS batch_size FROM runs
""")
def job_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch size of each job."""
    runs = load(spark, sf_dir, "runs").select(F.col("model_name").alias("model"), F.col("dataset_name").alias("dataset"), F.col("dataset_subset").alias("subset")).distinct()
    return J.with_commands(runs).drop("command")


@query("""
SELECT DISTINCT model_name AS model, dataset_name AS dataset, dataset_subset AS subset,
  'python -m maldure.cli evaluate --dataset_name ' || dataset_name || ' --dataset_rootpath ' || CASE dataset_name WHEN 'KsponSpeech' THEN '$KSPON_ROOT' WHEN 'AIHubLowQualityTelephone' THEN '$AIHUB_TELEPHONE_ROOT' ELSE '$DATASET_ROOT' END
  || coalesce(' --dataset_subset ' || dataset_subset, '') || ' --model_name ' || model_name || ' --batch_size '
  || CASE WHEN contains(lower(model_name), 'whisper') THEN '8' WHEN contains(lower(model_name), 'qwen3_asr') OR contains(lower(model_name), 'qwen3-asr') THEN '32' ELSE '1' END
  || ' --normalization_preset kspon --warmup_samples 1 --log_outliers' AS command
FROM runs
""")
def job_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line of each job; the command line's own parser takes it."""
    runs = load(spark, sf_dir, "runs").select(F.col("model_name").alias("model"), F.col("dataset_name").alias("dataset"), F.col("dataset_subset").alias("subset")).distinct()
    return J.with_commands(runs).drop("batch_size")


_RATES = ", ".join(f"CASE WHEN isfinite(metrics.{m}) THEN metrics.{m} END AS {m}" for m in sinks.CSV_METRICS)


_NULLED = ", ".join(f"nullif({c}, '') AS {c}" for c in ("sample_id", *sinks.TEXT_COLUMNS))


@query(f"SELECT sample_index AS index, {_NULLED}, is_outlier, {_RATES} FROM sample_results")
def write_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples written as predictions.csv and read again; an empty text and none are the same there."""
    folder = _folder(spark)
    rows = sinks.predictions(load(spark, sf_dir, "sample_results").withColumnRenamed("sample_index", "index"))
    rows.write.options(**sinks.CSV).csv(folder)
    return spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)


@query()
def error_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differing blocks of all samples. Longest-match comparison has no SQL; tested against plain Python."""
    rows = load(spark, sf_dir, "sample_results").where("normalized_reference IS NOT NULL AND normalized_prediction IS NOT NULL")
    return error_blocks(rows, "row_id", F.col("normalized_reference"), F.col("normalized_prediction"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "sample_results").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/sample_results[.]parquet")  # a glob, since the table may be one file or a folder


def _finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there; its last state, written to the shared folder."""
    out = _folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", out + "-state").trigger(availableNow=True)
    writer.foreachBatch(lambda df, batch: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"SELECT run_id, {M._COUNTS}, {M._MACRO}, {M._MICRO} FROM sample_results GROUP BY run_id")
def stream_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run aggregates as a stream makes them."""
    return rounded(_finished(spark, rollup.running_aggregates(_stream(spark, sf_dir)), "complete"))


@query("SELECT count(*) AS samples FROM (SELECT DISTINCT run_id, sample_index FROM sample_results)")
def stream_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples are left of a stream without its resends."""
    rows = _stream(spark, sf_dir).select("run_id", "sample_index", F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    return _finished(spark, rollup.without_resends(rows), "append").agg(F.count(F.lit(1)).alias("samples"))


@query("SELECT date_trunc('hour', finished_at)::TIMESTAMP AS starts, count(*) AS samples, count(*) FILTER (WHERE is_outlier) AS outliers FROM sample_results WHERE finished_at IS NOT NULL GROUP BY 1")
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and outliers per hour of finishing, as a stream makes them; nothing is late in one batch."""
    got = _finished(spark, rollup.arrivals(_stream(spark, sf_dir)), "complete")
    return got.select(F.col("starts").cast("timestamp_ntz").alias("starts"), "samples", "outliers")
