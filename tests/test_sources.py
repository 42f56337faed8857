import io
import json
import struct
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from maldure.operators import inference as I
from maldure.operators import jobs as J
from maldure.operators.aggregate import aggregate_samples
from maldure.operators.error_analysis import difference, error_blocks
from maldure.sources import audio, files, sinks
from maldure.sources.zip_pairs import ZipPairs, domain_ids
from maldure.streaming import rollup
from test_aggregate import BOARD, SAMPLES, board, sample


def wav(width, channels, frames, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(width)
        file.setframerate(rate)
        file.writeframes(frames)
    return out.getvalue()


def test_wav_widths():
    for width, frames, want in ((1, bytes([0, 128, 255]), [-1, 0, 127 / 128]), (2, struct.pack("<3h", -32768, 0, 16384), [-1, 0, 0.5]), (3, b"\x00\x00\x80\x00\x00\x00\x00\x00\x40", [-1, 0, 0.5]), (4, struct.pack("<3i", -(2**31), 0, 2**30), [-1, 0, 0.5])):
        samples, rate = audio.wav_samples(wav(width, 1, frames))
        assert rate == 8000 and np.allclose(samples, want)
    samples, _ = audio.wav_samples(wav(2, 2, struct.pack("<4h", 16384, 0, -16384, -16384)))
    assert np.allclose(samples, [0.25, -0.5])
    assert audio.wav_samples(b"no wav") is None and audio.wav_samples(b"") is None


def test_pcm_and_resampling(spark):
    assert np.allclose(audio.pcm_samples(struct.pack("<2h", -32768, 16384) + b"x"), [-1, 0.5])
    assert len(audio.resampled(np.zeros(3, "float32"), 8000, 16000)) == 6 and len(audio.resampled(np.zeros(1, "float32"), 16000, 1)) == 1
    rows = spark.createDataFrame([(bytearray(wav(2, 1, b"\0\0" * 80)),), (bytearray(b"x"),), (None,)], "b binary")
    got = rows.select(audio.wav_decode("b").alias("w")).select("w.sample_rate", F.size("w.samples").alias("n"), audio.resample_linear(F.col("w.samples"), F.col("w.sample_rate"), F.lit(16000)).alias("s")).collect()
    assert [(r["sample_rate"], r["n"], r["s"] and len(r["s"])) for r in got] == [(8000, 80, 160), (None, None, None), (None, None, None)]


def test_manifests(spark, tmp_path):
    rows = [{"audio_filepath": "a.wav", "transcript": "하나\n둘", "id": "1"}, {"audio_path": "", "path": "/x/b.wav", "sentence": 'say "x", y', "sample_rate": 0, "extra": [1]}]
    (tmp_path / "m.jsonl").write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    (tmp_path / "m.csv").write_text('path,text,id,sample_rate\na.wav,"하나\n둘",1,\n/x/b.wav,"say ""x"", y",,0\n', encoding="utf-8")
    want = [(f"{tmp_path}/a.wav", "하나\n둘", "1", 16000), ("/x/b.wav", 'say "x", y', "/x/b.wav", 16000)]
    for name in ("m.jsonl", "m.csv"):
        got = files.read_manifest(spark, str(tmp_path / name)).select("audio_path", "text", "sample_id", "sample_rate").collect()
        assert sorted(map(tuple, got)) == sorted(want, key=lambda x: x[0])
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "m.txt"))


def test_transcripts(spark, tmp_path):
    (tmp_path / "eval_clean.trn").write_text("d/a.pcm :: b/ 안녕 1번 :: more\nno separator\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_transcripts(spark, str(tmp_path), "clean", "/root").collect()] == [("/root/d/a.pcm", "안녕 일번")]


def zips(folder, stem_of_audio):
    with zipfile.ZipFile(folder / "VL_D03.zip", "w") as labels, zipfile.ZipFile(folder / "VS_D03.zip", "w") as sounds:
        labels.writestr("D03/J13/S000001/0001.txt", "o/ 여보세요. ")
        labels.writestr("D03/readme.md", "")
        sounds.writestr(f"D03/J13/S000001/{stem_of_audio}.wav", wav(2, 1, b"\0\0" * 160))


def test_zip_pairs(spark, tmp_path):
    zips(tmp_path, "0001")
    spark.dataSource.register(ZipPairs)
    rows = spark.read.format("zip_pairs").option("domains", "d03").option("audio", "true").load(str(tmp_path))
    got = rows.select("id", "text", F.size(audio.wav_decode("audio")["samples"]).alias("n")).collect()
    assert [tuple(r) for r in got] == [("D03/J13/S000001/0001", "o/ 여보세요.", 160)]
    zips(tmp_path, "0002")
    with pytest.raises(Exception, match="have no audio"):
        spark.read.format("zip_pairs").option("domains", "D03").load(str(tmp_path)).collect()
    assert domain_ids("Validation") == domain_ids(None) == ["D01", "D02", "D03", "D04"] and domain_ids("d02") == ["D02"]


def test_run_artifacts(spark, tmp_path):
    for name, text in (("a/leaderboard_row.json", json.dumps({"run_id": "a", "metrics": {"macro": {"cer": 0.5}}}, indent=1)), ("b/c/leaderboard_row.json", "{broken"), ("a/other.json", "{}")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.read_board_rows(spark, str(tmp_path), tolerant=True).select("run_id", "metrics.macro.cer", "artifact").collect()
    assert len(got) == 1 and got[0][:2] == ("a", 0.5) and got[0]["artifact"].endswith("a/leaderboard_row.json")
    with pytest.raises(Exception):
        files.read_board_rows(spark, str(tmp_path)).collect()


def test_curated_rows(spark, tmp_path):
    path = tmp_path / "rows.json"
    assert files.read_curated(spark, str(path)).count() == 0
    path.write_text(json.dumps([{"run_id": "x", "model": "m"}]))
    assert files.read_curated(spark, str(path)).first()["model"] == "m"
    for wrong in ({}, [1]):
        path.write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            files.read_curated(spark, str(path))


def test_mock_evaluation_and_run_folder(spark, tmp_path):
    facts = I.evaluate_rows(I.transcribe(files.mock_rows(spark), "mock", batch=2), "strict").withColumn("run_id", F.lit("r")).cache()
    row = aggregate_samples(facts, ["run_id"])
    got = row.first()
    assert (got["total_samples"], got["outlier_count"], got["macro_cer"], got["micro_wer"]) == (3, 0, 0.0, 0.0)
    samples = facts.withColumn("index", F.pmod(F.xxhash64("sample_id"), F.lit(1000)).cast("int"))
    sinks.write_run(row, samples, str(tmp_path / "run"), texts=True)
    again = files.read_samples(spark, str(tmp_path / "run"))
    assert again.count() == 3 and again.agg(F.max("metrics.cer")).first()[0] == 0.0 and again.first()["run_dir"].endswith("/run")
    (tmp_path / "old").mkdir()
    (tmp_path / "old/samples.jsonl").write_text('{"index": 1, "sample_id": "x"}\n')
    assert files.read_samples(spark, str(tmp_path)).count() == 4
    assert json.loads((tmp_path / "run/summary.json").read_text())["leaderboard_row"]["run_id"] == "r"
    header = "index,sample_id,reference,prediction,normalized_reference,normalized_prediction,is_outlier,wer,cer,mer,jer,ser,rtf,latency".split(",")
    assert spark.read.option("header", True).csv(str(tmp_path / "run/predictions.csv")).columns == header
    analysis = [json.loads(x) for p in (tmp_path / "run/error_analysis.jsonl").glob("part-*") for x in p.read_text().splitlines()]
    assert len(analysis) == 3 and all(set(a) == {"index", "sample_id", "metrics", "word_ops", "char_ops"} and a["word_ops"] == [] and set(a["metrics"]) == {"wer", "cer", "mer", "jer", "ser"} for a in analysis)
    with pytest.raises(ValueError):
        I.transcribe(files.mock_rows(spark), "no such model")


def test_mixed_rates_split_batches(spark):
    seen = I.transcribe(files.mock_rows(spark).withColumn("sample_rate", F.when(F.col("sample_id") == "mock-0002", 8000).otherwise(16000)), "mock_echo", batch=8)
    assert [r["prediction"] for r in seen.orderBy("sample_id").collect()] == [t for _, t in files.MOCK_ROWS]


def test_page(spark, tmp_path):
    rows = spark.createDataFrame([board(1, "a", "m", cer=0.4, is_full_evaluation=False), board(2, "b", "n", cer=0.2)], BOARD)
    held = sinks.write_page_data(rows, str(tmp_path))
    assert (held["row_count"], held["full_run_count"]) == (2, 1)
    assert [r["run_id"] for r in json.loads((tmp_path / "leaderboard.json").read_text())] == ["b", "a"]
    lines = (tmp_path / "leaderboard.md").read_text().splitlines()
    assert lines[4] == "| Model | Dataset | Subset | WER | CER | MER | JER | SER | RTFx | Latency(s) | GPU | Outliers | Run |"
    assert lines[5] == "| :-- | :-- | :-- | --: | --: | --: | --: | --: | --: | --: | :-- | --: | :-- |" and len(lines) == 8 and "0.2000" in lines[6]
    sinks.write_board(rows.limit(0), str(tmp_path / "none"))
    assert (tmp_path / "none/leaderboard.md").read_text().splitlines()[-1] == "| _No runs yet_ |  |  |  |  |  |  |  |  |  |  |  |  |"


def test_json_has_no_infinite_numbers(spark):
    rows = spark.createDataFrame([(float("inf"), (float("nan"), 1.0))], "a double, b struct<c: double, d: double>")
    assert sinks.json_safe(rows).toJSON().first() == '{"b":{"d":1.0}}'


def test_jobs(spark):
    models = spark.createDataFrame([("qwen3_asr_0_6b",), ("whisper_tiny",)], "model string")
    slices = spark.createDataFrame([("AIHubLowQualityTelephone", "D01"), ("X", None)], "dataset string, subset string")
    done = spark.createDataFrame([("whisper_tiny", "X", None)], "model string, dataset string, subset string")
    left = J.with_commands(J.pending(J.job_matrix(models, slices), done)).orderBy("model", "dataset").collect()
    assert len(left) == 3 and left[0]["batch_size"] == 32
    assert "--dataset_rootpath $AIHUB_TELEPHONE_ROOT --dataset_subset D01" in left[0]["command"] and "--log_outliers" in left[0]["command"] and "--dataset_subset" not in left[1]["command"]


def test_every_command_is_understood(spark, tmp_path):
    """The commands of all jobs, by the command line's own parser."""
    import shlex

    from maldure.cli import parser

    models = spark.createDataFrame([("qwen3_asr_0_6b",), ("whisper_tiny",)], "model string")
    slices = spark.createDataFrame([("AIHubLowQualityTelephone", "D01"), ("X", None)], "dataset string, subset string")
    for r in J.with_commands(J.job_matrix(models, slices)).collect():
        words = shlex.split(r["command"])
        assert words[:3] == ["python", "-m", "maldure.cli"]
        args = parser().parse_args(words[3:])
        assert (args.model_name, args.dataset_name, args.dataset_subset, args.batch_size, args.warmup_samples, args.log_outliers) == (r["model"], r["dataset"], r["subset"], r["batch_size"], 1, True)


def test_running_jobs():
    listed = [{"model": m, "dataset": "d", "subset": "s", "arguments": ["evaluate", m]} for m in "abc"]
    ran, said = [], []
    assert J.run_jobs(listed, lambda x: ran.append(x), {("b", "d", "s")}, say=said.append) == 2 and ran == [["evaluate", "a"], ["evaluate", "c"]]
    assert said[0] == "3 jobs" and "done" in said[2] and J.run_jobs(listed, ran.append, dry=True, say=said.append) == 0 and len(ran) == 2
    with pytest.raises(RuntimeError, match="job 1"):
        J.run_jobs(listed, lambda x: 1, say=said.append)


def test_zip_pairs_are_split(spark, tmp_path):
    import zipfile

    from maldure.sources.zip_pairs import ZipPairs

    for domain, n in (("D01", 7), ("D02", 0)):
        with zipfile.ZipFile(tmp_path / f"VL_{domain}.zip", "w") as labels, zipfile.ZipFile(tmp_path / f"VS_{domain}.zip", "w") as sounds:
            for i in range(n):
                labels.writestr(f"{domain}/{i:04}.txt", f"text {i}")
                sounds.writestr(f"{domain}/{i:04}.wav", b"RIFF")
    spark.dataSource.register(ZipPairs)
    one = spark.read.format("zip_pairs").option("domains", "D01").option("members", "3").load(str(tmp_path))
    assert one.rdd.getNumPartitions() == 3
    assert [(r["number"], r["id"], r["text"], r["audio"]) for r in one.orderBy("number").collect()] == [(i, f"D01/{i:04}", f"text {i}", None) for i in range(7)]
    assert spark.read.format("zip_pairs").option("domains", "D02").load(str(tmp_path)).count() == 0


def test_matches_with_their_places(spark):
    from maldure.operators.quality import find_texts

    text = "x /mnt/c/ and /mnt/c/ ghp_" + "a" * 24
    got = find_texts(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "k int, t string"), ["k"], "t").collect()
    assert sorted((r["k"], r["rule"], r["start"], r["match"]) for r in got) == [(1, "github", 22, "ghp_" + "a" * 24), (1, "mount", 2, "/mnt/c/"), (1, "mount", 14, "/mnt/c/")]


def test_error_blocks(spark):
    pairs = [("a b c", "a x c d"), ("", "x"), ("same", "same"), ("x " * 250, "y x " * 250)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, p string")
    got = error_blocks(rows, "i", F.col("r"), F.col("p")).collect()
    for i, (r, p) in enumerate(pairs):
        for level, a, b in (("word", r.split(), p.split()), ("char", list(r), list(p))):
            own = [(x["operation"], x["reference"], x["prediction"]) for x in sorted(got, key=lambda x: x["place"]) if x["i"] == i and x["level"] == level]
            assert own == difference(a, b)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([sample("a"), sample("a", out=True), sample("b")], SAMPLES).withColumn("sample_index", F.lit(0)).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = rollup.running_aggregates(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["run_id"]: (r["total_samples"], r["outlier_count"]) for r in spark.table("running").collect()} == {"a": (2, 1), "b": (1, 0)}
    q = rollup.without_resends(stream).select("run_id").writeStream.format("memory").queryName("single").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.table("single").collect()) == ["a", "b"]


def test_resampling_keeps_the_times():
    """Both signals begin at the same time and end before the same time; one sample and none stay what they are."""
    import numpy as np

    from maldure.sources.audio import resampled

    assert resampled(np.array([0, 1, 2, 3], "float32"), 8000, 16000).tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3]
    assert resampled(np.arange(6, dtype="float32"), 16000, 8000).tolist() == [0, 2, 4]
    assert resampled(np.array([5], "float32"), 8000, 16000).tolist() == [5, 5] and resampled(np.array([5], "float32"), 16000, 8000).tolist() == [5]
    assert resampled(np.array([], "float32"), 8000, 16000).tolist() == [] and resampled(np.arange(3, dtype="float32"), 16000, 8000).tolist() == [0, 1.5]


def test_aliases_of_every_record(spark, tmp_path):
    """Records of CSV and JSON lines under alias columns, against the csv and json modules; those that fail aren't there."""
    import csv
    import json

    from maldure.plans.registry import QUERIES

    listed = [("a.csv", "csv", ["id", "transcript", "path", "audio_path"], 4, None), ("b.csv", "csv", ["audio_filepath", "sentence"], 2, 8000), ("c.jsonl", "jsonl", None, None, None)]
    lines = [
        ("a.csv", 'u1,"a ""b"", c",x.wav,'), ("a.csv", "u2,,/abs/y.flac,z.pcm\r"), ("a.csv", "u3,t,x.mp3,"), ("a.csv", "u4,t"), ("b.csv", "d e.WAV,'둘'"), ("b.csv", '"q.wav","two\nlines"'),
        ("c.jsonl", '{"path": "p.wav", "audio_path": "", "text": "", "transcript": "\\ud558\\ub098", "sample_rate": "8000", "duration": 1.5}'), ("c.jsonl", '{"audio_filepath": "k.pcm", "sentence": null}'), ("c.jsonl", "{"), ("c.jsonl", " "),
    ]
    spark.createDataFrame(listed, "file_name string, fmt string, header_columns array<string>, n_columns int, default_sample_rate int").write.parquet(str(tmp_path / "manifest_files.parquet"))
    spark.createDataFrame([(i, f, r) for i, (f, r) in enumerate(lines)], "line_id long, file_name string, raw_line string").write.parquet(str(tmp_path / "manifest_lines.parquet"))
    got = {r["line_id"]: (r["audio_path"], r["text"]) for r in QUERIES["manifest_alias"](spark, str(tmp_path)).collect()}
    headers = {f: h for f, _, h, *_ in listed}
    want = {}
    for i in (0, 1, 4, 5, 6, 7):
        name, raw = lines[i]
        row = json.loads(raw) if headers[name] is None else dict(zip(headers[name], next(csv.reader([raw.removesuffix("\r")] if "\n" not in raw else raw.splitlines(True)))))
        path = next(row[n] for n in ("audio_path", "audio_filepath", "path") if row.get(n))
        want[i] = (path if path.startswith("/") else f"/data/{path}", next((row[n] for n in ("text", "transcript", "sentence") if row.get(n)), ""))
    assert got == want
