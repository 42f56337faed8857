from pyspark.sql import functions as F

from maldure.operators import aggregate as A
from maldure.operators import leaderboard as L
from maldure.sources.sinks import HEADINGS

EDITS = ", ".join(f"{m}_{x}: bigint" for m in ("wer", "cer", "mer", "jer") for x in ("hits", "substitutions", "deletions", "insertions"))
SAMPLES = f"run_id string, processing_time double, is_outlier boolean, metrics struct<wer: double, cer: double, mer: double, jer: double, ser: double, rtf: double, latency: double, {EDITS}, ser_error_sentences: bigint, ser_total_sentences: bigint>"
BOARD = "entry_id long, run_id string, model string, model_repo string, dataset string, subset string, artifact string, source string, gpu string, command string, total_samples long, evaluated_samples long, dataset_total_samples long, outlier_count long, is_full_evaluation boolean, outlier_policy struct<metric: string, threshold: double>, metrics struct<macro: struct<wer: double, cer: double, mer: double, jer: double, ser: double, rtf: double, latency: double>>"


def sample(run, time=1.0, out=False, cer=0.25, hits=3, sub=1):
    return {"run_id": run, "processing_time": time, "is_outlier": out, "metrics": {"cer": cer, "cer_hits": hits, "cer_substitutions": sub, "cer_deletions": 0, "cer_insertions": 0, "ser": 1.0, "ser_error_sentences": 1, "ser_total_sentences": 1}}


def board(entry, run, model, dataset="D", subset="s", cer=0.5, **more):
    macro = {"cer": cer}
    return {"entry_id": entry, "run_id": run, "model": model, "dataset": dataset, "subset": subset, "metrics": {"macro": macro}, "total_samples": 10, "evaluated_samples": 10, "outlier_count": 1, **more}


def test_aggregates(spark):
    rows = [sample("a", 1.0), sample("a", 2.0, cer=float("inf")), sample("a", 4.0, cer=float("nan")), sample("a", 99.0, out=True), sample("a", float("nan")), sample("a", None, out=None), sample("b", 3.0, out=True)]
    got = {r["run_id"]: r for r in A.aggregate_samples(spark.createDataFrame(rows, SAMPLES), ["run_id"]).collect()}
    a = got["a"]
    assert (a["total_samples"], a["valid_samples"], a["outlier_count"]) == (6, 5, 1)
    assert a["macro_cer"] == 0.25 and a["macro_wer"] is None and a["micro_cer"] == 0.25 and a["micro_wer"] is None and a["micro_ser"] == 1.0
    assert a["p50"] == 2.0 and abs(a["p90"] - 3.6) < 1e-12
    b = got["b"]
    assert b["valid_samples"] == 0 and b["macro_cer"] is None and b["micro_cer"] is None and b["p50"] is None


def test_domain_rollup(spark):
    runs = [{"run_id": f"r{d}", "model": "m", "model_repo": None, "subset": d, "gpu": d, "torch": None, "cuda": None, "dataset_total_samples": 1, "evaluated_samples": 1} for d in A.DOMAINS]
    runs += [{**runs[0], "run_id": "x", "model": "other"}]
    schema = "run_id string, model string, model_repo string, subset string, gpu string, torch string, cuda string, dataset_total_samples long, evaluated_samples long"
    samples = [sample(r["run_id"]) for r in runs]
    got = A.roll_up(spark.createDataFrame(runs, schema), spark.createDataFrame(samples, SAMPLES)).collect()
    assert len(got) == 1
    row = got[0]
    assert (row["model"], row["subset"], row["total_samples"], row["dataset_total_samples"], row["gpu"]) == ("m", "all", 4, 4, "D01")
    assert row["macro_cer"] == 0.25 and row["source_run_ids"] == ["rD01", "rD02", "rD03", "rD04"] and row["is_full_evaluation"]


def test_dedupe(spark):
    rows = [
        board(1, "run-1", "m", artifact="results/a/leaderboard_row.json"), board(2, "run-2", "m", artifact="x\\y\\leaderboard_row.json"), board(3, "run-9", "m", artifact="doc/rows.json"),
        board(4, "r", None), board(5, "r", None), board(6, "q", None), board(7, "run-2", "m", artifact="results/b"), board(8, "z", "m", subset=None),
    ]
    assert sorted(r[0] for r in L.dedupe(spark.createDataFrame(rows, BOARD)).select("entry_id").collect()) == [2, 4, 6, 8]
    assert L.dedupe(spark.createDataFrame([], BOARD)).count() == 0


def test_overall_board(spark):
    rows = [board(1, "a", "m", cer=0.2, subset="all"), board(2, "b", "m", cer=0.1, subset="all"), board(3, "c", "m", cer=None, subset=None), board(4, "d", "n", cer=0.1), board(5, "e", "n", cer=0.1), board(6, "f", "")]
    best = L.best_per_slice(spark.createDataFrame(rows, BOARD))
    assert sorted(r[0] for r in best.select("entry_id").collect()) == [2, 3, 4]
    got = {r["model"]: r for r in L.overall_board(spark.createDataFrame(rows, BOARD)).collect()}
    assert set(got) == {"m", "n"} and got["m"]["cer"] == 0.1 and got["m"]["slices"] == 2 and got["m"]["best_run_id"] == "b" and got["m"]["wer"] is None
    assert [tuple(x) for x in got["m"]["coverage"]] == [("D", "all"), ("D", "default")]


def test_ranks_are_dense_positions(spark):
    rows = spark.range(0, 1000).select(F.col("id").alias("entry_id"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("k")).repartition(7)
    got = L.ranked(rows, [F.col("k").asc(), F.col("entry_id").asc()]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(r["k"], r["entry_id"]) for r in got] == sorted((r["k"], r["entry_id"]) for r in got)


def test_summary_and_labels(spark):
    rows = spark.createDataFrame([board(1, "a", "m", cer=None), board(2, "b", "n", cer=0.3, subset=None)], BOARD)
    s = L.summary(rows).first()
    assert (s["rows"], s["models"], s["slices"], s["best_cer"], s["best_model"], s["best_label"]) == (2, 2, 2, 0.3, "n", "D")
    lines = [r["line"] for r in L.markdown_table(rows, tuple(HEADINGS)).orderBy("place").collect()]
    assert lines[0].startswith("| n | D |  |  | 0.3000 |") and "| 1 / 10 |" in lines[0] and len(lines) == 2


def test_default_subset_and_filter(spark):
    rows = spark.createDataFrame([board(1, "a", "Tiny", dataset="AIHubLowQualityTelephone", subset="all"), board(2, "b", "m", dataset="K", subset="all"), board(3, "c", "tiny", dataset="K", subset=None)], BOARD)
    assert {r["dataset"]: r["opens_on"] for r in L.default_subset(rows).collect()} == {"AIHubLowQualityTelephone": "all", "K": None}
    assert [r["entry_id"] for r in L.board_filter(rows, "K", "default", search="TINY").collect()] == [3]
