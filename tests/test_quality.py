import json

from maldure.operators import quality as Q
from test_aggregate import BOARD, board

GOOD = {"run_id": "r", "model": "m", "model_repo": "o/m", "dataset": "d", "metrics": {"macro": {"wer": 0.1, "cer": 0.1, "mer": 0.1, "jer": 0}}, "total_samples": 3, "dataset_total_samples": 3, "evaluated_samples": 3, "is_full_evaluation": True, "outlier_count": 0, "outlier_policy": {"metric": "cer", "threshold": 1.0}}


def found(spark, *rows):
    raw = [x if isinstance(x, str) or x is None else json.dumps(x) for x in rows]
    got = Q.validate_json(spark.createDataFrame(list(enumerate(raw)), "i int, raw string"), "i", "raw").collect()
    return [sorted(r["problem"] for r in got if r["i"] == i) for i in range(len(rows))]


def test_json_rows(spark):
    without = {k: v for k, v in GOOD.items() if k != "model_repo"}
    metric = json.loads(json.dumps(GOOD))
    del metric["metrics"]["macro"]["cer"]
    odd = {**GOOD, "metrics": {"macro": {**GOOD["metrics"]["macro"], "ser": "x", "wer": True}}}
    got = found(spark, GOOD, without, {**GOOD, "is_full_evaluation": False, "command": "python /mnt/d/x"}, metric, odd, "{", "[1]", None, {**GOOD, "evaluated_samples": "3", "model": "mock"}, {**GOOD, "evaluated_samples": 2}, {**GOOD, "metrics": 1, "outlier_policy": {"metric": "cer"}})
    assert got[0] == []
    assert got[1] == ["missing.model_repo"]
    assert got[2] == ["command.mount", "is_full_evaluation"]
    assert got[3] == ["metrics.macro.cer"]
    assert got[4] == ["metrics.macro.ser", "metrics.macro.wer"]
    assert got[5] == ["invalid_json"] and got[6] == ["not_an_object"] and got[7] == ["invalid_json"]
    assert got[8] == ["evaluated_samples", "mock"]
    assert got[9] == ["evaluated_differs"]
    assert got[10] == ["metrics", "metrics.macro", "metrics.macro.cer", "metrics.macro.jer", "metrics.macro.mer", "metrics.macro.wer", "outlier_policy"]


def test_typed_rows(spark):
    rows = spark.createDataFrame([board(1, "r", "mock", total_samples=0)], BOARD)
    got = sorted(r["problem"] for r in Q.validate_rows(rows.withColumn("total_samples", rows["total_samples"] * 0)).collect())
    assert got == ["dataset_total_samples", "is_full_evaluation", "metrics.macro.jer", "metrics.macro.mer", "metrics.macro.wer", "mock", "outlier_policy", "total_samples"]


def test_scan(spark):
    texts = ["x AKIA" + "A" * 16 + " and ghp_" + "b" * 20, "password = 'longenough' C:\\Users\\me", None, "", "no", "hf_" + "c" * 19]
    got = Q.scan_texts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i", "text").collect()
    assert sorted((r["i"], r["rule"], r["hits"]) for r in got) == [(0, "aws", 1), (0, "github", 1), (1, "assigned", 1), (1, "windows_home", 1)]
