import random

import pytest
from pyspark.sql import functions as F

from maldure.llm.survivor import MOST_FIELDS, best_representatives, real, spelled

SCHEMA = "k string, row long, trusted boolean, run string, a string, b string, c string, survivor string"
FIELDS = ["a", "b", "c"]


def represent(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r["k"]: r for r in best_representatives(df, ["k"], "row", F.col("trusted"), F.col("run"), FIELDS).collect()}


def plain(rows):
    """Every group by sorting it."""
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        own.sort(key=lambda r: r[3] or "", reverse=True)
        own.sort(key=lambda r: bool(r[2]), reverse=True)
        donors = {f: next((r[1] for r in own if r[4 + i] and r[4 + i].strip().lower() not in ("", "-", "n/a", "none")), None) for i, f in enumerate(FIELDS)}
        out[k] = (own[0][1], donors, len(own))
    return out


def test_equals_sorting(spark):
    random.seed(7)
    pick = lambda *x: random.choice(x)
    rows = [(pick("x", "y", "z", None), i, pick(True, False, None), pick("1", "2", "3", None), *(pick(None, "", " ", "N/A", "-", "v1", "v2") for _ in FIELDS)) for i in range(400)]
    rows += [("hot", 1000 + i, i % 3 == 0, str(i % 5), *(pick(None, "v", "none") for _ in FIELDS)) for i in range(1500)]
    got = represent(spark, rows)
    assert {k: (r["survivor"], {f: r[f]["donor"] for f in FIELDS}, r["rows"]) for k, r in got.items()} == plain(rows)
    assert all(r[f]["layer"] in (1, None) for r in got.values() for f in FIELDS)


def test_ties_and_single_rows(spark):
    got = represent(spark, [("t", 5, True, "r", "v", None, None), ("t", 3, True, "r", "v", None, None), ("s", 1, None, None, None, "", "-")])
    assert got["t"]["survivor"] == 3 and got["t"]["a"]["donor"] == 3 and got["t"]["skyline"] == 1 and got["t"]["b"]["value"] is None
    assert got["s"]["survivor"] == 1 and got["s"]["a"]["donor"] is None


def test_the_skyline_keeps_what_is_undominated(spark):
    got = represent(spark, [("g", 1, True, "1", "x", None, None), ("g", 2, False, "2", None, "y", None), ("g", 3, False, "1", "z", "w", None), ("g", 4, False, "0", None, None, None)])["g"]
    assert got["survivor"] == 1 and (got["a"]["donor"], got["b"]["donor"]) == (1, 2) and got["skyline"] == 3 and got["layers"] == 2


def by_count(rows):
    """Brute force: champions, layers by peeling, fills by layer."""
    out = {}
    full = lambda r: sum(bool(x) for x in r[4:])
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (bool(r[2]), r[3], -r[1]), reverse=True)
        champions = list({(r[2], tuple(map(bool, r[4:]))): r for r in reversed(own)}.values())
        champions.sort(key=own.index)
        left, layer, layers = list(champions), {}, 0
        while left:
            layers += 1
            top = [x for x in left if not any(y is not x and own.index(y) < own.index(x) and full(y) >= full(x) and y[3] >= x[3] and y[2] >= x[2] for y in left)]
            layer.update({x: layers for x in top})
            left = [x for x in left if x not in top]
        donors = {f: min(((layer[c], own.index(c), c[1]) for c in champions if c[4 + i]), default=(None, None, None)) for i, f in enumerate(FIELDS)}
        out[k] = (own[0][1], layers, {f: (d[2], d[0]) for f, d in donors.items()})
    return out


def test_later_layers_fill(spark):
    """By count, the second layer gives what the first lacks, and decides against the policy's order."""
    rows = [("g", 1, True, "2", "x", "y", None), ("g", 2, True, "1", None, None, "deep"), ("h", 3, True, "3", "x", "y", None), ("h", 4, True, "2", None, None, "poor"), ("h", 5, False, "4", "a", "b", "rich")]
    random.seed(9)
    rows += [(f"r{i % 20}", 10 + i, random.random() < 0.5, random.choice("123"), *(random.choice([None, "v", "w"]) for _ in FIELDS)) for i in range(300)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = {r["k"]: r for r in best_representatives(df, ["k"], "row", F.col("trusted"), F.col("run"), FIELDS, completeness="count").collect()}
    assert (got["g"]["c"]["value"], got["g"]["c"]["layer"], got["g"]["layers"]) == ("deep", 2, 2)
    assert (got["h"]["survivor"], got["h"]["c"]["value"], got["h"]["c"]["layer"]) == (3, "rich", 1)
    assert {k: (r["survivor"], r["layers"], {f: (r[f]["donor"], r[f]["layer"]) for f in FIELDS}) for k, r in got.items()} == by_count(rows)
    first = {r["k"]: r for r in best_representatives(df, ["k"], "row", F.col("trusted"), F.col("run"), FIELDS).collect()}
    assert first["h"]["c"]["value"] == "poor" and first["h"]["c"]["layer"] == 1


def test_more_fields_than_are_compared(spark):
    names = [f"f{i}" for i in range(MOST_FIELDS + 5)]
    random.seed(2)
    rows = [("g", i, i % 3 == 0, str(i % 4), *(random.choice([None, None, "v"]) for _ in names)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, row long, trusted boolean, run string, " + ", ".join(f"{n} string" for n in names))
    got = best_representatives(df, ["k"], "row", F.col("trusted"), F.col("run"), names).first()
    order = sorted(rows, key=lambda r: (r[2], r[3], -r[1]), reverse=True)
    assert got["survivor"] == order[0][1]
    assert all((got[n]["donor"], got[n]["layer"]) == next(((r[1], 1) for r in order if r[4 + i]), (None, None)) for i, n in enumerate(names))


def test_empty_and_wrong(spark):
    assert represent(spark, []) == {}
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        best_representatives(df, ["k"], "row", F.col("trusted"), F.col("run"), ["a"] * (MOST_FIELDS + 1), completeness="count")
    with pytest.raises(ValueError):
        best_representatives(df, ["k"], "row", F.col("trusted"), F.col("run"), [])


def test_names(spark):
    values = ["  Qwen3_Asr ", "qwen3-asr", "N/A", "", None, "unknown", "가-나", "x" * 5000]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", real(F.col("v")).alias("r"), spelled(F.col("v")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == ["qwen3asr", "qwen3asr", None, None, None, None, "가나", "x" * 5000]
    assert rows[0]["r"] == "  Qwen3_Asr " and rows[2]["r"] is None


def test_further_fields_of_any_type(spark):
    """Whole records: more fields than a mask holds, structs filled field by field, names as they are stored."""
    from maldure.llm.q_survivor import survivors

    kind = (
        "entry_id long, run_id string, model string, model_repo string, dataset string, subset string, gpu string, torch string, cuda string, metrics struct<macro: struct<wer: double, mer: double>, micro: struct<wer: double>>, "
        "total_samples long, is_full_evaluation boolean, command string, source string, artifact string, collected_at timestamp, tags map<string, string>"
    )
    none = dict.fromkeys(x.split()[0] for x in ("gpu", "torch", "cuda", "command", "source", "total_samples", "is_full_evaluation", "collected_at", "tags", "model_repo"))
    rows = [
        none | {"entry_id": 1, "run_id": "1", "model": "a/Conf_0.4b", "dataset": "D-1", "subset": None, "metrics": {"macro": {"wer": 0.1, "mer": 0.3}, "micro": {"wer": 0.2}}, "artifact": "x/leaderboard_row.json", "tags": {"a": "b"}, "total_samples": 0},
        none | {"entry_id": 2, "run_id": "2", "model": "conf 0 4B", "dataset": "d1", "subset": " n/a", "metrics": {"macro": {"wer": 0.9, "mer": float("nan")}, "micro": None}, "artifact": "results/y", "is_full_evaluation": False, "gpu": "-"},
        none | {"entry_id": 3, "run_id": "9", "model": "conf04b", "dataset": "d1", "subset": "default", "metrics": None, "artifact": None, "is_full_evaluation": True, "gpu": "G", "total_samples": 7},
        none | {"entry_id": 4, "run_id": "9", "model": "alone", "dataset": "d1", "subset": "x", "metrics": None, "artifact": None},
        *[none | {"entry_id": i, "run_id": "1", "model": "bare", "dataset": "d1", "subset": None, "metrics": None, "artifact": None} for i in (5, 6)],
    ]
    names = [x.name for x in spark.createDataFrame([], kind).schema]
    got = {r["entry_id"]: r.asDict(recursive=True) for r in survivors(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kind)).collect()}
    assert set(got) == {2, 5} and set(names) <= set(got[2])
    best = got[2]
    assert (best["model"], best["dataset"], best["subset"], best["artifact"], best["rows"]) == ("conf 0 4B", "d1", "default", "results/y", 3)
    assert best["metrics"] == {"macro": {"wer": 0.9, "mer": 0.3}, "micro": {"wer": 0.2}}
    assert (best["total_samples"], best["is_full_evaluation"], best["gpu"], best["tags"]) == (0, False, "G", {"a": "b"})
    assert best["filled_from"] == {"subset": 3, "metrics.macro.mer": 1, "metrics.micro.wer": 1, "gpu": 3, "tags": 1, "total_samples": 1}
    assert got[5]["metrics"] is None and got[5]["subset"] == "default" and got[5]["filled_from"] == {}
