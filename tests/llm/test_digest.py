import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maldure.llm import digest as D

SCHEMA = "g string, i long, x double, q string"


def exact(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    rows = D.certified_percentiles(df.drop("q"), ["g"], "x", **more).collect()
    assert len({(r["g"], r["q"]) for r in rows}) == len(rows)
    return {(r["g"], r["q"]): r for r in rows}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6) | st.integers(0, 5).map(float), min_size=1, max_size=200), min_size=1, max_size=6), st.sampled_from([0.0, 0.5, 0.9, 0.99, 1.0]))
def test_brackets_are_strict(parts, q):
    merged = D.merge([D.digest_of(np.array(p), 20) for p in parts], 20)
    values = np.sort(np.concatenate(parts))
    assert merged[1].sum() == len(values)
    position = int(np.floor(q * (len(values) - 1)))
    low, high = D.bracket(merged, position)
    assert low <= values[position] <= high


def test_clusters_are_small_at_the_ends():
    mean, weight, *_ = D.digest_of(np.random.default_rng(1).normal(size=100_000))
    assert len(mean) <= D.COMPRESSION + 2 and weight[0] < 20 and weight[-1] < 20 and weight.max() < 1000


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.lognormal(size=6000), "ties": np.repeat([1.0, 2.0], 500), "one": np.array([7.0]), None: rng.normal(size=50)}
    rows = [(g, k, float(x), "clash") for g, values in groups.items() for k, x in enumerate(values)]
    rows += [("hot", 10_000, float("nan"), ""), ("hot", 10_001, float("inf"), ""), ("hot", 10_002, None, ""), ("none", 1, None, "")]
    got = exact(spark, rows)
    assert {g for g, _ in got} == set(groups)
    for (g, q), r in got.items():
        assert np.isclose(r["exact"], np.quantile(groups[g], q), rtol=1e-12) and r["n"] == len(groups[g])
        assert r["rank_error"] <= 0.02 * r["n"] + 1


def test_low_compression_stays_exact(spark):
    values = np.random.default_rng(3).exponential(size=3000)
    got = exact(spark, [("a", k, float(x), "") for k, x in enumerate(values)], compression=10)
    assert all(np.isclose(r["exact"], np.quantile(values, q)) for (_, q), r in got.items())


def test_empty(spark):
    assert exact(spark, []) == {}


def test_a_hot_group_lies_in_many_tasks(spark):
    """Whatever the tasks hold of a group, it has one digest."""
    rng = np.random.default_rng(5)
    groups = {"hot": rng.lognormal(size=9000), "cold": rng.normal(size=90)}
    df = spark.createDataFrame([(g, k, float(x), "clash") for g, values in groups.items() for k, x in enumerate(values)], SCHEMA)
    for n, tasks in ((7, 7), (80, None), (1, 1)):
        rows = D.certified_percentiles(df.repartition(n, "i").drop("q"), ["g"], "x", tasks=tasks).collect()
        assert len(rows) == 8
        for r in rows:
            own = groups[r["g"]]
            assert r["n"] == len(own) and np.isclose(r["exact"], np.quantile(own, r["q"]), rtol=1e-12) and r["rank_error"] <= 0.02 * r["n"] + 1 and r["bracket_rows"] <= 0.03 * r["n"] + 4


def test_parts_follow_the_count(spark):
    df = spark.createDataFrame([("hot", i) for i in range(950)] + [("cold", i) for i in range(90)] + [(None, 1)], "g string, i long")
    rows, width = D.spread(df, ["g"], F.col("i"), 100)
    assert width == 10 and {r["g"]: (r["n"], r["parts"]) for r in rows.groupBy("g").agg(F.count("i").alias("n"), F.count_distinct("_part").alias("parts")).collect()} == {"hot": (950, 10), "cold": (90, 1), None: (1, 1)}
    assert D.spread(df, ["g"], F.col("i"), 1000)[1] == 1


def test_days_combine(spark):
    df = spark.range(0, 4000).select(F.lit("m").alias("m"), (F.col("id") % 7).alias("day"), F.col("id").cast("double").alias("x"))
    days = D.merge_digests(D.partial_digests(df.repartition(5), ["m", "day"], "x"), ["m", "day"])
    assert days.count() == 7
    known = D.brackets(D.merge_digests(days, ["m"]), ["m"])
    got = {r["q"]: r for r in D.certify(df, ["m"], "x", known).collect()}
    assert got[0.5]["n"] == 4000 and abs(got[0.5]["estimate"] - 1999.5) < 40 and got[0.99]["low"] <= 3959 <= got[0.99]["high"]
    assert all(abs(r["estimate"] - q * 3999) - 1 <= r["rank_error"] <= 40 for q, r in got.items())
