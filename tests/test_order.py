import random

from pyspark.sql import functions as F

from maldure.operators.aggregate import exact_percentiles
from maldure.operators.order import ranked, running_totals


def test_a_hot_group_spreads(spark):
    df = spark.range(0, 20_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 20_000).alias("v"), F.lit(2).alias("n"))
    got = running_totals(df, ["g"], ["v"], "n").select("v", "_upto", "_total").collect()
    assert all(r["_upto"] == 2 * (r["v"] + 1) and r["_total"] == 40_000 for r in got) and len(got) == 20_000


def test_equals_plain(spark):
    random.seed(4)
    rows = [(random.choice(["a", "b", None]), i, random.randint(1, 5), "clash") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, n long, x string")
    got = {r["v"]: (r["_upto"], r["_total"], r["x"]) for r in running_totals(df, ["g"], ["v"], "n").collect()}
    for g, v, _, _ in rows:
        own = [r for r in rows if r[0] == g]
        assert got[v] == (sum(r[2] for r in own if r[1] <= v), sum(r[2] for r in own), "clash")
    places = {r["v"]: r["rank"] for r in ranked(df, [F.col("v").desc()], within=["g"]).collect()}
    assert all(places[v] == sum(1 for r in rows if r[0] == g and r[1] >= v) for g, v, _, _ in rows)
    assert running_totals(df.limit(0), ["g"], ["v"], "n").count() == 0 == ranked(df.limit(0), [F.col("v")]).count()


def test_percentiles_of_one_run(spark):
    import numpy as np

    values = np.random.default_rng(8).exponential(size=30_000)
    df = spark.createDataFrame([("one", float(x), False) for x in values] + [("one", float("nan"), False), ("one", 9e9, True), (None, 1.0, None)], "run_id string, processing_time double, is_outlier boolean").repartition(6)
    got = {r["run_id"]: r for r in exact_percentiles(df, ["run_id"]).collect()}
    assert np.allclose([got["one"][f"p{p}"] for p in (50, 90, 95, 99)], np.percentile(values, [50, 90, 95, 99])) and got[None]["p99"] == 1.0
