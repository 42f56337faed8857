import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from maldure.llm import packing as P

SCHEMA = "doc long, n int, size string, container string"


def contents(plan, histogram):
    held, seen = defaultdict(int), defaultdict(list)
    for size, start, end, first, each in plan.places:
        seen[size].append((start, end))
        for k in range(start, end):
            held[first + (k - start) // each] += size
    for size, n in histogram.items():
        own = sorted(seen[size])
        assert n == 0 or (own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:])))
    return held


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(0, 300), max_size=25), st.integers(1, 8))
def test_every_plan_is_whole_and_fits(histogram, groups):
    plan = P.make_plan(histogram, 40, groups, 0.25)
    held = contents(plan, histogram)
    assert all(x <= 40 for x in held.values()) and (not held or max(held) < plan.containers)


def test_little_is_unused():
    random.seed(4)
    histogram = defaultdict(int)
    for _ in range(50_000):
        histogram[min(500, int(random.lognormvariate(4.2, 1.0)))] += 1
    plan = P.make_plan(histogram, 500)
    contents(plan, histogram)
    least = sum(s * n for s, n in histogram.items()) / 500
    assert plan.containers <= 1.03 * least


def test_configurations_cover_what_is_asked():
    sizes, counts = [7, 5, 3], [40, 30, 90]
    configurations = P.optimise(sizes, counts, 10)
    for i, n in enumerate(counts):
        assert sum(p[i] * x for p, x in configurations) >= n - 1e-6
    assert all(sum(a * s for a, s in zip(p, sizes)) <= 10 for p, _ in configurations)


def test_pack(spark):
    random.seed(9)
    sizes = [0, None, 64, 65, 200, 1] + [random.randint(0, 64) for _ in range(1500)] + [30] * 800
    df = spark.createDataFrame([(i, n, "clash", "clash") for i, n in enumerate(sizes)], SCHEMA)
    got = P.pack(df, "doc", "n", 64).collect()
    held, whole = defaultdict(int), defaultdict(list)
    for r in got:
        held[r["container"]] += r["size"]
        whole[r["doc"]].append((r["piece"], r["first"], r["size"]))
    assert max(held.values()) <= 64 and set(whole) == set(range(len(sizes)))
    for doc, n in enumerate(sizes):
        own = sorted(whole[doc])
        assert sum(x[2] for x in own) == (n or 0) and [x[0] for x in own] == list(range(len(own)))
        assert len(own) == max(1, -(-(n or 0) // 64)) and all(x[1] == 64 * x[0] for x in own)
    assert len(held) <= 1.1 * sum(n or 0 for n in sizes) / 64
    assert P.pack(df.limit(0), "doc", "n", 64).count() == 0


def test_a_hot_size_is_numbered_in_buckets(spark):
    """A third of the items of one size, with small buckets: each place is taken once, none is over full."""
    rows = [(i, 7 if i % 3 == 0 else 3 + i % 11) for i in range(900)]
    df = spark.createDataFrame(rows, "doc long, n int")
    few, many = (P.pack(df, "doc", "n", 20, 4, 0.3, bucket_rows=b).collect() for b in (20, 10_000))
    for got in (few, many):
        held = defaultdict(int)
        for r in got:
            held[r["container"]] += r["size"]
        assert len(got) == 900 and max(held.values()) <= 20 and sorted((r["doc"], r["size"]) for r in got) == rows
    assert len({r["container"] for r in few}) == len({r["container"] for r in many})
