import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maldure.functions import metrics as M


def plain_table(u, v):
    """The whole table, cell by cell."""
    rows = [[(j, 0, 0, j) for j in range(len(v) + 1)]]
    for i, a in enumerate(u, 1):
        row = [(i, 0, i, 0)]
        for j, b in enumerate(v, 1):
            sub, dele, ins = rows[-1][j - 1], rows[-1][j], row[-1]
            choices = [(sub[0] + (a != b), sub[1] + (a != b), sub[2], sub[3]), (dele[0] + 1, dele[1], dele[2] + 1, dele[3]), (ins[0] + 1, ins[1], ins[2], ins[3] + 1)]
            row.append(min(choices, key=lambda c: c[0]))
        rows.append(row)
    return rows[-1][-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=9), st.text("abc", max_size=9)), min_size=1, max_size=12))
def test_edit_counts_equal_the_plain_table(pairs):
    got = M.edit_counts([a for a, _ in pairs], [b for _, b in pairs])
    assert [tuple(x) for x in got.tolist()] == [plain_table(a, b) for a, b in pairs]


def test_edit_counts_of_unlike_sizes():
    pairs = [("", ""), ("a" * 300, "b"), ("", "abc"), ("abc", ""), ("cbab", "abcba"), ("abcba", "cbab")]
    assert [tuple(x) for x in M.edit_counts(*zip(*pairs)).tolist()] == [plain_table(a, b) for a, b in pairs]


def rates(spark, pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ref string, pred string")
    p, r = F.col("pred"), F.col("ref")
    counted = [M.counts(m, p, r).alias(f"{m}_counts") for m in ("wer", "cer", "jer")]
    return rows.select("i", *[f(p, r).alias(n) for n, f in M.RATES.items()], *counted).orderBy("i").collect()


def test_goldens(spark):
    hello, labels, both_empty, no_ref, jamo, same = rates(spark, [("hello there", "hello world"), ("a b c d", "a x"), ("", ""), ("", "x"), ("강", "가"), ("가 나", "가 나")])
    assert hello["wer"] == 0.5 and hello["cer"] == 5 / 11 and hello["ser"] == 1 and hello["cer_counts"]["hits"] == 6 and hello["wer_counts"]["substitutions"] == 1
    # words are compared from the reference, so insertions and deletions are exchanged
    assert labels["wer"] == 0.75 and tuple(labels["wer_counts"]) == (1, 1, 0, 2)
    assert (both_empty["wer"], both_empty["cer"], both_empty["jer"], both_empty["ser"]) == (0, 0, 0, 0)
    assert math.isinf(no_ref["wer"]) and math.isinf(no_ref["cer"]) and math.isinf(no_ref["jer"])
    assert jamo["jer"] == 1 / 3 and tuple(jamo["jer_counts"]) == (2, 0, 1, 0)
    assert same["wer"] == same["cer"] == same["jer"] == same["ser"] == 0


def test_null_texts_have_no_rate(spark):
    row = rates(spark, [(None, "a")])[0]
    assert row["wer"] is None and row["cer"] is None


def test_morphemes_by_a_given_tokenizer(spark):
    rows = spark.createDataFrame([("ab cd", "ab ce"), ("", "x"), (None, "x")], "ref string, pred string")
    got = [r[0] for r in rows.select(M.mer(F.col("pred"), F.col("ref"), lambda t: list(t.replace(" ", "")))).collect()]
    assert got[0] == 0.25 and math.isinf(got[1]) and got[2] is None


def test_outliers(spark):
    rows = spark.createDataFrame([(1.0,), (1.0001,), (float("inf"),), (float("nan"),), (None,)], "m double")
    assert [r[0] for r in rows.select(M.is_outlier(F.col("m"), 1.0)).collect()] == [False, True, True, False, False]


def test_performance_figures(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 8000, 16000.0), (1.0, 0.0, 0, 5.0), (1.0, 1.0, None, 5.0)], "t double, d double, rate int, n double")
    got = rows.select(M.rtf(F.col("t"), F.col("d")).alias("rtf"), M.audio_duration(F.col("n"), F.col("rate")).alias("dur"), M.sample_rate(F.col("rate")).alias("rate")).collect()
    assert got[0]["rtf"] == 0.5 and got[0]["dur"] == 2.0 and math.isinf(got[1]["rtf"]) and got[1]["dur"] == 0.0 and [r["rate"] for r in got] == [8000, 16000, 16000]


def test_evaluate_by_name(spark):
    rows = spark.createDataFrame([("a", "b")], "ref string, pred string")
    assert rows.select(*[c.alias(n) for n, c in M.evaluate(F.col("pred"), F.col("ref"), ["cer", "flops", "none"]).items()]).columns == ["cer"]


def test_equal_texts_need_no_table():
    from maldure.functions.metrics import edit_counts

    got = edit_counts(["same", ["a"], "", "ab"], ["same", ["a"], "", "b"]).tolist()
    assert got == [[0, 0, 0, 0]] * 3 + [[1, 0, 1, 0]]
