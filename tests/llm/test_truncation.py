import json
import math
import random

from pyspark.sql import functions as F

from maldure.llm import truncation as T

random.seed(21)
NOUNS = "파일 창문 등대 수업 지갑 배터리 예약 보험 음악 시장".split()
ENDS = ["확인해 주세요", "누가 가져갔어요", "같이 가자고 했어", "미루기로 했어요", "어디에 있나요"]


def turns(n):
    return "\n".join(f"{'AB'[i % 2]}: {random.choice(NOUNS)}에서 {random.choice(NOUNS)}까지 {random.choice(ENDS)}{random.choice(['', '', '?', '.'])}" for i in range(n))


def report(n):
    return " ".join(f"The {random.choice(['decoder', 'resampler'])} {random.choice(['drops', 'keeps'])} {random.choice(['loan words', 'long pauses'])}." for _ in range(n))


DOCS = [("call", turns(random.randint(3, 9))) for _ in range(200)] + [("report", report(random.randint(3, 9)) + random.choice(["", "\n\nThanks", "\n(closed)"])) for _ in range(200)]
CUT = ["The decoder drops loan", "The resampler keeps (cer 0.", "A: 파일에서 창문까지 누가", "A: 예약에서 보험까지 미루기로 했", "B: 예약에서 시장까지 미루기로 했어", '{"run_id": "x", "wer"', "[{\"a\": 1}, {\"b\"", "x\n```\npython -m a", "The decoder drops lo...", "Text [truncated]", "The decoder keeps l�"]
WHOLE = ["The decoder drops loan words.", "The decoder drops loan words...", "x done.\n\nThanks", "A: 파일에서 창문까지 누가 가져갔어요", json.dumps({"a": [1, "b"]}), "x\n```\ncode\n```", "", None, "  \n", "ok", "가"]


def judge(spark, docs):
    df = spark.createDataFrame([(i, t, s, "clash") for i, (s, t) in enumerate(docs)], "doc long, text string, src string, grade string")
    return {r["doc"]: r for r in T.judge_truncation(df, "doc", "text", "src").collect()}


def test_endings(spark):
    docs = DOCS + [("report", t) for t in CUT + WHOLE] + [("report", CUT[0])]
    got = judge(spark, docs)
    assert len(got) == len(docs)
    cut = [docs[i][1] for i in range(len(DOCS), len(docs)) if got[i]["truncated"]]
    assert cut == CUT + CUT[:1]
    assert not any(got[i]["truncated"] for i in range(len(DOCS)))


def test_a_limit_is_significant_and_copies_are_none(spark):
    long = [turns(60) for _ in range(150)]
    docs = DOCS + [("limited", t[:700]) for t in long] + [("limited", turns(5)) for _ in range(150)] + [("call", DOCS[0][1])] * 60
    got = judge(spark, docs)
    at = [r for r in got.values() if r["unit"]]
    assert {(r["source"], r["unit"], r["len"]) for r in at if r["unit"] == "chars"} == {("limited", "chars", 700)} and len(at) >= 150
    assert sum(r["reason"] == "limit" for r in at) > 100 and {r["source"] for r in at} == {"limited"}


def test_hazards(spark):
    from collections import Counter

    lengths = [100 + i % 50 for i in range(500)] + [120] * 60 + [110] * 60  # those at 120 are incomplete, those at 110 aren't
    bad = {n: 60 if n == 120 else n % 3 == 0 for n in set(lengths)}
    rows = [("s", "chars", n, texts, int(bad[n])) for n, texts in Counter(lengths).items()] + [(None, "chars", 5, 1, 1)]
    got = {(r["source"], r["len"]): r for r in T.length_hazards(spark.createDataFrame(rows, "source string, unit string, len int, texts long, incomplete long")).collect()}
    risk = sum(1 for n in lengths if n >= 120)
    assert got["s", 120]["incomplete"] == 60 and got["s", 120]["at_risk"] == risk and math.isclose(got["s", 120]["hazard"], 60 / risk)
    near = [n for n in set(lengths) if n != 120 and abs(math.log(n / 120)) <= T.NEIGHBOURS + 1e-3]
    expected = (sum(bad[n] for n in near) + 0.5) / (sum(sum(x >= n for x in lengths) for n in near) + 1)  # no length is left out here
    assert math.isclose(got["s", 120]["expected"], expected, rel_tol=1e-9)
    assert [k for k, r in got.items() if r["significant"]] == [("s", 120)]


def test_transfers(spark):
    """A source with many incomplete endings at all lengths is raised, one with hardly any lowered, one with few texts neither."""
    rows = [("bad", o, 300, 30) for o in range(5, 10)] + [("good", o, 300, 0) for o in range(5, 10)] + [("rest", o, 300, 8) for o in range(5, 10)] + [(None, 7, 10, 0)]
    got = {r["source"]: r for r in T.transfer_hazards(spark.createDataFrame(rows, "source string, octave int, texts long, incomplete long")).collect()}
    assert {s: (r["raised"], r["lowered"]) for s, r in got.items()} == {"bad": (True, False), "good": (False, True), "rest": (False, True), None: (False, False)}
    others = sum(((30 + 8) / ((10 - o) * 600 + (10 if o <= 7 else 0))) * (10 - o) * 300 for o in range(5, 10))
    assert math.isclose(got["good"]["expected"], others, rel_tol=1e-9)


GRADED = "_key long, source string, h long, chars int, bytes int, room int, grade int"


def graded(spark, rows):
    return spark.createDataFrame([(i, s, i, n, n, -(-n // 4) * 4, g) for i, (s, n, g) in enumerate(rows)], GRADED)


def test_the_hazards_decide(spark):
    """The same grades, with and without what the lengths say."""
    random.seed(3)
    spread = lambda: random.randint(100, 900)
    rows = [("limited", spread(), T.COMPLETE) for _ in range(500)] + [("limited", 512, T.OPEN_QUESTION if i % 4 == 0 else T.INCOMPLETE) for i in range(80)] + [("limited", 512, T.COMPLETE)] * 5
    rows += [("lossy", spread(), T.INCOMPLETE if i % 10 == 0 else T.COMPLETE) for i in range(500)]
    rows += [("sound", spread(), T.INCOMPLETE if i == 7 else T.BROKEN if i == 9 else T.OPEN_QUESTION if i == 11 else T.COMPLETE) for i in range(500)]
    got = [r["reason"] for r in T.decide(graded(spark, rows)).orderBy("_key").collect()]
    assert got[500:580] == ["limit"] * 80 and got[580:585] == [None] * 5
    assert [r for r, (s, _, g) in zip(got, rows) if s == "lossy" and g] == ["transfer"] * 50
    assert [r for r, (s, _, g) in zip(got, rows) if s == "sound" and g] == [None, "structure", None]
    small = [r["reason"] for r in T.decide(graded(spark, rows[:3] + [("limited", 512, T.OPEN_QUESTION), ("x", 100, T.INCOMPLETE)])).orderBy("_key").collect()]
    assert small == [None, None, None, None, "ending"]


def test_empty_and_long(spark):
    assert judge(spark, []) == {}
    got = judge(spark, [(None, "x. " * 40_000), (None, None), ("s", "y" * 100_000)])
    assert got[0]["chars"] == 120_000 and not any(r["truncated"] for r in got.values())


def test_a_closing_line_of_any_length(spark):
    """A long line that closes many texts is learned, and nothing of it is cut off."""
    close = "-- " + "recorded with the consent of everyone on the line and kept for as long as the agreement of both sides says " * 3
    got = judge(spark, DOCS + [("call", turns(4) + "\n" + close.strip()) for _ in range(40)] + [("call", turns(4) + "\n" + close.strip()[:-9])])
    assert [i for i, r in got.items() if r["truncated"]] == [len(DOCS) + 40]


def test_share_per_source(spark):
    got = judge(spark, DOCS + [("bad", CUT[i % 3]) for i in range(3)] + [("bad", "Fine.")])
    bad = [r for r in got.values() if r["source"] == "bad"]
    assert sum(r["truncated"] for r in bad) == 3 and len(bad) == 4


def test_prose_behind_a_bracket_is_learned(spark):
    """A source that begins every text with a time in brackets has its own endings, and they are complete."""
    times = [f"[00:{i % 60:02}] {turns(4)}" for i in range(200)]
    got = judge(spark, [("timed", t) for t in times] + [("timed", "[00:12] A: 파일에서 창문까지 누가")])
    assert [i for i, r in got.items() if r["truncated"]] == [len(times)]
    assert not T.is_json("[00:12] A: x") and not T.is_json("[Title] x") and T.is_json('{"a": 1') and T.is_json("\n [{")


def test_the_query_by_source(spark, tmp_path):
    from maldure.llm.q_truncation import p8_sources

    rows = [(i, t, s) for i, (s, t) in enumerate(DOCS + [("bad", CUT[i % 3]) for i in range(3)] + [("bad", None), ("bad", "Fine.")])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["source"]: r for r in p8_sources(spark, str(tmp_path)).collect()}
    assert (got["bad"]["documents"], got["bad"]["truncated"], got["bad"]["share"]) == (4, 3, 0.75)
    assert sum(got["bad"][f"by_{x}"] for x in ("limit", "transfer", "ending", "structure")) == 3
    assert got["call"]["documents"] == 200 and got["call"]["truncated"] == 0
