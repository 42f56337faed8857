import random

from maldure.llm import mojibake as M

random.seed(11)
NOUNS = "파일 창문 등대 수업 지갑 배터리 예약 보험 음악 시장 커피 신호등 노트북 비밀번호 주차장 냉장고 떡볶이 김치찌개 영수증 상담원 카드 약속".split()
ENDS = "확인해 주세요 기다리고 계세요 누가 가져갔어요 어디에 있나요 보내 드릴게요 너무 비싸더라고요 생각보다 가까워요 취소할 수 있을까요".split("  ")[0].split()
CLEAN = [" ".join(random.choice(NOUNS) + random.choice(["을", "이", "은", "에서", "까지", "도"]) for _ in range(3)) + " " + " ".join(random.sample(ENDS, 2)) for _ in range(600)]
GENUINE = ["café 휴대폰", "Überraschung im Gespräch, naïve façade", "今天的会议几点开始", "もう一度お願いします", "料金プランを変更したいです", "спасибо라고 등대부터", "Ω 표시", "25°C ± 2, 폭은 3½입니다", "¿dónde está la estación?", "契約 수업이랑", "└ 하위 항목", "♪", "D01/再録音_00001.txt", "", None, "plain ascii", "가" * 20000, "「파일」"]


def western(b):
    return "".join(chr(x) if bytes([x]).decode("cp1252", "replace") == "�" else bytes([x]).decode("cp1252") for x in b)


def garbled():
    text = "파일을 창문에서 확인해 주세요"
    single = [text.encode(right).decode(wrong, "replace") for right in ("cp949", "utf-8") for wrong in ("cp437", "mac_roman")]
    single += [western(text.encode("cp949")), western(text.encode("utf-8")), text.encode("cp949").decode("gbk")]
    twice = western(western(text.encode("utf-8")).encode("utf-8"))
    return [(x, text) for x in [*single, twice]]


def judge(spark, values):
    rows = [("t", i, v, "clash") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "table_name string, row_key long, value string, restored string").drop("restored")
    return {r["row_key"]: r for r in M.restore_values(df).collect()}


def test_garbled_texts_are_restored_and_genuine_ones_left(spark):
    bad = garbled()
    lost = ["�� 파일", "파일".encode("cp949").decode("utf-8", "replace"), "x\u0081"]
    part = ["D01/" + western("파일".encode("utf-8")) + "/창문_0001.txt"]
    values = CLEAN + [b for b, _ in bad] + lost + part + [bad[0][0], bad[0][0]] + GENUINE
    got = judge(spark, values)
    first = len(CLEAN)
    for i, (_, text) in enumerate(bad):
        assert got[first + i]["restored"] == text and not got[first + i]["lost"], got.get(first + i)
    first += len(bad)
    assert all(got[first + i]["lost"] for i in range(len(lost)))
    assert got[first + len(lost)]["restored"] == "D01/파일/창문_0001.txt"
    rest = range(first + len(lost) + len(part) + 2, len(values))
    assert [values[i] for i in rest if i in got] == []
    assert first + len(lost) + 1 in got and first + len(lost) + 2 in got  # each copy counts
    assert not any(i in got for i in range(len(CLEAN)))


def test_round_trip_of_single_byte_tables():
    for name, table in M._single_bytes().items():
        assert set(table.values()) <= set(range(128, 256)) and len(set(table.values())) == 128, name


def test_foreign_dictionaries_come_from_the_values(spark):
    """Genuine foreign words train their script's dictionary; what a chain can undo, or was lost, doesn't."""
    foreign = [f"{x} {random.choice(NOUNS)} {i}" for i in range(30) for x in ("café", "привет", "通話")]
    values = CLEAN + foreign + [b for b, _ in garbled()] * 3 + ["� 파일 하나"] * 5 + [None, ""]
    held, known = M.learn(spark.createDataFrame([(v,) for v in values], "value string"))
    blobs = dict(held)
    assert {"ko", "en", "LATIN", "CYRILLIC", "CJK"} <= set(blobs) and "привет".encode() in blobs["CYRILLIC"]
    assert all("�".encode() not in b for b in blobs.values()) and "é" not in known and "파" in known
    one, few = (dict(M.learn(spark.createDataFrame([(v,) for v in values], "value string").repartition(n), 50, 20)[0]) for n in (1, 7))
    assert one == few  # the least hashes of all, however the values are spread


def test_dictionaries_come_from_all_values(spark):
    """Every value counts: of Korean, English and other values that nearly all differ, more than any sample would hold; and how often each does."""
    rows = [f"파일 번호 {i}" for i in range(5000)] + [f"file no {i}" for i in range(1500)] + [f"café {i}" for i in range(700)]
    rows += ["등대로"] * 3 + ["once"] * 2 + ["naïve"] * 4 + ["♪"]
    df = spark.createDataFrame([(v,) for v in rows], "value string")
    texts = df.select("value", M.F.lit("x").alias("name"))
    counts = {(r["first"], r["second"]): r["n"] for r in M.count_pairs(texts).where("name = 'x'").collect()}
    assert counts[("", "파일")] == counts[("파일", " 번호")] == 5000 and counts[("", "file")] == 1500 and counts[("", "café")] == 700
    assert counts[("", "등대로")] == 3 and counts[("naïve", "")] == 4 and counts[("", "♪")] == 1
    own, known = M.learn_undoubted(df)
    other = M.learn_scripts(M.tell_apart(df, known))
    # what one value in thousands has is held as well, wherever it lies
    assert "등대로".encode() in own["ko"] and b"once" in own["en"] and "naïve".encode() in other["LATIN"] and "♪".encode() in other["signs"]


def test_greatest_pairs_are_those_of_all_tasks(spark):
    rows = [("x", f"a{i}", "", i) for i in range(100)] + [("y", "b", "", 1), ("z", "c", "", 1)]
    df = spark.createDataFrame(rows, "name string, first string, second string, n long").repartition(5)
    got = sorted((r["name"], r["first"]) for r in M.greatest(df, {"x": 3, "y": 0}, 7).collect())
    assert got == [("x", "a97"), ("x", "a98"), ("x", "a99"), ("z", "c")]


def test_training_lines_have_every_pair_as_often():
    texts = ["가 나 다", "가 나", "나 가 나 라", "a_b/c", ""] * 3
    counts = M.Counter(p for x in texts for p in M.pairs(x))
    lines = M.training_lines(counts)
    assert M.Counter(p for x in lines for p in M.pairs(x)) == counts
    assert M.training_lines(dict(reversed(counts.items()))) == lines and M.training_lines({}) == []
    few = M.training_lines({("", "a"): 10**9, ("a", ""): 10**9, ("", "rare"): 1}, 64)
    assert "rare" in few and sum(map(len, few)) < 64 * M.TRAINING_TEXT + 200


def test_garbled_many_times_over():
    """Decodings are undone until nothing is gained, not a fixed number of times."""
    text = "파일을 창문에서 확인해 주세요"
    deep = text
    for _ in range(4):
        deep = western(deep.encode("utf-8"))
    own = M.Restorer({"ko": M.train(CLEAN)}, frozenset(text))
    assert own.restore(deep) == (text, ["utf-8 read as western"] * 4)
    assert own.restore(text) == (text, []) and own.restore("파일�") == ("파일�", [M.LOSS])


def test_few_and_no_rows(spark):
    assert judge(spark, []) == {}
    assert set(judge(spark, [None, "", "가", "�"])) == {3}
