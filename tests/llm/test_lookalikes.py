import unicodedata

import pytest
from py4j.protocol import Py4JError

from maldure.llm import lookalikes as L

SCHEMA = "id long, a string, b string, changed string"
WORDS = ["COPE 확인해 주세요"] * 4 + ["app VIP OK"] * 4
CASES = ["СОРЕ 파일", "VІP", "ОК", "ａｐｐ", "가​나", "a b", "a　b", unicodedata.normalize("NFD", "강아지"), "résumé", "Wi‐Fi", "−", "Ω", "樂器", "ᄀᄀ", "2‍9", "ᄏ", "끝﻿", "spаce", "ﾡ", "­" * 3000 + "x"]
PLAIN = ["спасибо라고", "привет", "α 버전", "Ω 표시", "ㅋㅋㅋ", "樂器", "résumé naïve", "“그거요”", "두  칸", "", None, "漢字かなカナ", "👨‍👩‍👧", "❤️", "x" * 50_000, "оса"]


def find(spark, texts):
    rows = [(i, t, None, "clash") for i, t in enumerate(texts)]
    return {r["id"] for r in L.find_lookalikes(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"]).collect()}


def test_cases_and_genuine_texts(spark):
    texts = WORDS + CASES + PLAIN
    found = find(spark, texts)
    assert [texts[i] for i in sorted(found)] == CASES


def test_each_field_and_each_copy(spark):
    rows = [(1, "a b", "a b", ""), (2, "a b", "plain", ""), (3, "a b", None, "")]
    got = sorted(tuple(r) for r in L.find_lookalikes(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"]).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (3, "a")]


def test_rewriting_makes_equal(spark):
    pairs = [("СОРЕ 파일", "COPE 파일"), ("가​나 다", "가나 다"), (unicodedata.normalize("NFD", "강아지 résumé"), "강아지 résumé"), ("Ｗｉ－Ｆｉ！", "Wi-Fi!"), ("спасибо​라고", "спасибо라고"), ("ᄉ﻿ᅥ", "서"), ("ᄏᄏ", "ㅋㅋ")]
    rows = [(i, a, b, "kept") for i, (a, b) in enumerate(pairs)] + [(100 + i, w, None, "kept") for i, w in enumerate(WORDS)]
    got = {r["id"]: r for r in L.rewrite_lookalikes(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"]).collect()}
    assert len(got) == len(rows)
    for i, (_, b) in enumerate(pairs):
        assert got[i]["a"] == got[i]["b"] == b and got[i]["changed"] == "kept"
    assert got[100]["a"] == WORDS[0] and got[100]["b"] is None


def test_classes_are_transitive():
    graph = L.Classes()
    for x, y in (("a", "b"), ("b", "c"), ("d", "e")):
        graph.join(x, y)
    assert sorted(map(sorted, graph.members().values())) == [["a", "b", "c"], ["d", "e"]]
    assert L.latin_classes()["А"] == L.latin_classes()["Α"] == "A"


def test_letters_of_all_scripts(spark):
    """Unicode's confusables, not a list of ours: Armenian, Cherokee, Lisu and more; real words and letters stay."""
    like = L.latin_classes(L.confusable_letters(spark))
    assert len(like) > 250 and {like[c] for c in "օᎪꓮɡıӏ"} == {"o", "A", "g", "i"} and like["І"] == "I" and "п" not in like
    texts = ["VIP app good"] * 3 + ["VІᏢ", "ցood", "ꓮpp", "gооd", "αpp"] + ["α 버전", "ɪ", "привет", "ρ", "Ω"] + ["ıstanbul"]
    rows = spark.createDataFrame([(i, t, None, "") for i, t in enumerate(texts)], SCHEMA)
    assert [texts[r["id"]] for r in L.find_lookalikes(rows, "id", ["a", "b"]).orderBy("id").collect()] == ["VІᏢ", "ցood", "ꓮpp", "gооd", "αpp"]
    got = {r["id"]: r["a"] for r in L.rewrite_lookalikes(rows, "id", ["a", "b"]).collect()}
    assert [got[i] for i in range(3, 8)] == ["VIP", "good", "App", "good", "app"] and [got[i] for i in range(8, 14)] == texts[8:]


def test_failure_is_no_result(spark, monkeypatch):
    """Without ICU's table, or with a failing one, there is an error, not a result with fewer letters."""
    from types import SimpleNamespace

    def jvm(builder):
        return SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=builder))))))

    def fails(error):
        def builder():
            raise error

        return builder

    short = SimpleNamespace(build=lambda: SimpleNamespace(getSkeleton=lambda text: "a"))
    cases = [(spark._jvm.com.ibm.icu.text.NoSuchChecker.Builder, RuntimeError), (fails(Py4JError("gone")), Py4JError), (lambda: short, RuntimeError)]
    rows = spark.createDataFrame([(0, "VІᏢ", None, "")], SCHEMA)
    for builder, error in cases:
        monkeypatch.setattr(rows.sparkSession, "_jvm", jvm(builder))
        for job in (lambda: L.confusable_letters(rows.sparkSession), lambda: L.find_lookalikes(rows, "id", ["a", "b"]), lambda: L.rewrite_lookalikes(rows, "id", ["a", "b"])):
            with pytest.raises(error):
                job()
        monkeypatch.undo()


def test_frequency_decides_between_spellings(spark):
    """The same words, with one spelling or the other in the majority."""
    for latin, cyrillic, wanted in ((5, 2, "COPE"), (2, 5, "СОРЕ")):
        rows = [(i, t, None, "") for i, t in enumerate(["COPE 파일"] * latin + ["СОРЕ 파일"] * cyrillic)]
        got = [r["a"] for r in L.rewrite_lookalikes(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"]).orderBy("id").collect()]
        assert got == ["COPE 파일"] * latin + [f"{wanted} 파일"] * cyrillic


def test_a_real_letter_is_no_rival(spark):
    """A Greek letter that is often used as itself doesn't keep a Cyrillic one from being a Latin one."""
    texts = ["α 버전"] * 9 + ["a 버전"] * 3 + ["а버p"]
    rows = [(i, t, None, "") for i, t in enumerate(texts)]
    got = [r["a"] for r in L.rewrite_lookalikes(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"]).orderBy("id").collect()]
    assert got == texts[:-1] + ["a버p"]


def test_words_are_rewritten_whole():
    letters = L.Letters(L.latin_classes())
    rewrite = L.WordRewriter({"аb": "ab", "аbс": "abc"}, letters)
    assert rewrite("аb аbс xаb аbd,аb") == "ab abc xаb аbd,ab"


def test_representatives_follow_frequency():
    assert L.representatives({"ア": 5, "ｱ": 1})["ｱ"] == "ア" and L.representatives({"ア": 1, "ｱ": 5})["ア"] == "ｱ"
    assert L.representatives({"Ａ": 10**6})["Ａ"] == "A"


def test_rewriting_twice_changes_nothing():
    own = L.Rewriter()
    for text in CASES:
        once = own.points(text)
        assert own.points(once) == once


def test_empty(spark):
    assert find(spark, []) == set() and L.rewrite_lookalikes(spark.createDataFrame([], SCHEMA), "id", ["a", "b"]).count() == 0
