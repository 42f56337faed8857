import base64
import os
import random

import pytest

from maldure.llm import bpe as B

pytestmark = pytest.mark.skipif(not os.path.exists(B.VOCABULARY), reason="the vocabulary isn't here")
TEXTS = ["", None, " ", "hello world", "안녕하세요, 테스트입니다.", "a" * 5000, "0" * 3000, "<|endoftext|> it's we've I'LL", "\n\n  x \t", "🙂👨‍👩‍👧 𝒳", "é é Ωα привет", '{"run_id": "2024T", "wer": 0.123}', "한" * 3000, "\x00\x01", "　 "]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(B.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(B.VOCABULARY, "rb") as file:
        return B.TrieEncoder(file.read())


def test_equals_the_library(own, library):
    random.seed(3)
    texts = TEXTS + ["".join(random.choice("ab 가나éх0_.-\n") for _ in range(random.randint(0, 60))) for _ in range(300)]
    assert own.encode_batch(texts) == [library.encode_ordinary(t or "") for t in texts]


def test_memory_is_bounded(own, library, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 50)
    texts = [f"word{i} other{i}" for i in range(300)]
    for i in range(0, 300, 10):
        assert own.encode_batch(texts[i : i + 10]) == [library.encode_ordinary(t) for t in texts[i : i + 10]]
        assert len(own.ids) <= 90


def test_corpus(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "hello world", "clash")]
    df = spark.createDataFrame(rows, "doc long, text string, ids string")
    got = B.encode_corpus(df, "doc", "text").collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc", "ids"]
    for r in got:
        assert r["ids"] == library.encode_ordinary(TEXTS[r["doc"]] or "")
    counts = {r["doc"]: r["tokens"] for r in B.count_tokens(df, "doc", "text").collect()}
    assert counts[0] == counts[1] == 0 and counts[3] == 2
    assert B.encode_corpus(df.limit(0), "doc", "text").count() == 0
