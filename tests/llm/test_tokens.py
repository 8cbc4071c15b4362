"""Token counts against the library itself."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftframe.llm import token_counts
from driftframe.llm.queries import tokenizer_path

pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(tokenizer_path())


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=" aBz09é\n\t\r'’.,!s|ſßÿĀ\x1c\x85\xa0日<>end", max_size=40))
def test_counts_equal_the_library(text):
    c = test_counts_equal_the_library.counter = getattr(test_counts_equal_the_library, "counter", None) or token_counts.TokenCounter(tokenizer_path())
    assert c.count(text) == len(c.tokenizer.encode(text, add_special_tokens=False).ids)


def test_special_strings_are_the_librarys(counter):
    text = "a<|endoftext|>b <|endoftext|>"
    assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_a_small_cache_gives_the_same(counter, monkeypatch):
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(400)) for _ in range(5)]
    want = [counter.whole(t) for t in texts]
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 50)
    small = token_counts.TokenCounter(tokenizer_path(), {"ab": counter.whole("ab")})
    assert [small.count(t) for t in texts * 2] == want * 2


def test_table_and_edges(spark, counter):
    long_text = "seldom heard of words " * 30_000
    rows = [(1, "hello hello world", 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, "hello hello world", 5), (4, long_text, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(d, tokenizer_path()).collect()))
    n = counter.whole(long_text)
    assert got == [(0, 1, 1, False), (1, 17, 3, False), (1, 17, 3, False), (2, 0, 0, False), (3, 0, 0, False), (4, len(long_text), n, True)]
    assert token_counts.count_tokens(d.limit(0), tokenizer_path()).count() == 0
    table = token_counts.frequent(d, tokenizer_path(), 2)
    assert len(table) == 2 and all(counter.whole(k) == v for k, v in table.items())
