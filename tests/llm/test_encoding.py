"""The pair occurrence index against a library reading the same vocabulary."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from refweave.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}"), reason="no vocabulary")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def mine():
    return encoding.PairIndexEncoder()


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text(texts):
    from tokenizers import Tokenizer

    t = test_any_text.t = getattr(test_any_text, "t", None) or Tokenizer.from_file(f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}")
    t.encode_special_tokens = True
    e = test_any_text.e = getattr(test_any_text, "e", None) or encoding.PairIndexEncoder()
    assert e.encode(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_long_and_special(library, mine):
    texts = ["a" * 200_000, "ab" * 50_000, " " * 30_000, "<|endoftext|>", "x <|endoftext|>\r\n\ty", "é" * 5000, "\x00\x1c\u2028"]
    assert mine.encode(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_operator(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (4, "日本語 \U0001f469\u200d\U0001f4bb")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["out"])) for r in encoding.encode(df, "text", ["doc_id"], out="out").collect())
    assert got == [(i, library.encode(t, add_special_tokens=False).ids if t else []) for i, t in rows]
    assert sorted(r["n_tokens"] for r in encoding.n_tokens(df, "text", ["doc_id"]).collect())[:2] == [0, 0]
    assert encoding.encode(df.limit(0), "text", ["doc_id"]).count() == 0


def test_round_trip(library, mine):
    text = "Round — trip: \t£5 naïve\n\n"
    assert library.decode(mine.encode([text])[0]) == text
