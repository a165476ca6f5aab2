"""Token counts equal the library's, text by text."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talliard.llm import tokens
from talliard.sources.tables import table

ODD = ["", " ", "\n", "a", "don't 'tis x's'd --'s ''s '", "a  b\n\n  c \n", " x  y", "12345 ½ ①", "é́ 余额 😀😀", "<|endoftext|>", "I'LL we'll 'l 'v 've'", "x\x1cy\x85z", "\r\n\r\n3\r\n", "'s", "a's", " 's", "'r 're'"]


def library(texts):
    e = tokens.encoding(tokens.VOCABULARY)
    return [len(e.encode_ordinary(t or "")) for t in texts]


def test_odd_texts():
    assert list(tokens.count(ODD)) == library(ODD)
    assert list(tokens.count([None, *ODD[::-1], None])) == [0, *library(ODD[::-1]), 0]
    assert list(tokens.count([])) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'slvretdm \n\t é1½.-!　😀"), max_size=30), max_size=6))
def test_any_texts(texts):
    assert list(tokens.count(texts)) == library(texts)


def test_whole_corpus(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("text", tokens.token_count("text").alias("n"))
    rows = df.collect()
    assert [r["n"] for r in rows] == library([r["text"] for r in rows])


def test_windows_of_long_texts(monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice(["word", " ", "\n", "\n\n", "12", "'s", ". ", "é"]) for _ in range(20000))
    want = library([text, "x" * 5000, text[:77]])
    monkeypatch.setattr(tokens, "WINDOW", 1000)
    assert list(tokens.count([text, "x" * 5000, text[:77]])) == want
    assert len(tokens._windows(text)) > 10 and "".join(tokens._windows(text)) == text


@pytest.mark.parametrize("bound", [0, 5])
def test_forgetting_pieces_changes_nothing(monkeypatch, bound):
    monkeypatch.setattr(tokens, "REMEMBERED", bound)
    assert list(tokens.count(ODD)) == library(ODD)
