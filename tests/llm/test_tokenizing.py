"""Token ids of blocks of texts against plain encoding, with full tables and small blocks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import tokenizing
from evenkeel.llm.queries import vocabulary

EDGES = [None, "", " ", "\n", "a  b", "a\tb\r\nc", "<|endoftext|> x", "x<|endoftext|>", "İstanbul ß É", "word,, (word).", "don't", "3.14", "w" * 3_000 + ".", "same same same, same."]


@pytest.fixture(scope="module")
def encoder():
    return tokenizing.Encoder(vocabulary())


def plain(encoder, texts):
    return [encoder.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def ids(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]


def test_edges_and_no_texts(encoder):
    assert ids(encoder, EDGES) == plain(encoder, EDGES)
    assert encoder.encode([]) == []


@pytest.mark.parametrize("limit", [0, 3])
def test_full_tables_and_small_blocks(encoder, monkeypatch, limit):
    monkeypatch.setattr(tokenizing, "CACHE_PIECES", limit)
    monkeypatch.setattr(tokenizing, "CACHE_STEMS", limit)
    monkeypatch.setattr(tokenizing, "CACHE_CHARS", 20)
    monkeypatch.setattr(tokenizing, "BLOCK_CHARS", 10)
    assert ids(encoder, EDGES * 2) == plain(encoder, EDGES * 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé ß,.;!?#'|<>3\n\t中İ_-("), max_size=40), max_size=6))
def test_any_texts(encoder, texts):
    assert ids(encoder, texts) == plain(encoder, texts)
