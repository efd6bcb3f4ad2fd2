"""Token ids from chunks that are cut in bytes, numbered by Arrow and remembered, against the library's for whole texts."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sourcelens.llm import tokens

VOCABULARY = tokens.default_vocabulary()
ODD = "\0\x1c\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u2060\u3000\ufeff\u0301\U00010400"
PARTS = [*" \n\t\r\x0b'aZbsterlvmd109!._-(", *ODD, *"é×÷ßǅʼи҂ש٣²½字の–”’🙂", "'re", "'s", " the", "\n\n", "  ", "<|endoftext|>"]
TEXTS = st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.none(), min_size=1, max_size=8)


def same_as_the_library(own, texts, column=None):
    ids, offsets = own.encode(texts if column is None else column)
    want = [e.ids for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_columns_give_the_librarys_ids(texts):
    column = pa.array(["before", *texts, "after"], pa.string()).slice(1, len(texts))
    same_as_the_library(tokens.encoder(VOCABULARY), texts, column)


def test_every_pair_of_characters_around_a_cut():
    every = [f"{a}{b}{c}{d}" for a in ("x", "é", ".", "") for b in PARTS for c in PARTS for d in ("x", " y", "\n", "")]
    same_as_the_library(tokens.Encoder(VOCABULARY), every)


def test_no_texts_and_empty_texts():
    own = tokens.Encoder(VOCABULARY)
    for texts in ([], [""], [None, ""], ["<|endoftext|>"]):
        same_as_the_library(own, texts)


def test_chunks_met_again_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_MOST", 40)
    own, sent = tokens.Encoder(VOCABULARY), []
    own.library = lambda texts, library=own.library: sent.extend(texts) or library(texts)
    for k in range(30):
        rare = [f"rare{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + j)}" for j in range(20)]
        texts = [f"common words {' '.join(rare)} common, words"]
        same_as_the_library(own, texts)
    assert sum("common" in t for t in sent) == 1  # with and without a space, in one text
    assert len(own.number) < 80


def test_new_words_reach_the_library_many_at_once():
    own, sent = tokens.Encoder(VOCABULARY), []
    own.library = lambda texts, library=own.library: sent.extend(texts) or library(texts)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    same_as_the_library(own, [" ".join(words)])
    assert len(sent) <= 3


@pytest.mark.parametrize("lines", [1, 7])
def test_words_stay_apart_in_the_librarys_text(monkeypatch, lines):
    monkeypatch.setattr(tokens, "LINES", lines)
    same_as_the_library(tokens.Encoder(VOCABULARY), ["it's 'tis\n'sblood  two\t tabs a\nb\n\nc d- -e 'f ' g’h 12ab34", " x y  z\x1c w"])
