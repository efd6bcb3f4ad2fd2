"""Operator 12 against the libraries themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import documents, invented
from hypothesis import given, settings
from hypothesis import strategies as st

from sourcelens.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [
    *invented(seed=8, n=40), (700, "don't I'll we'RE 's 'll''ve '"), (701, "\n\n'ra 'r 'l 'lx 'v e"), (702, "<|endoftext|>"), (703, " a<|endoftext|>\n\n<|endoftext|>x <|endof"), (704, "text|> b"),
    (705, "x" * 30_000), (706, " \t" * 5_000), (707, "a\x85b\xa0c d 　e\x1c f\x0b"), (708, "1²½٣ 12345678901234567890"), (709, "\U0001f600" * 300), (None, "no id, no doubt"), (None, None),
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_rows_equal_the_library(spark):
    got = [tuple(r) for r in tc.count_tokens(documents(spark, ROWS), limit=50).collect()]
    own = library()
    want = [(i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t in ROWS]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tc.count_tokens(documents(spark, [])).count() == 0


@pytest.fixture(scope="module")
def compiled():
    return tc.Transducer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstremdlv' 1!é"), st.characters(exclude_categories=["Cs"]))), min_size=1, max_size=5))
def test_any_texts(compiled, texts):
    assert compiled.compiled
    assert compiled.count(pa.array(texts)).tolist() == compiled.library(texts)


def test_chunks_windows_and_forgotten_states(compiled, monkeypatch):
    r = random.Random(2)
    words = ["".join(r.choice("aeioutrsnlé'日") for _ in range(r.randrange(1, 12))) for _ in range(3000)]
    text = "".join(r.choice(words) + r.choice([" ", "  ", "\n", " \n\n ", "", ", "]) for _ in range(40_000)) + "<|endoftext|> end " + "z" * 9000
    want = compiled.library([text])
    monkeypatch.setattr(tc, "WINDOW", 10_000)
    monkeypatch.setattr(tc, "STATES_MOST", 3_000)
    monkeypatch.setattr(tc, "LANES", 500)
    fresh = tc.Transducer(PATH)
    assert fresh.count(pa.array([text])).tolist() == want
    assert len(fresh.counter.items) <= 3_000 + 500 + 1
    monkeypatch.setattr(tc, "CHUNK", 7)
    assert fresh.count(pa.array([text, "", "x"])).tolist() == [*want, 0, 1]


def test_splitter_maps_compose(compiled):
    """The scan's boundaries are those of the state machine run from the first character."""
    data = np.frombuffer("don't  stop\n\n 'til 12's é''re\xff".encode("latin-1").replace(b"\xe9", "é".encode()), np.uint8)
    kinds, _ = compiled.splitter.classes(data)
    state, begins = 0, set()
    for i, kind in enumerate(kinds.tolist()):
        key = state << 4 | kind
        begins |= {i} if compiled.splitter.flags[key] & tc.HERE else set()
        begins |= {i - 1} if compiled.splitter.flags[key] & tc.BEFORE else set()
        state = int(compiled.splitter.to[key])
    begin, length = compiled.splitter.words(data)
    assert len(begin) == len(begins) and int(length.sum()) == len(data) - 1


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_vocabularies_are_counted_by_their_library(spark, name):
    rows = [(1, "Some words, héllo"), (2, None), (3, "")]
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(documents(spark, rows), vocabulary=public_tokenizers.path(name)).collect()}
    own = tc.Transducer(public_tokenizers.path(name))
    assert not own.compiled and got == dict(zip([1, 2, 3], own.library([t or "" for _, t in rows]), strict=True)) and got[1] > 3
