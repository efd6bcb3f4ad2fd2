"""Suffix arrays, token files and packing against brute force and exact round trips."""

import numpy as np
import pytest
from helpers import documents, invented, removed_bytes
from hypothesis import given, settings
from hypothesis import strategies as st

from sourcelens.llm import packing, suffix, token_files, tokens

VOCABULARY = tokens.default_vocabulary()


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_matches_a_dictionary_of_all_strings(spark, seed):
    rows = invented(seed)
    got = suffix.suffix_dedup(documents(spark, rows), block_bytes=4000).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, removed_bytes(rows)))


def test_suffix_dedup_periodic_texts_and_zero_bytes(spark):
    rows = [(0, "ab" * 100), (1, "b" + "ab" * 80), (2, "a" * 60), (3, "a" * 49), (4, "a" * 120 + "b"), (5, "\0" * 70), (6, "x" * 10 + "\0" * 55 + "y"), (7, "ab" * 25)]
    got = suffix.suffix_dedup(documents(spark, rows), block_bytes=100, with_kept=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(removed_bytes(rows))
    for r in got:
        assert len(r.kept) == r.n_bytes - r.n_removed and sum(b - a for a, b in r.spans) == r.n_removed


def test_suffix_dedup_of_nothing(spark):
    assert suffix.suffix_dedup(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t'aZbsterlvmd1²!.é日\xa0\x85", "<|endoftext|>", "'re"]), max_size=25).map("".join), min_size=1, max_size=8))
def test_encoder_gives_the_librarys_ids(texts):
    own = tokens.encoder(VOCABULARY)
    ids, offsets = own.encode(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_tells_long_words_apart():
    one = "a"
    while len(one) < 2048:  # Thue-Morse words: equal under any polynomial hash with 64 bits
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    own = tokens.Encoder(VOCABULARY)
    ids, offsets = own.encode([one, None, f"short {other} {one}", "x\x1cy\u180ez", other])
    for k, t in enumerate([one, "", f"short {other} {one}", "x\x1cy\u180ez", other]):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
    assert not any(len(c) > tokens.CHUNK_MOST for c in own.number)


def test_token_files_round_trip(spark, tmp_path):
    rows = invented(3)
    token_files.write_token_files(documents(spark, rows), str(tmp_path / "t"), block_tokens=200, record_tokens=1500, part_bytes=4000)
    got = token_files.read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    tokenizer, at = tokens.encoder(VOCABULARY).tokenizer, 0
    want = sorted(((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == tokens.crc32(np.array(r.ids))
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), x) for i, x in want)


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_token_files(documents(spark, []), str(tmp_path / "t"))
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=12), st.integers(1, 50_000), st.integers(0, 5))
def test_records_decode_to_what_was_encoded(lengths, symbols, seed):
    r = np.random.default_rng(seed)
    ids = (r.integers(0, symbols, sum(lengths)) ** 2 // symbols).astype(np.int32)
    record = token_files.encode_record(np.arange(len(lengths)), np.array(lengths), ids, 300)
    docs, sizes, back = token_files.decode_record(record)
    assert docs.tolist() == list(range(len(lengths))) and sizes.tolist() == lengths and (back == ids).all()


def test_damaged_records_are_noticed():
    ids = np.random.default_rng(1).integers(0, 99, 5000).astype(np.int32)
    record = bytearray(token_files.encode_record(np.array([1]), np.array([5000]), ids, 1 << 16))
    record[-40] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_record(bytes(record))


def test_packing_places_every_piece_once(spark):
    rows = invented(4)
    got = packing.pack_documents(documents(spark, rows), capacity=64, group=50, with_ids=True).collect()
    tokenizer = tokens.encoder(VOCABULARY).tokenizer
    want = sorted((str(i), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == tokens.crc32(np.array(r.ids)) and r.length == len(r.ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    once = {i: rs for i, rs in by_doc.items() if i != 3}
    for i, rs in once.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs))) and all(r.length == 64 for r in rs[1:])
        assert (str(i), [x for r in rs for x in r.ids]) in want
    assert len(by_doc) == len({i for i, _ in rows})
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 64) + 3


def test_local_search_empties_bins_best_fit_leaves():
    lengths = np.array([6, 6, 5, 5, 5, 3])  # best fit: 6, 6 and 5, 5, 5, 3 apart; capacity 10 and 30 in all
    bins = packing.improve(packing.best_fit(lengths, 15), lengths, 15)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == list(range(6))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60))
def test_search_never_needs_more_bins(lengths):
    lengths = np.array(lengths)
    first = packing.best_fit(lengths, 30)
    bins = packing.improve([list(b) for b in first], lengths, 30)
    assert len(bins) <= len(first) and sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 30 for b in bins)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0
