"""Token ids of whole texts by the tokenizers library, which encodes each distinct chunk of text once a worker.

A byte-level BPE never merges across pre-tokens. Its pre-tokens never reach from the end of a word (a run of other than
white space) into the white space after it, nor from a letter or digit to a mark of ASCII, from such a mark other than
an apostrophe to a letter or digit, or from letters to digits and back. So a text cut there has the ids of its chunks in
a row, and most chunks are plain words. Only characters of which nobody doubts what they are decide on a cut: where one
is doubtful, a chunk is longer. Cuts are found in the bytes of all texts of a batch side by side, and Arrow numbers the
chunks that are equal. They are remembered by their text itself, never by a hash of it. New words without white space
inside go to the library as lines of a text, because a line's end is a pre-token by itself there.

A text with a special token's string is encoded whole; so is every text where the tokenizer isn't of that kind.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sourcelens.llm import common

#: Chunks and characters of one chunk that a worker remembers at most; new words in a text for the library.
CACHE_MOST, CHUNK_MOST, LINES = 800_000, 64, 64
_WHITE, _MARK, _QUOTE, _LETTER, _DIGIT, _HIGH, _END = range(1, 8)
#: A word that is a line: its first and last characters are no white space but for one space before it, and it holds no line's end.
_LINE = re.compile(" ?[!-~\xa1-\u167f\u2010-\u2027\u3001-\ud7ff]+")
#: UTF-8 of characters beyond ASCII that are white space, or of which Python and the library may disagree whether they are.
_UNSURE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)])
_TOKENIZERS: dict[str, "Encoder"] = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of a byte, and whether a chunk ends between bytes of two classes, at first * 8 + second."""
    of, ends = np.zeros(256, np.uint8), np.zeros(64, np.uint8)
    of[0x21:0x7F], of[0x80:] = _MARK, _HIGH
    for chars, kind in (("\t\v\f\r ", _WHITE), ("\n", _END), ("'", _QUOTE), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", _LETTER), ("0123456789", _DIGIT)):
        of[[ord(c) for c in chars]] = kind
    for first, second in ((_MARK, (_WHITE, _END, _LETTER, _DIGIT)), (_QUOTE, (_WHITE, _END)), (_LETTER, (_WHITE, _END, _MARK, _QUOTE, _DIGIT)), (_DIGIT, (_WHITE, _END, _MARK, _QUOTE, _LETTER))):
        ends[[first * 8 + k for k in second]] = 1
    ends[[_HIGH * 8 + k for k in (_WHITE, _END, _MARK, _QUOTE)]] = 2  # if the character before is known
    ends[[_END * 8 + k for k in (_MARK, _QUOTE, _LETTER, _DIGIT)]] = 3  # if the line's end is no run of white space
    return of, ends


_CLASS, _ENDS = _classes()
_LONE = np.isin(np.arange(8), (_MARK, _QUOTE, _LETTER, _DIGIT))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts that lie between offsets, and where the last one ends."""
    kinds = _CLASS[data]
    at = np.zeros(len(data) + 1, np.uint8)
    if len(data):
        at[1:-1] = _ENDS[kinds[:-1] << 3 | kinds[1:]]
    asked = np.flatnonzero(at == 2)
    if len(asked):
        last, before = data[asked - 1], data[asked - 2]  # a text's first character beyond ASCII has two bytes at least
        two = before.astype(np.int64) << 8 | last
        three = np.where(before < 0xC0, data[np.maximum(asked - 3, 0)].astype(np.int64) << 16 | two, two)
        letter = ((before >= 0xC3) & (before <= 0xC9) & (two != 0xC397) & (two != 0xC3B7)) | (before == 0xD0) | (before == 0xD1)
        at[asked] = np.where((kinds[asked] == _WHITE) | (kinds[asked] == _END), ~np.isin(three, _UNSURE), letter)
    asked = np.flatnonzero(at == 3)
    at[asked] = _LONE[kinds[asked - 2]]
    at[offsets] = 1
    return np.flatnonzero(at)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        self.chunked = kind["normalizer"] is None and kind["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        self.line = self.library(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.long: list[str] = []
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.batches = np.zeros(0, np.int32)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row (int32), and len+1 offsets into them; null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole = np.full(len(column), not self.chunked)
        for s in self.special:
            whole |= np.asarray(pc.fill_null(pc.match_substring(column, s), False))
        if not whole.any():
            return self._chunked(column)
        made, ends = self._chunked(column.filter(pa.array(~whole)))
        lengths = np.zeros(len(column), np.int64)
        lengths[~whole] = np.diff(ends)
        ids = self.library([t or "" for t in column.filter(pa.array(whole)).to_pylist()])
        lengths[whole] = list(map(len, ids))
        of = np.repeat(whole, lengths)
        out = np.zeros(len(of), np.int32)
        out[~of] = made
        out[of] = np.fromiter(chain.from_iterable(ids), np.int32)
        return out, np.concatenate([[0], np.cumsum(lengths)])

    def _chunked(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(column):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        data, offsets = common.flat_bytes(column)
        begins = cuts(data, offsets)
        made, ends = self._ids(pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)]))
        return made, ends[np.searchsorted(begins, offsets)]

    def _ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids in a row, and len+1 offsets into them."""
        coded = chunks.dictionary_encode()
        own = _strings(coded.dictionary)
        if len(self.number) > CACHE_MOST:
            self._trim()
        got = list(map(self.number.get, own))
        if None in got:
            missing = [k for k, n in enumerate(got) if n is None]
            self._add([own[k] for k in missing])
            for k in missing:
                got[k] = self.number[own[k]]
        numbers = np.array(got, np.int64)
        self.batches[numbers] += 1
        lists = pa.LargeListArray.from_arrays(self.begin, self.flat).take(pa.array(numbers[np.asarray(coded.indices)]))
        if len(self.long):
            for c in self.long:
                del self.number[c]
            keep = len(self.batches) - len(self.long)
            self.flat = self.flat[: self.begin[keep]]
            self.begin, self.batches, self.long = self.begin[: keep + 1], self.batches[:keep], []
        return np.asarray(lists.values), np.asarray(lists.offsets)

    def _trim(self) -> None:
        """Forget all chunks but those met in most batches, half as many as may be kept at most."""
        least = max(1, int(np.sort(self.batches)[-(CACHE_MOST // 2) - 1]))
        keep = np.flatnonzero(self.batches > least)
        chunks, lists = list(self.number), pa.LargeListArray.from_arrays(self.begin, self.flat).take(pa.array(keep))
        self.number = {chunks[k]: n for n, k in enumerate(keep.tolist())}
        self.begin, self.flat, self.batches = np.asarray(lists.offsets), np.asarray(lists.values), self.batches[keep] >> 1

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words that are lines, in a row, and how many each has."""
        flat = np.fromiter(chain.from_iterable(self.library(["\n".join([*words[k : k + LINES], ""]) for k in range(0, len(words), LINES)])), np.int32)
        ends = flat == self.line[0]
        if np.count_nonzero(ends) != len(words):
            return self._each(words)
        return flat[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.library(words)
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _add(self, new: list[str]) -> None:
        self.long = [c for c in new if len(c) > CHUNK_MOST]  # come last, and go again once used
        new = [c for c in new if len(c) <= CHUNK_MOST]
        lines = [c for c in new if _LINE.fullmatch(c)] if len(self.line) == 1 else []
        known = set(lines)
        rest = [c for c in new if c not in known] + self.long
        made = [self._lines(lines), self._each(rest)]
        count = np.concatenate([c for _, c in made])
        self.number.update(zip(chain(lines, rest), range(len(self.batches), len(self.batches) + len(count)), strict=True))
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in made)])
        self.begin = np.append(self.begin, len(self.flat) - count.sum() + np.cumsum(count))
        self.batches = np.append(self.batches, np.zeros(len(count), np.int32))


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist(): splitting one string is quicker than making each."""
    out = pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), pa.scalar("\0", column.type))[0].as_py().split("\0")
    return out if len(out) == len(column) else column.to_pylist()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
