"""Token counts by compiled finite-state transducers (operator 12).

A byte-level BPE tokenizer is compiled, in each worker, into two deterministic transducers:

- The splitter reads classes of characters and says where the tokenizer's pattern begins a new word. Its eleven states
  hold what the pattern looks back or ahead at (a lone apostrophe, white space whose last character may belong to the
  next word). Texts are cut into chunks of equal length; every chunk's map from each state to the state after it is
  computed side by side, a parallel prefix scan composes these maps, and with the states so known all chunks emit their
  boundaries side by side.
- The counter reads a word's bytes. BPE gives a byte string the only sequence of tokens in which each token is made by
  the merges from its own bytes and no two neighbours would merge otherwise; so the subsets of (last token, begun token)
  that are possible after a prefix determine the rest. Its states are these subsets, found when first met, and each
  transition says by how many tokens it changes the count. Words run through it side by side, one byte a step.

Nothing is shuffled and no list of ids is made. What a special token's string does inside a text, and what class a
character belongs to, the library itself is asked. Vocabularies that are not byte-level BPE are counted by the library.

Null texts count as empty: no bytes, no tokens. Rows that share a doc_id, repeated rows and rows without an id give a row
each. An empty table gives none. Very long texts are worked on in windows that end before white space, so memory grows
with the longest stretch without any. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common, tokens

#: Characters of a chunk of the splitter, bytes of a window, words that run side by side, states that a worker holds.
CHUNK, WINDOW, LANES, STATES_MOST = 256, 2 << 20, 1 << 15, 250_000
#: Separates texts: a byte that UTF-8 never has.
BREAK = 0xFF
SPACE, WHITE, MARK, LETTER, DIGIT, OTHER, END, STMD, RV, E, EL, UNKNOWN = range(12)
_FRESH, _IN_LETTERS, _IN_DIGITS, _IN_OTHER, _ONE_SPACE, _SPACES, _ONE_WHITE, _WHITES, _QUOTE, _QUOTE_RV, _QUOTE_L = range(11)
#: A word begins at this character; one began at the character before.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted flags, at state * 16 + class."""
    letters = (LETTER, STMD, RV, E, EL)
    into = {SPACE: _ONE_SPACE, WHITE: _ONE_WHITE, MARK: _QUOTE, DIGIT: _IN_DIGITS, OTHER: _IN_OTHER, **dict.fromkeys(letters, _IN_LETTERS)}
    to, flags = np.zeros((16, 16), np.uint8), np.zeros((16, 16), np.uint8)
    white = {SPACE: _SPACES, WHITE: _WHITES}
    for state in range(11):
        for kind in (*into, END):
            nxt, flag = into.get(kind, _FRESH), HERE
            if kind == END:
                flag = 0
            elif state == _IN_LETTERS and kind in letters or state == _IN_DIGITS and kind == DIGIT:
                flag = 0
            elif state == _IN_OTHER and kind in (OTHER, MARK):
                nxt, flag = _IN_OTHER, 0
            elif state in (_ONE_SPACE, _SPACES, _ONE_WHITE, _WHITES):
                if kind in white:
                    nxt, flag = white[kind], 0
                elif state in (_ONE_SPACE, _SPACES):  # the last space belongs to the word
                    nxt, flag = _IN_OTHER if kind == MARK else nxt, BEFORE * (state == _SPACES)
                else:
                    flag = HERE | BEFORE * (state == _WHITES)
            elif state == _QUOTE:
                if kind == STMD:
                    nxt, flag = _FRESH, 0
                elif kind in (RV, EL):
                    nxt, flag = (_QUOTE_RV if kind == RV else _QUOTE_L), 0
                elif kind in (OTHER, MARK):
                    nxt, flag = _IN_OTHER, 0
            if state in (_QUOTE_RV, _QUOTE_L):
                if kind == (E if state == _QUOTE_RV else EL):
                    nxt, flag = _FRESH, 0
                else:  # no contraction: the letter after the apostrophe began a word
                    flag = BEFORE | (0 if kind in letters or kind == END else HERE)
            to[state, kind], flags[state, kind] = nxt, flag
    return to.ravel(), flags.ravel()


class Splitter:
    def __init__(self, pieces):
        """pieces: how many words the library makes of a short string."""
        self.pieces = pieces
        self.to, self.flags = _splitter()
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        for own, kind in (("stmd", STMD), ("rv", RV), ("e", E), ("l", EL), (" ", SPACE), ("'", MARK)):
            self.kinds[[ord(c) for c in own]] = kind

    def classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of every character, and where its bytes begin."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[at]
        code = first.astype(np.int32)
        for least, most, size in ((0xC0, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF7, 4)):
            here = np.flatnonzero((first >= least) & (first <= most))
            value = first[here].astype(np.int32) & (0x7F >> size)
            for k in range(1, size):
                value = value << 6 | data[at[here] + k] & 0x3F
            code[here] = value
        kinds = self.kinds[code]
        new = np.unique(code[(kinds == UNKNOWN) & (first != BREAK)])
        for c in new.tolist():
            self.kinds[c] = next((kind for mate, kind in (("a", LETTER), ("1", DIGIT), ("!", OTHER)) if self.pieces(mate + chr(c)) == 1), WHITE)
        if len(new):
            kinds = self.kinds[code]
        kinds[first == BREAK] = END
        return kinds, at

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length, in bytes, of every word. data ends with BREAK."""
        kinds, at = self.classes(data)
        n = len(kinds)
        rows = -(-n // CHUNK)
        columns = np.full(rows * CHUNK, END, np.uint8)
        columns[:n] = kinds
        columns = np.ascontiguousarray(columns.reshape(rows, CHUNK).T)
        maps = np.tile(np.arange(11, dtype=np.uint8), (rows, 1))
        for own in columns:  # every chunk's map, a character a step
            maps = self.to[maps << 4 | own[:, None]]
        reach = 1
        while reach < rows:  # parallel prefix scan: maps[i] becomes the map of all chunks up to i
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
            reach *= 2
        state = np.append(np.uint8(_FRESH), maps[:-1, _FRESH])
        flags = np.empty_like(columns)
        for j, own in enumerate(columns):
            key = state << 4 | own
            flags[j], state = self.flags[key], self.to[key]
        flags = flags.T.ravel()
        begins = (flags[:n] & HERE) > 0
        begins[:-1] |= (flags[1:n] & BEFORE) > 0
        stops = np.flatnonzero(begins | (kinds == END))
        place = at[stops]
        own = begins[stops[:-1]]
        return place[:-1][own], np.diff(place)[own]


class Counter:
    """The counter's states and transitions, found as they are met; more than STATES_MOST are forgotten but for those in use."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[int, int, int]]):
        """merges: pairs of ids and the id they make, in order of rank."""
        self.merge = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        self.bytes = {i: raw for raw, i in vocabulary.items()}
        self.single = [vocabulary[bytes([b])] for b in range(256)]
        self.next: dict[int, int] = {}
        self.token = [-1]
        for raw, i in vocabulary.items():
            node = 0
            for b in raw:
                key = node << 8 | b
                node = self.next.get(key) or self.next.setdefault(key, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.inner = bytearray(len(self.token))
        for key in self.next:
            self.inner[key >> 8] = 1
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.column, self.byte = np.zeros(256, np.int64), []  # bytes that texts hold have a column of the tables
        self.width = 32
        self.forget(np.zeros(0, np.int32))

    def forget(self, used: np.ndarray) -> np.ndarray:
        """Drop all states but the first and those used; the numbers that these have now."""
        kept, flat = np.unique(used, return_inverse=True)
        items = [self.items[s] for s in kept.tolist()]
        self.items, self.number = [], {}
        self.to, self.change = np.full((4096, self.width), -1, np.int32), np.zeros((4096, self.width), np.int8)
        if len(self.neighbours) > 2_000_000:
            self.neighbours = {}
        self._state(((-1, 0, 0),))
        return np.array([self._state(i) for i in items], np.int32)[flat] if len(items) else used

    def _state(self, items: tuple) -> int:
        if items not in self.number:
            if len(self.items) == len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
            self.number[items] = len(self.items)
            self.items.append(items)
        return self.number[items]

    def _widen(self, data: np.ndarray) -> None:
        """Give every byte of data a column."""
        for b in sorted(set(np.flatnonzero(np.bincount(data, minlength=256)).tolist()).difference(self.byte)):
            self.column[b] = len(self.byte)
            self.byte.append(b)
        if len(self.byte) > self.width:
            while len(self.byte) > self.width:
                self.width *= 2
            more = ((0, 0), (0, self.width - self.to.shape[1]))
            self.to, self.change = np.pad(self.to, more, constant_values=-1), np.pad(self.change, more)

    def merged(self, raw: bytes) -> list[int]:
        """Ids by the merges themselves, least rank first, leftmost of equals."""
        ids = [self.single[b] for b in raw]
        while len(ids) > 1:
            rank, at = min((self.merge.get(pair, (1 << 60, 0))[0], k) for k, pair in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids

    def follows(self, left: int, token: int) -> bool:
        """Whether token stands as it is after left, or at a word's begin where left is -1."""
        got = self.neighbours.get((left, token))
        if got is None:
            raw, want = (self.bytes[token], [token]) if left < 0 else (self.bytes[left] + self.bytes[token], [left, token])
            got = self.neighbours[left, token] = self.merged(raw) == want
        return got

    def _step(self, state: int, byte: int) -> None:
        """Find one transition. Items: last whole token, trie node of the begun one, tokens up to there less those of the prefix."""
        begun, last, count = [], None, 0
        for left, node, k in self.items[state]:  # from the longest begun token to the shortest
            node = self.next.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if last is None and token >= 0 and self.follows(left, token):
                last, count = token, k + 1
            if self.inner[node]:
                begun.append((left, node, k))
        target = self._state((*((left, node, k - count) for left, node, k in begun), (last, 0, 0)))
        self.to[state, self.column[byte]], self.change[state, self.column[byte]] = target, count

    def counts(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        self._widen(data)
        out = np.zeros(len(begin), np.int64)
        order = np.argsort(-length, kind="stable")
        for k in range(0, len(order), LANES):
            own = order[k : k + LANES]
            out[own] = self._lanes(data, begin[own], length[own])
        return out

    def _lanes(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words of falling length side by side, a byte a step."""
        state, total = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int64)
        left = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # words longer than j
        for j, live in enumerate(left.tolist()):
            if len(self.items) > STATES_MOST:
                state[:live] = self.forget(state[:live])
            key = state[:live].astype(np.int64) * self.width + self.column[data[begin[:live] + j]]
            to = self.to.ravel()[key]
            if (to < 0).any():
                for missing in np.unique(key[to < 0]).tolist():
                    self._step(missing // self.width, self.byte[missing % self.width])
                to = self.to.ravel()[key]
            total[:live] += self.change.ravel()[key]
            state[:live] = to
        return total


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Token counts of many texts at once by one vocabulary file."""

    def __init__(self, path: str):
        self.compiled = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        self.library = lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
        said = json.loads(own.to_str())
        model, split, added = said["model"], said["pre_tokenizer"] or {}, said["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = said["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        if not plain or not level or any(t["single_word"] or t["lstrip"] or t["rstrip"] or len(t["content"].split()) != 1 for t in added):
            return
        self.compiled, byte_of = True, _byte_of()
        raw = {t: bytes(byte_of[c] for c in t) for t in model["vocab"] if all(c in byte_of for c in t)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.counter = Counter({raw[t]: i for t, i in model["vocab"].items() if t in raw}, [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs])
        self.splitter = Splitter(lambda s: len(own.pre_tokenizer.pre_tokenize_str(s)))
        names = sorted((t["content"].encode() for t in added), key=lambda c: (-len(c), c))
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None

    def _window(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of the texts that end at ends, in a row."""
        joined = np.insert(data, ends, np.uint8(BREAK))
        ends = ends + np.arange(len(ends))
        out = np.zeros(len(ends), np.int64)
        if self.special:
            for m in self.special.finditer(joined.tobytes()):
                joined[m.start() : m.end()] = BREAK
                out[np.searchsorted(ends, m.start())] += 1
        begin, length = self.splitter.words(joined)
        counts = self.counter.counts(joined, begin, length)
        np.add.at(out, np.searchsorted(ends, begin), counts)
        return out

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a string column; null counts as empty."""
        if not self.compiled:
            return np.array(self.library([t or "" for t in column.to_pylist()]), np.int64).reshape(len(column))
        data, offsets = common.flat_bytes(column)
        if len(data) <= 2 * WINDOW or len(column) > 1:
            return self._window(data, offsets[1:])
        total, begin = 0, 0  # one long text
        while begin < len(data):
            stop = _stop(data, begin)
            total += int(self._window(data[begin:stop], np.array([stop - begin]))[0])
            begin = stop
        return np.array([total])


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _stop(data: np.ndarray, begin: int) -> int:
    """The last place of a window before which a word ends and white space begins, or the first one after it, or the end.

    A word always ends there, whatever follows: what is split from its rest is split alike. A special token's string has no white space.
    """
    at = begin
    while at + WINDOW < len(data):
        white = _WHITE[data[at : at + WINDOW]]
        found = np.flatnonzero(white[1:] & ~white[:-1] & (data[at : at + WINDOW - 1] < 0x80))
        if len(found):
            return at + int(found[-1]) + 1
        at += WINDOW - 1
    return len(data)


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer for a vocabulary file."""
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", WINDOW):
                column = piece.column("text")
                _, offsets = common.flat_bytes(column)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(transducer(vocabulary).count(column))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, limit: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens). vocabulary: a .json or .model file."""
    counted = common.keyed(docs).mapInArrow(_count(vocabulary or tokens.default_vocabulary()), "doc_id long, n_bytes long, n_tokens long")
    return common.unkeyed(counted.withColumn("over_limit", F.col("n_tokens") > limit))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
