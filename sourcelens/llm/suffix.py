"""Suffix-array deduplication of repeated byte strings (operator 1).

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Strings are
judged on the input, so every distinct string needs only the least doc_id it starts in.

1. Documents are dealt into blocks. The string at each place has an anchor: the k-gram with the least hash in it. So
   equal strings have equal anchors, and consecutive strings with one anchor make a context of at most 2*length-k bytes.
2. Blocks send their distinct anchor hashes to hash buckets, which answer which ones more than one document has.
3. Blocks send the distinct contexts of shared anchors, each with its least doc_id. A bucket sorts the suffixes of its
   contexts by two-stage sorting: those smaller than their successors are sorted directly, the others follow from
   scans over the first-byte buckets. Adjacent common prefixes of `length` bytes or more make classes of equal strings,
   and each class gets its least doc_id.
4. Blocks get a bit mask for each context and remove the bytes.

A block or bucket is of bounded size, and a string or document that is repeated without end reaches a bucket once from
each block. A block works on the buckets that it has something for only, and writes one message to each: messages are no
more than contexts, however many blocks and buckets there are. Null and empty texts come back with nothing removed; a
text of any length is one document of one block. Rows with equal doc_id, or without one, don't remove from each other,
and are dealt by their texts too; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

LENGTH, GRAM = 50, 24
_U = np.uint64
_C = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 24 bytes from each place on, built by doubling."""
    h = (data.astype(_U) + _U(1)) * _C[0]
    h ^= h >> _U(31)
    eight = None
    for step, c in ((1, 0), (2, 1), (4, 2), (8, 3)):
        h = h[:-step] * _C[c] + h[step:] if len(h) > step else h[:0]
        h ^= h >> _U(29)
        if step == 4:
            eight = h
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = h[:n] * _C[4] + eight[16 : 16 + n]
    h ^= h >> _U(32)
    h *= _C[1]
    return h ^ (h >> _U(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of width hashes, where in it the first least one is."""
    value, place, done = h, np.zeros(len(h), np.uint8), 1
    while done < width:
        step = min(done, width - done)
        a, b = value[:-step], value[step:]
        left = a <= b
        value = np.where(left, a, b)
        place = np.where(left, place[:-step], place[step:] + np.uint8(step))
        done += step
    return place


def _spread(h: np.ndarray) -> np.ndarray:
    """One to one; least hashes crowd at the low end, and buckets are ranges."""
    h = (h ^ (h >> _U(32))) * _C[4]
    return h ^ (h >> _U(32))


def contexts(data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first string and number of strings of each context of the concatenated texts."""
    out = []
    stop, docs = 0, len(offsets) - 1
    while stop < docs:
        start = stop
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + chunk, "right")) - 1)
        base, part = offsets[start], data[offsets[start] : offsets[stop]]
        strings = len(part) - LENGTH + 1
        if strings <= 0:
            continue
        h = gram_hashes(part)
        anchor = np.arange(strings) + _least(h, LENGTH - GRAM + 1)[:strings]
        valid = np.ones(strings + LENGTH, bool)
        for k in range(1, LENGTH):  # strings that would cross the end of a document
            at = offsets[start + 1 : stop + 1] - base - k
            valid[at[at >= 0]] = False
        ends = np.zeros(strings + 1, bool)
        inner = offsets[start + 1 : stop] - base
        ends[inner[inner < strings]] = True
        new = np.ones(strings, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ends[1:strings] | ~valid[: strings - 1]
        first = np.flatnonzero(new & valid[:strings])
        edge = np.append(np.flatnonzero(new), strings)
        count = edge[np.searchsorted(edge, first, "right")] - first
        bad = np.append(np.flatnonzero(~valid[:strings]), strings)
        count = np.minimum(count, bad[np.searchsorted(bad, first)] - first)
        out.append((_spread(h[anchor[first]]), first + base, count))
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


WIDE = 2 * LENGTH - GRAM  # a context's bytes at most
_ROW = np.dtype(f"S{WIDE + 1}")


def _rows_of(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Contexts as fixed-width rows: number of strings, then the bytes, padded with zeros."""
    out = np.zeros((len(first), WIDE + 1), np.uint8)
    out[:, 0] = count
    size = count + LENGTH - 1
    for k in range(WIDE):
        on = np.flatnonzero(size > k) if k >= LENGTH else slice(None)
        out[on, k + 1] = data[first[on] + k]
    return out


def two_stage_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Suffixes marked in wanted, in order of their first LENGTH characters. text: 0 ends a context, else byte + 1.

    A wanted suffix that is larger than its successor needs the successor, up to the next one that is smaller than its
    own; the caller marks those too.
    """
    n = len(text)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # last place of each run of one character
    end = change[np.searchsorted(change, np.arange(n))]
    after = np.where(end + 1 < n, text[np.minimum(end + 1, n - 1)], 0)
    small = (text < after) | (text == 0)  # smaller than its successor
    direct = np.flatnonzero(wanted & small)
    keys = np.zeros((len(direct), LENGTH), np.uint8)
    live = np.ones(len(direct), bool)
    for k in range(LENGTH):
        c = text[np.minimum(direct + k, n - 1)]
        live &= (c > 0) & (direct + k < n)
        keys[:, k] = np.where(live, c - 1, 0)
    direct = direct[np.argsort(keys.view(f"S{LENGTH}").ravel(), kind="stable")]
    del keys
    head = text[direct]
    split = np.searchsorted(head, np.arange(258)) if (head[1:] >= head[:-1]).all() else None
    if split is None:  # a context that ends sorts as byte 0 above, but before it here
        direct = direct[np.argsort(head, kind="stable")]
        split = np.searchsorted(text[direct], np.arange(258))
    induced = wanted & ~small
    queues: list[list[np.ndarray]] = [[] for _ in range(258)]
    order = []
    for c in range(257):
        larger = queues[c]
        queues[c] = []
        wave = np.concatenate(larger) if larger else np.zeros(0, np.int64)
        row = []
        while len(wave):
            row.append(wave)
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (text[before] == c)]
        row.append(direct[split[c] : split[c + 1]])
        row = np.concatenate(row)
        order.append(row)
        before = row[row > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            heads = text[before]
            before = before[np.argsort(heads, kind="stable")]
            heads = text[before]
            cut = np.append(np.flatnonzero(np.append(True, heads[1:] != heads[:-1])), len(heads))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                queues[heads[a]].append(before[a:b])
    return np.concatenate(order)


def common_prefixes(data: np.ndarray, order: np.ndarray, tile: int = 1 << 17) -> np.ndarray:
    """Of each string in order, the length of the prefix it shares with the one before it, LENGTH at most."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), tile):
        now = order[a : a + tile]
        prev = order[a - 1 : a - 1 + len(now)]
        run = np.full(len(now), LENGTH, np.int64)
        open_rows = np.arange(len(now))
        for k in range(LENGTH):
            same = data[now[open_rows] + k] == data[prev[open_rows] + k]
            run[open_rows[~same]] = k
            open_rows = open_rows[same]
            if not len(open_rows):
                break
        out[a : a + len(now)] = run
    return out


def least_starts(rows: np.ndarray, least: np.ndarray) -> list[np.ndarray] | tuple[np.ndarray, np.ndarray]:
    """For distinct contexts and the least doc_id of each: per string of each context, the least doc_id over all of them.

    Returns the values in a row, and len+1 offsets into them.
    """
    count = rows[:, 0].astype(np.int64)
    size = count + LENGTH - 1
    at = np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(len(rows)), size + 1)
    inside = np.arange(len(owner)) - at[owner]
    data = np.append(rows[:, 1:], np.zeros((len(rows), 1), np.uint8), axis=1)[owner, inside]
    text = np.where(inside < size[owner], data.astype(np.int16) + 1, 0).astype(np.int16)
    string = inside < count[owner]
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    end = change[np.searchsorted(change, np.arange(len(text)))]
    after = np.where(end + 1 < len(text), text[np.minimum(end + 1, len(text) - 1)], 0)
    small = np.flatnonzero((text < after) | (text == 0))
    wanted = string.copy()
    last = at + count - 1  # from the last string on, up to the next suffix that is smaller than its successor
    until = small[np.searchsorted(small, last)]
    delta = np.zeros(len(text) + 1, np.int32)
    np.add.at(delta, last, 1)
    np.add.at(delta, until + 1, -1)
    wanted |= np.cumsum(delta[:-1]) > 0
    order = two_stage_order(text, wanted)
    order = order[string[order]]
    starts = np.flatnonzero(common_prefixes(data, order) < LENGTH)
    value = np.minimum.reduceat(least[owner[order]], starts)
    by_place = np.zeros(len(text), np.int64)
    by_place[order] = np.repeat(value, np.diff(np.append(starts, len(order))))
    return by_place[string], np.append(0, np.cumsum(count))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets)) >> _U(32)


class Block:
    """The documents of a block in order, its contexts, and what its buckets are told."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        ids = np.asarray(rows.column("doc_id"))
        rows = rows.take(pa.array(np.argsort(ids, kind="stable")))
        self.ids = np.asarray(rows.column("doc_id"))
        column = rows.column("text").combine_chunks()
        self.data, self.offsets = common.flat_bytes(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        self.hash, self.first, self.count = contexts(self.data, self.offsets)
        self.doc = self.ids[np.searchsorted(self.offsets, self.first, "right") - 1]
        self.anchors, self.of = np.unique(self.hash, return_inverse=True)

    def shared_anchors(self) -> np.ndarray:
        """Which anchors two documents of this very block have."""
        low, high = np.full(len(self.anchors), np.iinfo(np.int64).max), np.full(len(self.anchors), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, self.doc)
        np.maximum.at(high, self.of, self.doc)
        return low < high

    def keep(self, told: pa.Table, buckets: int) -> None:
        """Only contexts of shared anchors stay, and equal ones become one: sorted by anchor, then by bytes."""
        on = _answered(told, 0, _spans(self.anchors, buckets), np.uint8)
        pick = on.astype(bool)[self.of]
        self.hash, self.first, self.count, self.doc = self.hash[pick], self.first[pick], self.count[pick], self.doc[pick]
        rows = _rows_of(self.data, self.first, self.count)
        order = np.argsort(self.hash, kind="stable")
        h = self.hash[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        tied = ~new
        tied[:-1] |= ~new[1:]  # bytes are compared only among contexts of one anchor
        if tied.any():
            some = order[tied]
            key = np.concatenate([self.hash[some].astype(">u8").view(np.uint8).reshape(-1, 8), rows[some]], axis=1)
            order[tied] = some[np.argsort(key.view(f"S{WIDE + 9}").ravel(), kind="stable")]
            later = np.flatnonzero(~new)
            new[later[(rows[order[later]] != rows[order[later - 1]]).any(axis=1)]] = True
        self.context = np.empty(len(order), np.int64)
        self.context[order] = np.cumsum(new) - 1
        unique = order[new]
        self.rows, self.row_spans = rows[unique], _spans(self.hash[unique], buckets)
        self.least = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.context, self.doc)


def _spans(sorted_hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that have hashes, and where each one's begin, with the length at the end."""
    bucket = _bucket(sorted_hashes, buckets).astype(np.int32)
    edges = common.group_starts([bucket])
    return bucket[edges[:-1]], edges


def _messages(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary value for each run of values between edges; edges begin at 0."""
    values = np.ascontiguousarray(values)
    offsets = (edges * (values.nbytes // max(1, len(values)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _sent(rows: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of messages in a row, and where each message's begin, with the length at the end."""
    one = rows.column(column).combine_chunks()
    data, offsets = common.flat_bytes(one.chunk(0) if isinstance(one, pa.ChunkedArray) else one)
    return np.frombuffer(data.tobytes(), kind), offsets // np.dtype(kind).itemsize


def _answered(told: pa.Table, kind: int, spans: tuple[np.ndarray, np.ndarray], of: type) -> np.ndarray:
    """What buckets said of each value of spans; 0 where they said nothing."""
    out = np.zeros(spans[1][-1], of)
    own = told.filter(pa.array(np.asarray(told.column("kind")) == kind))
    if own.num_rows:
        values, edges = _sent(own, "data", of)
        size = np.diff(edges)
        first = spans[1][np.searchsorted(spans[0], np.asarray(own.column("bucket")))]
        out[np.repeat(first - edges[:-1], size) + np.arange(len(values))] = values
    return out


def _send(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def suffix_dedup(docs: DataFrame, block_bytes: int = 6 << 20, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_kept adds the remaining bytes and the spans."""
    blocks = common.parts_for(common.text_bytes(docs), block_bytes)
    buckets = 8 * blocks  # of some 50,000 contexts each at most
    base = common.keyed(docs).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")

    def anchors(key, rows):
        block = Block(rows)
        own, edges = _spans(block.anchors, buckets)
        return pa.table([pa.array(own), pa.array(np.full(len(own), key[0].as_py(), np.int32)), _messages(block.anchors, edges), _messages(block.shared_anchors().view(np.uint8), edges)], names=["bucket", "block", "anchors", "multi"])

    def shared(key, rows):
        every, edges = _sent(rows, "anchors", np.uint64)
        many, _ = _sent(rows, "multi", np.uint8)
        _, of, count = np.unique(every, return_inverse=True, return_counts=True)
        on = count > 1
        np.logical_or.at(on, of, many.astype(bool))
        on = on[of].view(np.uint8)
        n = rows.num_rows
        out = pa.table([rows.column("block"), pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(np.zeros(n, np.int32)), _messages(on, edges)], names=["block", "bucket", "kind", "data"])
        return out.filter(pa.array(np.maximum.reduceat(on, edges[:-1]) > 0))

    def passages(key, rows, told):
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        if not rows.num_rows or not told.num_rows:
            return _send([], ["bucket", "block", "rows", "least"], kinds)
        block = Block(rows)
        block.keep(told, buckets)
        own, edges = block.row_spans
        pack = zstandard.ZstdCompressor(level=3).compress
        packed = [pack(block.rows[x:y].tobytes()) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.table([pa.array(own), pa.array(np.full(len(own), key[0].as_py(), np.int32)), pa.array(packed, pa.binary()), _messages(block.least, edges)], names=["bucket", "block", "rows", "least"])

    def sort(key, rows):
        own, edges = _sent(rows, "least", np.int64)
        unpack = zstandard.ZstdDecompressor().decompress
        every = np.frombuffer(b"".join(map(unpack, rows.column("rows").to_pylist())), _ROW)
        unique, of = np.unique(every, return_inverse=True)
        least = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(least, of, own)
        value, offsets = least_starts(np.ascontiguousarray(unique).view(np.uint8).reshape(-1, WIDE + 1), least)
        lower = (value < np.repeat(least, np.diff(offsets))).astype(_U)
        bit = _U(1) << (np.arange(len(value)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(_U)
        mask = np.bitwise_or.reduceat(lower * bit, offsets[:-1]).astype("<u4")
        out = np.where(least[of] < own, np.uint32(0xFFFFFFFF), mask[of]).astype("<u4")
        n = rows.num_rows
        return pa.table([rows.column("block"), pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(np.ones(n, np.int32)), _messages(out, edges)], names=["block", "bucket", "kind", "data"])

    def remove(key, rows, told):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "spans"] * with_kept]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))][: 1 + 2 * with_kept]
        if not rows.num_rows:
            return _send([], names, kinds)
        block = Block(rows)
        gone = np.zeros(len(block.data) + 1, bool)
        if told.num_rows:
            block.keep(told, buckets)
            mask = _answered(told, 1, block.row_spans, np.uint32)
            mask = np.where(block.doc > block.least[block.context], np.uint32(0xFFFFFFFF), mask[block.context])
            place = np.repeat(block.first, block.count) + np.arange(block.count.sum()) - np.repeat(np.cumsum(block.count) - block.count, block.count)
            on = (np.repeat(mask, block.count) >> (place - np.repeat(block.first, block.count)).astype(np.uint32)) & np.uint32(1)
            starts = place[on.astype(bool)]
            delta = np.zeros(len(block.data) + 1, np.int8)
            delta[starts] += 1
            delta[starts + LENGTH] -= 1
            gone = np.cumsum(delta, dtype=np.int32) > 0
        out = []
        for i, (a, b) in zip(block.ids.tolist(), zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True), strict=True):
            off = gone[a:b]
            kept = block.data[a:b][~off].tobytes()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], off.view(np.int8), [0]])))
            row = (i, b - a, int(off.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest())
            out.append(row + ((kept, edge.reshape(-1, 2).tolist()) if with_kept else ()))
        return _send(out, names, kinds)

    told = "block int, bucket int, kind int, data binary"
    of_block = base.groupBy("block")
    first = of_block.applyInArrow(anchors, "bucket int, block int, anchors binary, multi binary")
    answers = first.groupBy("bucket").applyInArrow(shared, told)
    second = of_block.cogroup(answers.groupBy("block")).applyInArrow(passages, "bucket int, block int, rows binary, least binary")
    masks = second.groupBy("bucket").applyInArrow(sort, told)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * with_kept
    return common.unkeyed(of_block.cogroup(answers.union(masks).groupBy("block")).applyInArrow(remove, schema))


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.table(spark, sf_dir, "documents"))
