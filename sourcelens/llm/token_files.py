"""Token-id files coded by a static range asymmetric numeral system (operator 4).

A record holds a run of documents: one frequency table shared by all its blocks, and blocks that decode on their own.
A block's ids are dealt over 64 interleaved lanes with a 63-bit state each and one stream of 32-bit words. Every 256
steps a checkpoint keeps the lane states and the place in the stream, so that a reader can decode all stretches of all
blocks side by side; numpy does so here. Checksums cover each block's words and each block's ids.

Nulls and empty texts give a document of the end id alone. Rows that repeat a doc_id all stay, in the order of their
texts. An empty table gives no records. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.llm import common, tokens

MAGIC = b"SLT1"
LANES, BITS, STEP = 64, 16, 256
LOW = np.uint64(1 << 31)
_U = np.uint64
_HEAD = struct.Struct("<4sIIIIII")  # magic, lanes, table bits, checkpoint step, symbols, documents, blocks


def frequencies(count: np.ndarray) -> np.ndarray:
    """Integer frequencies that sum to 2**BITS, at least 1 for every symbol that occurs."""
    m = 1 << BITS
    f = np.where(count > 0, np.maximum(1, count * m // max(1, count.sum())), 0).astype(np.int64)
    over = f.sum() - m
    if over > 0:
        spare = np.maximum(f - 1, 0)
        f -= spare * over // spare.sum()
        for k in np.argsort(-f, kind="stable")[: f.sum() - m]:
            f[k] -= 1
    f[np.argmax(f)] += m - f.sum()
    return f


def encode_record(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block_tokens: int) -> bytes:
    """One record: whole documents, cut into blocks of about block_tokens ids between documents."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    freq = frequencies(count[symbols])
    cum = np.cumsum(freq) - freq
    dense = np.zeros(len(count), np.uint32)
    dense[symbols] = np.arange(len(symbols))
    ends = np.cumsum(lengths)
    marks = (ends - lengths) // block_tokens  # a document belongs to the block in which it begins
    first = np.append(np.flatnonzero(np.append(True, marks[1:] != marks[:-1])), len(lengths))
    docs_in = np.diff(first)
    size = np.add.reduceat(lengths, first[:-1])
    rows = -(-size // LANES)
    base = (np.cumsum(rows) - rows) * LANES
    sym = np.full(int(rows.sum()) * LANES, int(np.argmax(freq)), np.uint32)
    starts = np.cumsum(size) - size
    for b in range(len(size)):
        sym[base[b] : base[b] + size[b]] = dense[ids[starts[b] : starts[b] + size[b]]]
    order = np.argsort(-rows, kind="stable")
    by, top = base[order][:, None] + np.arange(LANES), int(rows.max())
    active = np.searchsorted(-rows[order], -np.arange(top), "left")  # blocks with rows > t
    f64, c64 = freq.astype(_U), cum.astype(_U)
    state = np.full((len(size), LANES), LOW, _U)
    words, sent = np.zeros(len(sym), np.uint32), np.zeros(len(sym), bool)
    checks: dict[int, np.ndarray] = {}
    for t in range(top - 1, -1, -1):
        k = active[t]
        at = by[:k] + t * LANES
        s = sym[at]
        f, x = f64[s], state[:k]
        full = x >= f << _U(63 - BITS)
        sent[at] = full
        words[at] = (x & _U(0xFFFFFFFF)).astype(np.uint32)
        x = np.where(full, x >> _U(32), x)
        q = x // f
        state[:k] = (q << _U(BITS)) + (x - q * f) + c64[s]
        if t % STEP == 0:
            checks[t // STEP] = state[:k].copy()
    place = np.argsort(order, kind="stable")
    out = [_HEAD.pack(MAGIC, LANES, BITS, STEP, len(symbols), len(lengths), len(size))]
    out += [symbols.astype("<u4").tobytes(), (freq - 1).astype("<u2").tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes()]
    body = []
    for b in range(len(size)):
        span = slice(base[b], base[b] + rows[b] * LANES)
        on = sent[span]
        stream = words[span][on].astype("<u4").tobytes()
        segments = -(-int(rows[b]) // STEP)
        at = np.concatenate([[0], np.cumsum(on)])[np.arange(segments) * STEP * LANES]
        marks = np.stack([checks[j][place[b]] for j in range(segments)])
        body += [at.astype("<u4").tobytes(), marks.astype("<u8").tobytes(), stream]
        out.append(struct.pack("<IIIII", int(docs_in[b]), int(size[b]), len(stream) // 4, zlib.crc32(stream), tokens.crc32(ids[starts[b] : starts[b] + size[b]])))
    return b"".join(out + body)


def decode_record(record: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a record; every stretch between checkpoints is decoded at the same time."""
    magic, lanes, bits, step, n_symbols, n_docs, n_blocks = _HEAD.unpack_from(record)
    if magic != MAGIC:
        raise ValueError("not a token record")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(record, kind, n, at)
        at += got.nbytes
        return got

    symbols, freq = take("<u4", n_symbols), take("<u2", n_symbols).astype(np.int64) + 1
    doc_ids, lengths = take("<i8", n_docs), take("<u4", n_docs).astype(np.int64)
    heads = take("<u4", 5 * n_blocks).reshape(n_blocks, 5).astype(np.int64)
    cum = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq)
    size, rows = heads[:, 1], -(-heads[:, 1] // lanes)
    base, streams, pointers, states, place, length, got = (np.cumsum(rows) - rows) * lanes, [], [], [], [], [], 0
    for b in range(n_blocks):
        segments = -(-int(rows[b]) // step)
        pointers.append(take("<u4", segments).astype(np.int64) + got)
        states.append(take("<u8", segments * lanes).reshape(segments, lanes))
        streams.append(take("<u4", int(heads[b, 2])))
        if zlib.crc32(streams[-1].tobytes()) != heads[b, 3]:
            raise ValueError(f"block {b}: its words are damaged")
        got += len(streams[-1])
        place.append(base[b] + np.arange(segments) * step * lanes)
        length.append(np.minimum(step, rows[b] - np.arange(segments) * step))
    length = np.concatenate(length)
    order = np.argsort(-length, kind="stable")
    length, pointer, x = length[order], np.concatenate(pointers)[order], np.concatenate(states)[order].astype(_U)
    by = np.concatenate(place)[order][:, None] + np.arange(lanes)
    stream = np.append(np.concatenate(streams), np.uint32(0))
    out = np.zeros(int(rows.sum()) * lanes, np.uint32)
    f64, c64, mask = freq.astype(_U), cum.astype(_U), _U((1 << bits) - 1)
    active = np.searchsorted(-length, -np.arange(int(length.max())), "left")
    for t, k in enumerate(active):
        slot = x[:k] & mask
        s = slots[slot]
        out[by[:k] + t * lanes] = s
        now = f64[s] * (x[:k] >> _U(bits)) + slot - c64[s]
        low = now < LOW
        n = np.cumsum(low, axis=1)
        word = stream[np.minimum(pointer[:k, None] + n - 1, len(stream) - 1)].astype(_U)
        x[:k] = np.where(low, (now << _U(32)) | word, now)
        pointer[:k] += n[:, -1]
    ids = symbols[np.concatenate([out[base[b] : base[b] + size[b]] for b in range(n_blocks)])].astype(np.int32)
    starts = np.cumsum(size) - size
    for b in range(n_blocks):
        if tokens.crc32(ids[starts[b] : starts[b] + size[b]]) != heads[b, 4]:
            raise ValueError(f"block {b}: its ids are damaged")
    return doc_ids, lengths, ids


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids with end_id after each text, and the new offsets."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)


def _records(vocabulary: str, end_id: int, block_tokens: int, record_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, record = tokens.encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            nonlocal record, held
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [[part], [record], [len(lengths)], [len(ids)], [encode_record(doc_ids, lengths, ids, block_tokens)]]
            record, held = record + 1, []
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "record", "n_docs", "n_tokens", "data"])

        for batch in batches:
            for piece in common.slices(batch, "text", 4 << 20):
                ids, offsets = with_end(*encode(piece.column("text")), end_id)
                held.append((np.asarray(piece.column("doc_id")), np.diff(offsets), ids))
                if sum(len(h[2]) for h in held) >= record_tokens:
                    yield done()
        if held:
            yield done()

    return run


def token_records(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, block_tokens: int = 1 << 16, record_tokens: int = 1 << 21, part_bytes: int = 24 << 20) -> DataFrame:
    """Records in ascending doc_id order: (part, record, n_docs, n_tokens, data). One range shuffle of the texts."""
    n = common.parts_for(common.text_bytes(docs), part_bytes)
    ranged = common.keyed(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    run = _records(vocabulary or tokens.default_vocabulary(), end_id, block_tokens, record_tokens)
    return ranged.mapInArrow(run, "part int, record int, n_docs long, n_tokens long, data binary")


def write_token_files(docs: DataFrame, path: str, **options) -> None:
    token_records(docs, **options).write.option("compression", "none").parquet(path)


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, record, data in zip(*(batch.column(c).to_pylist() for c in ("part", "record", "data")), strict=True):
                doc_ids, lengths, ids = decode_record(data)
                starts = np.cumsum(lengths) - lengths
                n = len(lengths)
                cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, record, np.int32)), pa.array(doc_ids), pa.array(starts), pa.array(lengths)]
                cols.append(pa.array([tokens.crc32(ids[a : a + m]) for a, m in zip(starts.tolist(), lengths.tolist(), strict=True)], pa.int64()))
                names = ["part", "record", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.append(starts, len(ids)).astype(np.int32), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and the ids where asked for."""
    files = spark.read.parquet(path)
    docs = files.select("part", "record", "data").mapInArrow(_documents(with_ids), "part int, record int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("run", F.shiftright("part", 10))
    runs = parts.groupBy("run").agg(F.sum("n").alias("all"))
    runs = runs.select("run", (F.sum("all").over(W.orderBy("run")) - F.col("all")).alias("run_at"))  # a row for each 1,024 parts, or 24 GB
    before = parts.join(runs, "run").select("part", (F.sum("n").over(W.partitionBy("run").orderBy("part")) - F.col("n") + F.col("run_at")).alias("part_at"))
    inside = W.partitionBy("part").orderBy("record")
    at = files.select("part", "record", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("record_at")).join(before, "part")
    out = docs.join(at, ["part", "record"]).select("doc_id", (F.col("start") + F.col("record_at") + F.col("part_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
    return common.unkeyed(out)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{common.scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(common.table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
