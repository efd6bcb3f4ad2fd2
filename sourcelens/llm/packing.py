"""Best-fit packing of documents into sequences, improved by a swap-based local search (operator 10).

Lengths are whole numbers, so best fit needs one stack of bins for each possible gap and a bit set of the gaps in use.
The search then takes underfull bins, emptiest first, and moves their documents into others or exchanges one for one,
two for one or one for two, each time raising the sum of squared fills, until a bin is empty or nothing improves.
Groups of bounded size, dealt by a number of the written row, are packed side by side; bins that stay underfull are pooled and packed again.

Null and empty texts are a document of the end id alone. Repeated rows are packed each on their own. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common, tokens
from sourcelens.llm.token_files import with_end

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of positions in lengths."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_gaps >> n
        if fits:
            gap = n + ((fits & -fits).bit_length() - 1)
            b = stacks[gap].pop()
            if not stacks[gap]:
                open_gaps &= ~(1 << gap)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if gap > n:
            stacks[gap - n].append(b)
            open_gaps |= 1 << (gap - n)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search that visits every underfull bin; full bins stay."""
    fill = np.array([sum(int(lengths[i]) for i in b) for b in bins], np.int64)
    loose = np.flatnonzero(fill < capacity)
    if len(loose) < 2:
        return bins
    items = np.array([i for b in loose for i in bins[b]], np.int64)
    home = np.array([k for k, b in enumerate(loose) for _ in bins[b]], np.int64)
    size, gap = lengths[items].astype(np.int64), capacity - fill[loose]
    alive = np.ones(len(loose), bool)
    for e in np.argsort(-gap, kind="stable").tolist():
        if gap[alive].sum() - gap[e] < capacity - gap[e]:
            continue
        before = home.copy(), gap.copy()
        while True:
            own = np.flatnonzero(home == e)
            if not len(own):
                break
            other = alive & (np.arange(len(loose)) != e) & (gap > 0) & (gap <= gap[e])
            best = (0, None)
            for i in own[np.argsort(-size[own], kind="stable")]:  # move
                room = np.where(other & (gap >= size[i]), gap, capacity + 1)
                k = int(np.argmin(room))
                if room[k] <= capacity:
                    best = (int(size[i]), ([(i, k)]))
                    break
            if best[1] is None:
                theirs = np.flatnonzero(other[home])
                for i in own:  # one for one
                    net = size[i] - size[theirs]
                    net = np.where(net <= gap[home[theirs]], net, 0)
                    if len(net) and (j := int(np.argmax(net))) >= 0 and net[j] > best[0]:
                        best = (int(net[j]), [(i, home[theirs[j]]), (theirs[j], e)])
                for x in range(len(own)):  # two for one
                    for y in range(x):
                        net = size[own[x]] + size[own[y]] - size[theirs]
                        net = np.where(net <= gap[home[theirs]], net, 0)
                        if len(net) and net[j := int(np.argmax(net))] > best[0]:
                            best = (int(net[j]), [(own[x], home[theirs[j]]), (own[y], home[theirs[j]]), (theirs[j], e)])
                for i in own:  # one for two of the same bin, neighbours in size order
                    order = theirs[np.lexsort((size[theirs], home[theirs]))]
                    if len(order) > 1:
                        net = np.where(home[order[1:]] == home[order[:-1]], size[i] - size[order[1:]] - size[order[:-1]], 0)
                        net = np.where(net <= gap[home[order[1:]]], net, 0)
                        if net[j := int(np.argmax(net))] > best[0]:
                            best = (int(net[j]), [(i, home[order[j]]), (order[j], e), (order[j + 1], e)])
            if best[1] is None or best[0] <= 0:
                break
            for i, to in best[1]:
                gap[home[i]] += size[i]
                gap[to] -= size[i]
                home[i] = to
        if (home == e).any():
            home, gap = before  # what was gained without emptying a bin is given back
        else:
            alive[e] = False
    kept = [bins[b] for b in np.flatnonzero(fill >= capacity)]
    moved: dict[int, list[int]] = {}
    for i, k in zip(items.tolist(), home.tolist(), strict=True):
        moved.setdefault(k, []).append(i)
    return kept + list(moved.values())


def _pieces(vocabulary: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                ids, offsets = with_end(*encode(part.column("text")), end_id)
                total = np.diff(offsets)
                n = -(-total // capacity)
                first = total - (n - 1) * capacity
                owner = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[owner], capacity)
                at = offsets[owner] + start
                crc = [tokens.crc32(ids[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                cols = [pa.array(np.asarray(part.column("doc_id"))[owner]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.append(at, len(ids)).astype(np.int32), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _pack(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = np.asarray(rows.column("length"))
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        seq, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for k, b in enumerate(bins):
            b = np.sort(np.asarray(b))
            ends = np.cumsum(lengths[b])
            seq[b], offset[b], fill[b] = k, ends - lengths[b], ends[-1]
        out = {"sequence_id": seq, "offset": offset, "fill": fill}
        for name, values in out.items():
            rows = rows.append_column(name, pa.array(values))
        return rows

    return run


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, group: int = 20_000, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). Only longer documents are cut.

    Texts are encoded once; pieces of exactly capacity are sequences by themselves. The rest goes through two rounds
    of bounded groups: what the first leaves in underfull bins is pooled over all groups and packed once more.
    """
    kind = PIECE + ", ids array<int>" * with_ids
    run = _pieces(vocabulary or tokens.default_vocabulary(), end_id, capacity, with_ids)
    pieces = common.cut(common.keyed(docs).mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()), "pieces")
    names = [c for c in pieces.columns if c != "row"]
    short = pieces.where(F.col("length") < capacity)
    groups = common.parts_for(short.count(), group)
    packed = kind + ", g int, sequence_id long, offset long, fill long"
    first = common.cut(short.select(*names, F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g")).groupBy("g").applyInArrow(_pack(capacity), packed), "packed")
    open_bin = F.col("fill") < capacity
    again = common.parts_for(first.where(open_bin).count(), group)
    second = first.where(open_bin).select(*names, F.pmod(F.xxhash64("sequence_id", "g"), F.lit(again)).cast("int").alias("g")).groupBy("g").applyInArrow(_pack(capacity), packed)
    number = lambda kind: F.shiftleft(F.col("g").cast("long"), 33) + F.col("sequence_id") * 4 + kind  # noqa: E731  # a task's table has fewer than 2**31 bins
    full = pieces.where(F.col("length") == capacity).select(*names, (F.monotonically_increasing_id() * 4 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = first.where(~open_bin).select(*names, number(0).alias("sequence_id"), "offset").union(second.select(*names, number(1).alias("sequence_id"), "offset")).union(full)
    return common.unkeyed(out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
