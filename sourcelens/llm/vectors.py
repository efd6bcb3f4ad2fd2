"""Embedding near-duplicates by a subspace pigeonhole join (operator 7).

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a fixed random rotation they are split into blocks of
dimensions; if the squared distance is at most r2, then in some block it is at most that block's share of r2 (its
share of the dimensions). So each block is range-joined by itself: cells along its first coordinate as wide as the
block's radius, each vector at home in one cell and a guest in the next; inside a cell, tiles along the second
coordinate that lie further apart than the radius are passed over. What passes a block's budget is verified at once by
the cosine in double precision. A pair counts in the first block that passes, so counts need no list of pairs, and cells
hand on counts and a spanning forest only. Vectors travel in single precision where that loses nothing.

Equal vectors with equal labels are one node with a multiplicity. Null, zero and non-finite vectors and null labels
link with nothing. Vectors of different dimension are joined apart. Rows that repeat a vec_id share its links. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

COSINE, BLOCKS, SEED = 0.93, 4, 11
#: Added to distances so that rounding never costs a pair; the cosine itself decides.
SLACK = 1e-9


@lru_cache(8)
def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _bounds(dims: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dims, min(blocks, max(1, dims // 2)) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def _rows(data: pa.Array, dims: int) -> np.ndarray:
    """Vectors of so many dimensions from their bytes, each in single or in double precision."""
    flat, offsets = common.flat_bytes(data)
    single = np.diff(offsets) == 4 * dims
    raw = np.empty((len(single), dims))
    for kind, on in (("<f4", single), ("<f8", ~single)):
        if on.any():
            raw[on] = np.frombuffer(flat[np.repeat(on, np.diff(offsets))].tobytes(), kind).reshape(-1, dims)
    most = np.abs(raw).max(axis=1, initial=0)
    far = (most < 1e-100) | (most > 1e100)  # squares would leave the range of doubles
    return np.where(far[:, None], raw / most[:, None], raw) if far.any() else raw


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _placed(cosine: float, blocks: int):
    """Rows of the cells: block, x, home, node, dims, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, node, label = batch.column("data"), np.asarray(batch.column("node")), np.asarray(batch.column("label"))
            copies = np.asarray(batch.column("copies"))
            width = np.asarray(batch.column("dims"))
            for dims in np.unique(width).tolist():
                pick = np.flatnonzero(width == dims)
                own = data.take(pa.array(pick))
                raw = _rows(own, dims)
                turned = _unit(raw) @ rotation(dims)
                for k, (a, b) in enumerate(_bounds(dims, blocks)):
                    wide = math.sqrt((2 - 2 * cosine) * (b - a) / dims) + SLACK
                    x = np.floor(turned[:, a] / wide).astype(np.int32)
                    for n in (0, 1):
                        cols = [np.full(len(pick), dims, np.int32), np.full(len(pick), k, np.int32), x + np.int32(n), np.full(len(pick), n == 0), node[pick], label[pick], copies[pick]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), own], ["dims", "block", "x", "home", "node", "label", "copies", "data"])

    return run


class _Group:
    """Vectors of one cell: as they are, as units, and turned."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.unit = raw, _unit(raw)
        self.turned = self.unit @ rotation(raw.shape[1])
        self.norm = np.sqrt((raw * raw).sum(axis=1))

    def passes(self, left: np.ndarray, right: np.ndarray, bounds: list[tuple[int, int]], block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows within this block's budget, in no earlier block's, and with the cosine."""
        dims = self.raw.shape[1]
        budget = lambda k: (2 - 2 * cosine) * (bounds[k][1] - bounds[k][0]) / dims + SLACK
        a, b = bounds[block]
        lt, rt = self.turned[left, a:b], self.turned[right, a:b]
        square = (lt**2).sum(1)[:, None] + (rt**2).sum(1)[None, :] - 2 * lt @ rt.T
        i, j = np.nonzero(square <= budget(block) + SLACK)
        i, j = left[i], right[j]
        if len(i):
            good = np.einsum("ij,ij->i", self.unit[i], self.unit[j]) >= cosine - SLACK
            i, j = i[good], j[good]
            good = (self.raw[i] * self.raw[j]).sum(axis=1) / (self.norm[i] * self.norm[j]) >= cosine
            i, j = i[good], j[good]
        for k, (c, d) in enumerate(bounds[: block + 1]):
            near = ((self.turned[i, c:d] - self.turned[j, c:d]) ** 2).sum(axis=1) <= budget(k)
            keep = near if k == block else ~near
            i, j = i[keep], j[keep]
        return i, j


def _joined(cosine: float, blocks: int, tile: int = 512):
    keys = ["label", "dims", "block", "x", "cell_a", "cell_b"]

    def pairs(group, y, wide, home, side, a_side, b_side, bounds, block):
        """Tiles of (rows, rows): home with home once, home with guests; across sides both ways. Rows are in order of y."""
        mine, guests = np.flatnonzero(home), np.flatnonzero(~home)
        if a_side == b_side:
            todo = [(mine, mine, True), (mine, guests, False)]
        else:
            cut = lambda rows, s: rows[side[rows] == s]
            todo = [(cut(mine, a_side), cut(mine, b_side), False), (cut(mine, a_side), cut(guests, b_side), False), (cut(mine, b_side), cut(guests, a_side), False)]
        for left, right, same in todo:
            for p in range(0, len(left), tile):
                for q in range(p if same else 0, len(right), tile):
                    l, r = left[p : p + tile], right[q : q + tile]
                    if y[l[0]] - y[r[-1]] > wide or y[r[0]] - y[l[-1]] > wide:
                        continue
                    i, j = group.passes(l, r, bounds, block, cosine)
                    if same and p == q:
                        i, j = i[i < j], j[i < j]
                    yield i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches, keys):
            cols = [np.asarray(rows.column(k)) for k in keys]
            home, side, node, copies = (np.asarray(rows.column(k)) for k in ("home", "side", "node", "copies"))
            data = rows.column("data").combine_chunks()
            starts = common.group_starts(cols)
            out_node, out_n, us, vs = [], [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2 or not home[a:b].any():
                    continue
                dims, block, ca, cb = (int(cols[k][a]) for k in (1, 2, 4, 5))
                raw, bounds = _rows(data.slice(a, b - a), dims), _bounds(dims, blocks)
                low, high = bounds[block]
                y = _unit(raw) @ rotation(dims)[:, min(low + 1, high - 1)]
                order = np.argsort(y, kind="stable")
                group, y, place = _Group(raw[order]), y[order], a + order
                wide = math.sqrt((2 - 2 * cosine) * (high - low) / dims) + SLACK
                count = np.zeros(b - a, np.int64)
                label = np.arange(b - a)
                for i, j in pairs(group, y, wide, home[place], side[place], ca, cb, bounds, block):
                    np.add.at(count, i, copies[place][j])
                    np.add.at(count, j, copies[place][i])
                    open_pair = label[i] != label[j]
                    if open_pair.any():
                        u, v = common.union_find(label[i][open_pair], label[j][open_pair])
                        low = np.arange(b - a)
                        low[u] = v
                        label = low[label]
                hit = np.flatnonzero(count)
                out_node.append(node[place][hit])
                out_n.append(count[hit])
                us.append(node[place][hit])
                vs.append(node[place][label[hit]])
            if out_node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_node, out_n, us, vs)], ["node", "n", "u", "v"])

    return run


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, cell: int = 4096) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    rows = embeddings.select(F.coalesce(embeddings["vec_id"].cast("long"), F.lit(common.NULL_ID)).alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("e"), embeddings["label"].cast("long").alias("label"))
    odd = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    live = F.coalesce(F.col("e").isNotNull() & F.col("label").isNotNull() & ~odd & F.exists("e", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("live", live).withColumn("e", F.when(F.col("live"), F.transform("e", lambda v: v + F.lit(0.0))))
    good = rows.where("live").select("vec_id", "label", "e")
    nodes = common.cut(good.groupBy("label", "e").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("e")
            width = np.asarray(e.value_lengths(), np.int32)
            flat = np.ascontiguousarray(np.asarray(e.flatten()), "<f8")
            with np.errstate(over="ignore"):
                short = flat.astype("<f4")
            ends = np.cumsum(width.astype(np.int64))
            differ = np.concatenate([[0], np.cumsum(short != flat)])
            single = differ[ends] == differ[ends - width]
            data = pa.array([(short if one else flat)[z - w : z].tobytes() for one, z, w in zip(single.tolist(), ends.tolist(), width.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), b.column("copies"), pa.array(width), data], ["node", "label", "copies", "dims", "data"])

    grid = nodes.select("node", "label", "copies", "e").mapInArrow(packed, "node long, label long, copies long, dims int, data binary")
    grid = grid.mapInArrow(_placed(cosine, blocks), "dims int, block int, x int, home boolean, node long, label long, copies long, data binary")
    keys = ["label", "dims", "block", "x"]
    cells = common.dealt(grid, keys, "node", cell)
    by = [*keys, "cell_a", "cell_b"]
    found = common.cut(cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(_joined(cosine, blocks), "node long, n long, u long, v long"), "links")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = common.components(found.select(F.col("u").alias("a"), F.col("v").alias("b")))
    known = nodes.join(links, "node", "left").join(parts, "node", "left").select("label", "e", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component_id"))
    linked = good.join(known, ["label", "e"]).select("vec_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = linked.union(rows.where("not live").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return common.unkeyed(out.withColumn("kept", F.col("vec_id") == F.col("component_id")), "vec_id", "component_id")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND list_inner_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), low AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u), deg AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.u = v.vec_id LEFT JOIN deg ON deg.u = v.vec_id
"""
