"""Exact cosine search of stated query vectors against all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2000, part: int = 20_000) -> DataFrame:
    """query_id, vec_id, cosine, rank. Blocks of queries meet blocks of vectors; a query never meets itself.

    queries and vectors: vec_id, embedding; those that are null or zero match nothing, vectors of another dimension
    neither. A group holds one block of either side, multiplies them and hands on the k best of each query.
    """
    e = F.col("embedding").cast("array<double>")
    unit = lambda df: df.select("vec_id", e.alias("e")).where(F.size("e") > 0).withColumn("len", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))).where("len > 0").select("vec_id", F.transform("e", lambda x: x / F.col("len")).alias("e"))
    q, v = unit(queries), unit(vectors)
    n, m = max(1, -(-q.count() // block)), max(1, -(-v.count() // part))
    dealt = lambda df, name, count: df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    q = dealt(q, "b", n).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    v = dealt(v, "p", m).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = lambda t: np.asarray(t.column("e").combine_chunks().value_lengths()) if t.num_rows else np.zeros(0, np.int64)
        wl, wr = width(left), width(right)
        for dims in np.intersect1d(wl, wr).tolist():
            take = lambda t, w: (lambda s: (np.asarray(s.column("vec_id")), np.asarray(s.column("e").combine_chunks().flatten()).reshape(-1, dims)))(t.filter(pa.array(w == dims)))
            (ids, a), (others, b) = take(left, wl), take(right, wr)
            order = np.argsort(others, kind="stable")  # of equal cosines the smaller vec_id first
            others, b = others[order], b[order]
            for at in range(0, len(ids), 256):
                score = np.round(a[at : at + 256] @ b.T, 9)
                score[ids[at : at + 256, None] == others[None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(score, top, axis=1)
                on = np.isfinite(got)
                out.append((np.repeat(ids[at : at + 256], on.sum(axis=1)), others[top[on]], got[on]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "cosine"])

    found = q.groupBy("b", "p").cogroup(v.groupBy("b", "p")).applyInArrow(best, "query_id long, vec_id long, cosine double")
    order = W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
