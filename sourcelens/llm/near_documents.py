"""Near-duplicate documents by SimHash and the Jaccard similarity of word shingles (the pipeline's SimHash stage).

A document's set is its five-word shingles as op5 takes them, each a 64-bit hash; a shorter text is one shingle of all
its words. Candidates come from two searches, and the similarity of the whole sets decides on each of them:

- op5's covering search over fingerprints of these shingles, radius 4: a group's members against its least one;
- MinHash bands (lines.py: 14 of 5 find a pair of similarity 0.8 with probability 0.996), as pairs of that similarity
  differ by some 10 of 64 bits, and masks that cover so many are beyond any number of tables.

A union-find joins the links. Equal texts are one node by two 64-bit hashes; a text of equal first hash only goes with
its exact copies. Null and empty texts have one set. Of each component the row with the least doc_id stays, of rows that
repeat a doc_id and text one. Texts of any length are read whole. An empty table gives no rows. Only doc_id and text
are read; any other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.llm import common, lines, simhash

SIMILARITY, WORDS = 0.8, 5
#: The shingle of a text without words; its fingerprint is zero, as in op5.
_NOTHING = simhash.shingles(None, 1)[0]


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of one text as sorted 64-bit hashes; never empty."""
    return np.unique(simhash.shingles(text, words))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set, as in lines.signatures: the upper half of a hash names its bin, the lower is its rank."""
    h = np.concatenate(sets)
    first = np.repeat(np.arange(len(sets)) * lines.BINS, [len(s) for s in sets])
    at = first + (((h >> np.uint64(32)) * np.uint64(lines.BINS)) >> np.uint64(32)).astype(np.int64)
    out = np.full(len(sets) * lines.BINS, lines.EMPTY, np.uint32)
    np.minimum.at(out, at, h.astype(np.uint32))
    return lines.densified(out.reshape(-1, lines.BINS))


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", 2 << 20):
                made = [simhash.shingles(t, words) for t in piece.column("text").to_pylist()]
                prints = np.fromiter((0 if len(m) == 1 and m[0] == _NOTHING else int(simhash.majority(m).view(np.int64)) for m in made), np.int64, len(made))
                keys = lines.band_keys(signatures([np.unique(m) for m in made]))
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * lines.BANDS, pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("h"), pa.array(prints), lists], ["h", "fp", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", 2 << 20):
                made = [shingle_set(t, words).tobytes() for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("h"), pa.array(made, pa.binary())], ["h", "shingles"])

    return run


def _verified(similarity: float):
    keys = ["key", "cell_a", "cell_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches, keys):
            cols = [np.asarray(rows.column(k)) for k in keys]
            h, side, raw = np.asarray(rows.column("h")), np.asarray(rows.column("side")), rows.column("shingles")
            us, vs = [], []
            starts = common.group_starts(cols)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(x, np.uint64) for x in raw.slice(a, b - a).to_pylist()]
                    u, v = lines.links(sets, h[a:b], side[a:b], bool(cols[1][a] != cols[2][a]), similarity)
                    us += u
                    vs += v
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return lambda batches: common.forest(run(batches))


def _paired(similarity: float):
    """Rows of u, v and their sets -> the links among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                on.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(on, pa.bool_()))

    return run


def links(base: DataFrame, similarity: float, words: int, cell: int) -> DataFrame:
    """(u, v): forests of the similar pairs of base's texts, named by h. base: h, h2, text."""
    signed = common.cut(base.select("h", "text").mapInArrow(_signed(words), "h long, fp long, keys array<long>"), "signatures")
    groups = simhash.near_components(signed.select(F.col("h").alias("doc_id"), "fp"))
    stars = common.cut(groups.where("doc_id != component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).distinct(), "stars")
    bands = signed.select(F.explode("keys").alias("key"), "h")
    parts = common.parts_for(signed.count(), 100_000)
    met = common.cut(bands.repartition(parts, "key").sortWithinPartitions("key", "h").mapInArrow(lines.shared, "key long, h long"), "bands")
    cells = common.cut(common.dealt_once(met, ["key"], "h", cell), "cells")
    common.drop(met)
    wanted = cells.select("h").union(stars.select("u")).union(stars.select("v")).distinct()
    n = stars.count()
    texts = base.join(common.sized(wanted, cells.count() + 2 * n), "h", "left_semi").groupBy("h").agg(F.min(F.struct("h2", "text")).alias("t")).select("h", "t.text")
    sets = common.cut(texts.mapInArrow(_sets(words), "h long, shingles binary"), "shingles")
    keys = ["key", "cell_a", "cell_b"]
    banded = cells.hint("merge").join(sets, "h").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verified(similarity), "u long, v long")
    left, right = sets.select(F.col("h").alias("u"), F.col("shingles").alias("left")), sets.select(F.col("h").alias("v"), F.col("shingles").alias("right"))
    covered = common.sized(stars, n).join(left, "u").join(right.hint("merge"), "v").select("u", "v", "left", "right").mapInArrow(_paired(similarity), "u long, v long")
    return banded.union(covered)


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, cell: int = 256) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id."""
    own = [F.coalesce(docs["doc_id"].cast("long"), F.lit(common.NULL_ID)), F.xxhash64(docs["text"].cast("string")), F.xxhash64(F.lit(1), docs["text"].cast("string"))]
    base = common.keyed(docs).withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    parts = common.components(links(base.select("h", "h2", "text"), similarity, words, cell), "u", "v", contracted=True)
    nodes = base.groupBy("h", "h2").agg(F.min("doc_id").alias("least"))
    nodes = nodes.withColumn("other", F.when(F.col("h2") != F.min("h2").over(W.partitionBy("h")), F.col("h2")))  # null but for different texts of one h
    named = nodes.join(parts, nodes["h"] == parts["node"], "left").select("h", "h2", "least", F.when(F.col("other").isNull(), F.col("component")).alias("part"), F.coalesce("other", F.lit(common.NULL_ID)).alias("other"))
    keep = named.groupBy(F.coalesce("part", "h").alias("c"), "other").agg(F.min(F.struct("least", "h", "h2")).alias("k")).select(F.col("k.least").alias("_least"), F.col("k.h").alias("_h"), F.col("k.h2").alias("_h2"))
    names = ["_least", "_h", "_h2"]
    repeated = base.groupBy("doc_id", "h", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "h", "h2"), names, strict=True)))

    def of(rows: DataFrame, how: str) -> DataFrame:
        return docs.join(rows, (own[0] == rows["_least"]) & (own[1] == rows["_h"]) & (own[2] == rows["_h2"]), how)

    many = of(keep.join(repeated, names, "left_semi"), "inner").dropDuplicates(names)
    return of(keep.join(repeated, names, "left_anti"), "left_semi").union(many.select(*(docs[c] for c in docs.columns)))
