"""Quality selection by importance resampling (operator 3).

Two bag-of-hashed-n-grams models (Xie et al., 2023) are counted: one over target texts, one over all raw texts. A
document's log importance is the sum over its n-grams of log p_target - log p_raw. Adding Gumbel noise and taking the
k largest draws k documents without replacement in proportion to importance. Noise comes from a hash of doc_id and
seed, so a draw can be repeated.

N-grams are the words and pairs of words, with runs of one punctuation mark as words, and for each word and pair its
shape: how it is cased, which kind of characters it has, whether it repeats the word before. Counts cover all
documents. The k-th largest key is found exactly by counting key bits from the top, 16 at a time; no sort and no row
goes to the driver.

Texts of any length are read whole. Null and empty texts have importance 0. Ties at the k-th key are cut by doc_id; rows that repeat both share their
fate, so k may be exceeded by such copies only. Null labels are no targets; without targets the choice is the noise's
alone. At most TARGETS target documents are counted; raw counts cover every document. Empty tables give no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.llm import common

BUCKETS, SEED, SHARE = 10_000, 42, 0.8
#: The target model is fitted on at most about so many documents, chosen by hash of doc_id; their ids are broadcast.
TARGETS = 200_000
#: Runs of letters and digits, or of one other mark.
_TOKENS = re.compile(r"[^\W_]+|([^\w\s]|_)\1*")


class _Words:
    """Hashes of words and of their shapes by number; a bounded memo that lives as long as the worker."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = np.zeros((1 << 14, 2), np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        """Hash and shape of each word, as two columns."""
        if len(self.number) > self.most:
            self.forget()
        got = list(map(self.number.get, words))
        if None in got:
            for w in set(words):
                if w not in self.number:
                    self._add(w)
            got = list(map(self.number.__getitem__, words))
        return self.hashes[np.array(got, np.int64)]

    def _add(self, w: str) -> None:
        if w[0].isalnum():
            case = "U" if w.isupper() and len(w) > 1 else "T" if w[0].isupper() else "l" if w.isalpha() else "n"
            shape = f"{case}{min(len(w), 12) // 4}"
        else:
            shape = f"{w[0]}{min(len(w), 3)}"
        n = self.number[w] = len(self.number)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh64_intdigest(w.lower(), 1), xxhash.xxh64_intdigest(shape, 2)


_WORDS = _Words()


def ngrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every n-gram of a text."""
    words = [m[0] for m in _TOKENS.finditer(text or "")]
    if not words:
        return np.zeros(0, np.int64)
    pairs = _WORDS.of(words)
    h, s = pairs[:, 0], pairs[:, 1].copy()
    s[1:] ^= (h[1:] == h[:-1]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mul = np.uint64(0xBF58476D1CE4E5B9)
    every = np.concatenate([h, h[:-1] * mul + h[1:], s, s[:-1] * mul + s[1:] + np.uint64(1)])
    every ^= every >> np.uint64(31)
    every *= np.uint64(0x94D049BB133111EB)
    return ((every >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in common.slices(batch, "text", 4 << 20):
                found = [ngrams(t, buckets) for t in piece.column("text").to_pylist()]
                raw += np.bincount(np.concatenate(found), minlength=buckets)
                if own := [f for f, on in zip(found, piece.column("target").to_pylist(), strict=True) if on]:
                    target += np.bincount(np.concatenate(own), minlength=buckets)
        on = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(raw[on]), pa.array(target[on])], ["bucket", "raw", "target"])

    return run


def _weighed(ratio: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", 4 << 20):
                ids = piece.column("doc_id").to_pylist()
                weight = np.array([ratio[ngrams(t, len(ratio))].sum() for t in piece.column("text").to_pylist()], float)
                noise = np.array([(xxhash.xxh64_intdigest(str(i), seed) + 0.5) / 2.0**64 for i in ids])
                key = weight - np.log(-np.log(np.clip(noise, 1e-18, 1 - 1e-16)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(weight), pa.array(key)], ["doc_id", "log_weight", "key"])

    return run


def _rank_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits = np.asarray(b.column("key"), np.float64).view(np.int64)
        bits = np.where(bits < 0, ~bits ^ np.int64(-(2**63)), bits)  # signed order is the doubles' order
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits)], [*b.schema.names, "bits"])


def largest(rows: DataFrame, k: int) -> DataFrame:
    """The k rows with the largest key, ties cut by the smaller doc_id; rows that share the last doc_id all stay. rows has doc_id, key and bits."""
    low, left = 0, k  # rows whose bits exceed the prefix are in; `left` of those that have it
    prefix: int | None = None
    for shift in (48, 32, 16, 0):
        part = F.shiftright("bits", shift)
        near = rows if prefix is None else rows.where(F.shiftright("bits", shift + 16) == prefix)
        counts = {r["p"]: r["n"] for r in near.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 65,536 at most
        for p in sorted(counts, reverse=True):
            prefix = p
            if counts[p] >= left:
                break
            left -= counts[p]
    low = prefix
    ties = rows.where(F.col("bits") == low)
    sure = rows.where(F.col("bits") > low)
    before = F.coalesce(F.sum("n").over(W.orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # ids that share 64 bits of a random key: few
    last = ties.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where(F.col("before") < left).agg(F.max("doc_id")).first()[0]
    return sure.union(ties.where(F.col("doc_id") <= F.lit(last)))


def resample(docs: DataFrame, targets: DataFrame, share: float = SHARE, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """round(share x rows) documents drawn by importance: doc_id, log_weight, key. targets: doc_id of target documents."""
    own = targets.select(targets["doc_id"].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    if (n := own.count()) > TARGETS:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * TARGETS / n))
    marked = common.keyed(docs).join(F.broadcast(own.withColumn("target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = marked.mapInArrow(_counted(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # a row for each bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    if not target.any():
        ratio[:] = 0
    rows = common.keyed(docs).mapInArrow(_weighed(ratio, seed), "doc_id long, log_weight double, key double")
    rows = common.cut(rows.mapInArrow(_rank_bits, "doc_id long, log_weight double, key double, bits long"), "weights")
    k = math.floor(share * rows.count() + 0.5)
    out = largest(rows, k) if k else rows.limit(0)
    return common.unkeyed(out.select("doc_id", "log_weight", "key"))


def op3_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    out = resample(common.table(spark, sf_dir, "documents"), labels.where("quality = 1"))
    return out.withColumn("kept", F.lit(True))
