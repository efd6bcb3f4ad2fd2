"""Toxicity by maximal scoring segments over token log-odds (operator 6).

Training. Features of a word are the word and its first five and seven bytes. For every feature the log-odds of the
share of toxic against other documents that have it is taken under a Dirichlet prior (one pseudo-document, and the
corpus share times a strength), as in Monroe, Colaresi and Quinn (2008); only log-odds with a z-score of at least
Z_LEAST count. A token scores its best feature less DRIFT, any other token -DRIFT, so scores are negative on average.

Scoring. One linear scan (Ruzzo and Tompa, 1999) finds all maximal scoring segments. With lambda from
sum p(s) exp(lambda s) = 1 over other documents' tokens, a segment of score S in n tokens has the E-value
n exp(-lambda S) (Karlin and Altschul, 1990): segments with E <= E_MOST are significant passages. A document's evidence
is the sum of -ln E = lambda S - ln n over its segments with E < 1, or without any that of its best segment. In clean
text of any length about one segment has E < 1, so evidence does not grow with length; a logistic curve fitted to
training documents turns it into a score.

At most TRAINING_ROWS labelled documents train the model, chosen by hash of doc_id; that bounds the model, which
tasks get as a constant. Every document is scored as a whole, whatever its length. Null and empty texts have no evidence and get the least
score. Null labels train nothing; with no toxic or no other document to learn from all scores are 0. Rows that repeat
a doc_id are scored apart. Columns other than those named are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelens.llm import common

TRAINING_ROWS, STRENGTH, Z_LEAST, DRIFT, DOCS_LEAST, E_MOST = 200_000, 10.0, 3.0, 1.5, 5, 0.01
PREFIXES = (5, 7)
THRESHOLD = 0.7
#: Bytes of words stay, as lower case; all others part words.
_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_WORDS).split()


def features(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """score by feature, lambda, the logistic curve, and a memo of words that lives in the worker."""

    score: dict[bytes, float]
    rate: float = 1.0
    slope: float = 1.0
    offset: float = 0.0
    empty: bool = False
    memo: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def of(self, word: bytes) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[word] = max((self.score.get(f, -DRIFT) for f in features(word)), default=-DRIFT)
        return got

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments as (first word, word after the last, score), in order; linear in the words."""
        get, of = self.memo.get, self.of
        values = [s if (s := get(w)) is not None else of(w) for w in words]
        hits = [i for i, s in enumerate(values) if s > 0]
        if not hits:
            return []
        out: list[tuple[int, int, float, float]] = []  # first, end, left total, right total
        total, at = 0.0, 0
        for i in hits:
            total -= DRIFT * (i - at)
            first, left = i, total
            total += values[i]
            at = i + 1
            right, end = total, at
            while True:
                k = len(out) - 1
                while k >= 0 and out[k][2] >= left:
                    k -= 1
                if k < 0 or out[k][3] >= right:
                    out.append((first, end, left, right))
                    break
                first, left = out[k][0], out[k][2]
                del out[k:]
        return [(a, b, r - l) for a, b, l, r in out]

    def evidence(self, words: list[bytes], found: list[tuple[int, int, float]] | None = None) -> float:
        """found: the words' segments, where they are known already."""
        least = math.log(max(1, len(words)))
        own = [self.rate * s - least for _, _, s in (self.segments(words) if found is None else found)]
        return sum(x for x in own if x > 0) or max(own, default=-least)

    def chance(self, evidence: float) -> float:
        return 0.0 if self.empty else 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for piece in common.slices(batch, "text", 4 << 20):
            yield piece, piece.column("text").to_pylist()


def _counts(toxic: int, known: set[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _texts(batches):
            count: Counter[bytes] = Counter()
            for label, text in zip(piece.column("toxic").to_pylist(), texts, strict=True):
                if label == toxic:
                    own = {f for w in set(tokens(text)) for f in features(w)}
                    count.update(own if known is None else own & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["feature", "n"])

    return run


def _log_odds(toxic: dict[bytes, int], other: dict[bytes, int], n_toxic: int, n_other: int) -> dict[bytes, tuple[float, float]]:
    """Per feature: log-odds and its z-score."""
    n, out = n_toxic + n_other, {}
    for f, a in toxic.items():
        b = other.get(f, 0)
        prior = 1 + STRENGTH * (a + b) / n
        a, b = a + prior * n_toxic / n, b + prior * n_other / n
        odds = math.log(a / max(n_toxic + STRENGTH + 1 - a, 0.5)) - math.log(b / max(n_other + STRENGTH + 1 - b, 0.5))
        out[f] = odds, odds / math.sqrt(1 / a + 1 / b)
    return out


def _rate(scores: list[tuple[float, float]]) -> float:
    """The positive root of sum p exp(lambda s) = 1, for (score, probability) pairs; what probability is left scores -DRIFT."""
    rest = max(0.0, 1 - sum(p for _, p in scores))
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        total = rest * math.exp(-mid * DRIFT) + sum(p * math.exp(min(600.0, mid * s)) for s, p in scores)
        low, high = (mid, high) if total < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Model:
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    own = own.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if (n := own.count()) > most:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    rows = common.cut(common.keyed(docs).join(F.broadcast(own), "doc_id").select("text", "toxic"), "training")  # own has at most about `most` rows
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, empty=True)

    def counted(label: int, known: set[bytes] | None) -> dict[bytes, int]:
        made = rows.where(F.col("toxic") == label).mapInArrow(_counts(label, known), "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        return {bytes(r["feature"]): r["n"] for r in made.where(F.col("n") >= (DOCS_LEAST if known is None else 1)).toLocalIterator()}

    toxic = counted(1, None)
    other = counted(0, set(toxic))
    odds = _log_odds(toxic, other, sizes[1], sizes[0])
    model = Model({f: o - DRIFT for f, (o, z) in odds.items() if z >= Z_LEAST and o > DRIFT})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            count: Counter[float] = Counter()
            for text in texts:
                count.update(round(model.of(w), 2) for w in tokens(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.float64()), pa.array(list(count.values()), pa.int64())], ["s", "n"])

    seen = {r["s"]: r["n"] for r in rows.where("toxic = 0").select("text").mapInArrow(tally, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    total = sum(seen.values()) + 1
    model.rate = _rate([(s, (n + 0.5) / total) for s, n in seen.items() if s > 0] or [(max(model.score.values(), default=1.0), 0.5 / total)])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _texts(batches):
            x = np.round(np.clip([model.evidence(tokens(t)) for t in texts], -30, 60), 1)
            yield pa.RecordBatch.from_arrays([pa.array(x), piece.column("toxic")], ["x", "toxic"])

    bins = rows.mapInArrow(weighed, "x double, toxic int").groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # 1802 at most
    model.slope, model.offset = _logistic(*(np.array([r[c] for r in bins], float) for c in ("x", "toxic", "n")))
    return model


def score(docs: DataFrame, model: Model, with_passages: bool = False) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; with_passages adds (first word, end, E-value) of significant ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _texts(batches):
            found, spans = [], []
            for text in texts:
                words = tokens(text)
                own = model.segments(words)
                found.append(model.chance(model.evidence(words, own)))
                if with_passages:
                    e = [(a, b, len(words) * math.exp(-model.rate * s)) for a, b, s in own]
                    spans.append([{"first": a, "end": b, "e_value": v} for a, b, v in e if v <= E_MOST])
            cols, names = [piece.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"]
            if with_passages:
                cols.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("e_value", pa.float64())]))))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = "doc_id long, score double" + ", passages array<struct<first int, end int, e_value double>>" * with_passages
    out = common.unkeyed(common.keyed(docs).mapInArrow(run, kind))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *["passages"] * with_passages)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score the threshold or more; one pass that carries each row's columns along."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _texts(batches):
            yield piece.filter(pa.array([model.chance(model.evidence(tokens(t))) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, train(docs, common.table(spark, sf_dir, "labels")), with_passages=True)
    return out.withColumns({"n_passages": F.size("passages"), "least_e": F.array_min(F.transform("passages", lambda p: p["e_value"]))}).drop("passages")
