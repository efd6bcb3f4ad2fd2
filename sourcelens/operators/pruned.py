"""Exact top k by TF-IDF without ranking all pairs: postings in blocks with a largest weight each, and bounds that tell what can't matter.

The scores are those of retrieval.tfidf_scores(). A term's postings are dealt into blocks by the size of tf / norm, so
a block's largest weight is close to all of them and comes from one aggregation, without any sorting of long postings.
For a query, a few of its best blocks give seeds, whose k-th score is a floor. Then

- terms whose largest contributions together stay below the floor can't lift a passage over it by themselves, so they
  make no candidate, and
- nor does a block of another term whose largest weight and the largest of all the query's other terms stay below.

Whatever stands in a block that is left is a candidate and is scored exactly. A floor that came from fewer than k seeds
is zero: then nothing is skipped, and the result is whole all the same. Of passages only the terms that some query asks
for are kept, a passage's in one row, so its scores with all queries come from one task and no pair is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.operators import retrieval, similarity

#: Blocks a factor of two of weight; seeds a place that is asked for; what rounding may cost a bound.
BLOCKS, SEEDS, SLACK = 4, 4, 1e-8


class Index(NamedTuple):
    """corpus: retrieval.Corpus. blocks: term, block, most, n_docs, of the terms that are asked for."""

    corpus: retrieval.Corpus
    blocks: DataFrame


_idf = retrieval.idf


def index(passages: DataFrame, queries: DataFrame) -> Index:
    """passages: doc_id, text. queries: query_id, text. Everything is written; a text is split into terms once."""
    own = retrieval.corpus(queries, passages)
    blocks = _placed(own).groupBy("term", "block").agg(F.max("u").alias("most"), F.count(F.lit(1)).alias("n_docs"))
    return Index(own, similarity.written(blocks, "block-weights"))


def _placed(own: retrieval.Corpus) -> DataFrame:
    """retrieval.exploded() with u (the weight that makes blocks) and block."""
    rows = retrieval.exploded(own).withColumn("u", F.col("tf") / F.sqrt("norm2"))
    return rows.withColumn("block", F.floor(-BLOCKS * F.log2("u")).cast("int"))


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= retrieval.BROADCAST_TERMS else rows


class Asked(NamedTuple):
    """terms: query_id, term, qw. lengths: query_id, qnorm2. n: rows of terms. bounds: query_id, term, block, n_docs, part (its most of the score), whole (the term's most), all (of all the query's terms)."""

    terms: DataFrame
    lengths: DataFrame
    n: int
    bounds: DataFrame


def asked(own: Index) -> Asked:
    """The terms of the index's queries and what they can give.

    A query counts as one document more, so a passage's norm falls at the terms they share; it stays above the norm
    without the query times the least ratio of weights, which bounds every score from above.
    """
    n = own.corpus.n
    after = _idf(n, F.coalesce("df", F.lit(0)) + 1)
    terms = own.corpus.asked.select("query_id", "term", "qw", after.alias("after"), (after / _idf(n, F.col("df"))).alias("ratio"))
    terms = similarity.written(terms, "asked")
    lengths = terms.groupBy("query_id").agg(F.sum(F.col("qw") * F.col("qw")).alias("qnorm2"), F.least(F.lit(1.0), F.min("ratio")).alias("least"))
    part = F.col("qw") * F.col("after") * F.col("most") / (F.sqrt("qnorm2") * F.col("least"))
    bounds = terms.join(lengths, "query_id").join(own.blocks, "term").select("query_id", "term", "block", "n_docs", part.alias("part"))
    whole = bounds.groupBy("query_id", "term").agg(F.max("part").alias("whole"))
    rising = W.partitionBy("query_id").orderBy("whole", "term").rowsBetween(W.unboundedPreceding, W.currentRow)  # a query's own words: few
    whole = whole.withColumns({"up_to": F.sum("whole").over(rising), "all": F.sum("whole").over(W.partitionBy("query_id"))})
    bounds = similarity.written(bounds.join(whole, ["query_id", "term"]), "bounds")
    return Asked(terms.select("query_id", "term", "qw"), lengths.select("query_id", "qnorm2"), own.corpus.n_asked, bounds)


def _cosines(own: Index, ask: Asked, rows: DataFrame, *more: Column) -> DataFrame:
    """query_id, doc_id, score and more of rows (query_id, doc_id, norm2, tf, df, qw) of whole pairs."""
    w1, w0 = F.col("tf") * _idf(own.corpus.n, F.col("df") + 1), F.col("tf") * _idf(own.corpus.n, F.col("df"))
    met = rows.groupBy("query_id", "doc_id").agg(F.sum(w1 * F.col("qw")).alias("dot"), F.sum(w1 * w1 - w0 * w0).alias("more"), F.first("norm2").alias("norm2"), *more)
    cosine = F.col("dot") / F.sqrt((F.col("norm2") + F.col("more")) * F.col("qnorm2"))
    return met.join(_few(ask.lengths, ask.n), "query_id").withColumn("score", F.round(cosine, 9)).drop("dot", "more", "norm2", "qnorm2")


def seeds(own: Index, ask: Asked, k: int) -> DataFrame:
    """Scores of what stands in each query's best blocks, SEEDS times k postings or more where it has as many."""
    best = W.partitionBy("query_id").orderBy(F.desc("part"), "term", "block")
    before = F.coalesce(F.sum("n_docs").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = similarity.written(ask.bounds.withColumn("before", before).where(F.col("before") < SEEDS * k).select("query_id", "term", "block"), "first-blocks")
    n = first.count()
    standing = _placed(own.corpus).select("doc_id", "term", "block").join(_few(first, n), ["term", "block"]).select("query_id", "doc_id").distinct()
    pairs = similarity.written(standing, "first")
    rows = pairs.join(retrieval.exploded(own.corpus), "doc_id").join(_few(ask.terms, ask.n), ["query_id", "term"])
    return similarity.written(_cosines(own, ask, rows), "seeds")


def floors(rows: DataFrame, k: int, by: str = "score") -> DataFrame:
    """query_id, floor: the k-th value of each query that has as many."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(by), "doc_id"))
    return rows.withColumn("_place", place).where(F.col("_place") == k).select("query_id", F.col(by).alias("floor"))


def above(own: Index, ask: Asked, floor: DataFrame) -> DataFrame:
    """query_id, doc_id, score of all that can reach its query's floor (query_id, floor; none: of all that shares a term), and more. Not written.

    A term's blocks fall in weight as they rise in number, so those wanted are the first ones up to a last.
    """
    rows = ask.bounds.join(floor, "query_id", "left").withColumn("floor", F.coalesce(F.col("floor") - SLACK, F.lit(0.0)))
    essential = F.col("up_to") >= F.col("floor")
    reaches = F.col("part") + F.col("all") - F.col("whole") >= F.col("floor")
    last = similarity.written(rows.where(essential & reaches).groupBy("query_id", "term").agg(F.max("block").alias("last")), "last-blocks")
    terms = _few(ask.terms.join(last, ["query_id", "term"], "left"), ask.n)
    wanted = F.max(F.coalesce(F.col("block") <= F.col("last"), F.lit(False))).alias("wanted")
    return _cosines(own, ask, _placed(own.corpus).join(terms, "term"), wanted).where("wanted").drop("wanted")


def reaching(scores: DataFrame, floor: DataFrame) -> DataFrame:
    """scores that reach their query's floor, and all of a query that has none."""
    return scores.join(F.broadcast(floor), "query_id", "left").where(F.col("floor").isNull() | (F.col("score") >= F.col("floor") - SLACK)).drop("floor")


def top(passages: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best of each query (query_id, doc_id, score, rank), and per query how many pairs were candidates of how many that share a term.

    passages: doc_id, text. queries: query_id, text.
    """
    own = index(passages, queries)
    ask = asked(own)
    floor = similarity.written(floors(seeds(own, ask, k), k), "floors")
    rows = above(own, ask, floor)
    return retrieval.top(reaching(rows, floor), k), rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_scored"))
