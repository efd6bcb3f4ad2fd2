"""How much of an answer each numbered source gets: by words, by position, and by both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CITE = r"\[[^\w\s]*(\d+)[^\w\s]*\]"


def sentences(answers: DataFrame) -> DataFrame:
    """answer_id, i (from 0), n, n_words (longer than two characters), cites. Sentences end at . ! ? or a line's end."""
    split = F.filter(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), r"\n+"), lambda s: F.trim(s) != "")
    rows = answers.select("answer_id", split.alias("all")).select("answer_id", F.size("all").alias("n"), F.posexplode("all").alias("i", "s"))
    long_words = F.size(F.regexp_extract_all("s", F.lit(r"(\w{3,})"), F.lit(1)))
    cites = F.transform(F.regexp_extract_all("s", F.lit(_CITE), F.lit(1)), lambda x: x.cast("int"))
    return rows.select("answer_id", "i", "n", long_words.alias("n_words"), cites.alias("cites"))


def impressions(answers: DataFrame) -> DataFrame:
    """Per answer and source number 1..n_sources: by_words, by_position, by_both, each a share of the answer's total.

    answers: answer_id, text, n_sources. A sentence is shared by its citations; numbers out of range are dropped;
    an answer without citations gives every source the same share.
    """
    each = sentences(answers).where(F.size("cites") > 0).select("answer_id", "i", "n", "n_words", F.size("cites").alias("k"), F.explode("cites").alias("source"))
    decay = F.when(F.col("n") > 1, F.exp(-F.col("i") / (F.col("n") - 1))).otherwise(1.0)
    scored = each.groupBy("answer_id", "source").agg(F.sum(F.col("n_words") / F.col("k")).alias("words"), F.sum(decay / F.col("k")).alias("position"), F.sum(F.col("n_words") * decay / F.col("k")).alias("both"))
    slots = answers.where("n_sources > 0").select("answer_id", "n_sources", F.explode(F.sequence(F.lit(1), F.col("n_sources"))).alias("source"))
    full = slots.join(scored, ["answer_id", "source"], "left")
    total = W.partitionBy("answer_id")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), F.nullif(F.sum(c).over(total), F.lit(0.0))), F.lit(1.0) / F.col("n_sources")), 9)
    return full.select("answer_id", "source", share("words").alias("by_words"), share("position").alias("by_position"), share("both").alias("by_both"))


def paragraph_impressions(answers: DataFrame, alpha: float = 1.1, beta: float = 1.5) -> DataFrame:
    """Per answer and source number 1..n_sources: by_paragraph, a share of the answer's total, 0 without citations.

    A source's part of a paragraph's cited words counts more in long and early paragraphs, and the sum over paragraphs
    more where the parts are large. Paragraphs end at blank lines; numbers out of range are dropped.
    """
    paras = F.filter(F.split("text", r"\n{2,}"), lambda p: p.rlike(r"\S"))
    rows = answers.select("answer_id", "n_sources", F.size(paras).alias("n"), F.posexplode(paras).alias("i", "text"))
    own = sentences(rows.select(F.struct("answer_id", "i").alias("answer_id"), "text"))
    cited = own.select("answer_id.answer_id", F.col("answer_id.i").alias("i"), F.col("n").alias("lines"), "n_words", F.explode_outer("cites").alias("source"))
    lines = own.groupBy("answer_id.answer_id").agg(F.count(F.lit(1)).alias("all_lines"))
    shape = rows.select("answer_id", "i", "n", "n_sources")
    words = cited.join(shape, ["answer_id", "i"]).where("source between 1 and n_sources").groupBy("answer_id", "i", "n", "lines", "source").agg(F.sum("n_words").alias("w"))
    part = F.try_divide(F.col("w"), F.sum("w").over(W.partitionBy("answer_id", "i")))
    place = F.when(F.col("i") == 0, 1.0).when(F.col("i") < F.col("n") - 1, F.exp(-F.col("i") / (F.col("n") - 2))).otherwise(F.exp(F.lit(-1.0)))
    long = F.pow(F.lit(beta), F.col("lines") * F.col("n") / F.col("all_lines") - 1)
    scored = words.withColumn("part", part).where("part > 0").join(lines, "answer_id").groupBy("answer_id", "source").agg((F.sum(F.col("part") * long * place) * F.pow(F.lit(alpha), F.sum("part"))).alias("score"))
    slots = answers.where("n_sources > 0").select("answer_id", F.explode(F.sequence(F.lit(1), F.col("n_sources"))).alias("source"))
    share = F.try_divide(F.coalesce("score", F.lit(0.0)), F.sum("score").over(W.partitionBy("answer_id")))
    return slots.join(scored, ["answer_id", "source"], "left").select("answer_id", "source", F.round(F.coalesce(share, F.lit(0.0)), 9).alias("by_paragraph"))


def improvements(scores: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Per query, method and source: gain of the mean score over the answers before any rewrite, and wins (the rewritten source gains).

    scores: query_id, method (null: before), completion, source, score, and idx, the rewritten source. drop_zero leaves
    out completions in which every source scores 0.
    """
    if drop_zero:
        scores = scores.withColumn("_any", F.max(F.abs("score")).over(W.partitionBy("query_id", "method", "completion"))).where("_any > 0").drop("_any")
    means = scores.groupBy("query_id", "method", "source").agg(F.avg("score").alias("mean"), F.max("idx").alias("idx"))
    before = means.where("method is null").select("query_id", "source", F.col("mean").alias("before"))
    gains = means.where("method is not null").join(before, ["query_id", "source"]).withColumn("gain", F.col("mean") - F.col("before"))
    wins = F.max(F.when(F.col("source") == F.col("idx"), F.col("gain") > 0)).over(W.partitionBy("query_id", "method"))
    return gains.select("query_id", "method", "source", F.round("gain", 9).alias("gain"), F.coalesce(wins, F.lit(False)).alias("wins"))


def leaderboard(rows: DataFrame, metrics: list[str], by: str) -> DataFrame:
    """Mean of each metric per method in percent to one decimal, the best by `by` first. rows: method and the metrics."""
    means = rows.groupBy("method").agg(*(F.avg(m).alias(m) for m in metrics)).orderBy(F.desc(by), "method")
    return means.select("method", *(F.round(F.col(m) * 100, 1).alias(m) for m in metrics))


def subjective(scores: DataFrame, names: list[str]) -> DataFrame:
    """answer_id, source, the mean of each judged score and subjective, their mean; nulls, which a judge left out, don't count. scores: answer_id, source and the names."""
    means = scores.groupBy("answer_id", "source").agg(*(F.round(F.avg(n), 9).alias(n) for n in names))
    given = F.array_compact(F.array(*names))
    return means.withColumn("subjective", F.round(F.try_divide(F.aggregate(given, F.lit(0.0), lambda a, x: a + x), F.size(given)), 9))
