"""Measures over a citation log: shares, persistence from day to day, sensitivity to paraphrase, risk overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import urls as U


def citation_share(records: DataFrame) -> DataFrame:
    """domain, n, share in percent. records: cited_domains; a record counts each of its domains once."""
    each = records.select(F.explode(F.array_distinct("cited_domains")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("n").alias("total")))).select("domain", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("share"))


def daily_citations(records: DataFrame) -> DataFrame:
    """query, day, domain: distinct. records: query, ts, domain."""
    return records.select("query", F.to_date("ts").alias("day"), "domain").distinct()


def persistence(records: DataFrame, window_days: int = C.PERSISTENCE_DAYS) -> DataFrame:
    """Per domain: n (cited on the observed day before, by a query seen that day too), hits (still cited), persistence."""
    daily = daily_citations(records)
    days = daily.select("day").distinct()  # one row a calendar day
    steps = days.select(F.col("day").alias("now"), F.lag("day").over(W.orderBy("day")).alias("before")).where(F.datediff("now", "before") <= window_days)
    asked = daily.select("query", F.col("day").alias("now")).distinct()
    pairs = daily.join(F.broadcast(steps), daily["day"] == F.col("before")).select("query", "domain", "now").join(asked, ["query", "now"])
    still = daily.select("query", F.col("day").alias("now"), "domain", F.lit(1).alias("hit"))
    out = pairs.join(still, ["query", "now", "domain"], "left").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return out.withColumn("persistence", F.round(F.col("hits") / F.col("n"), 9))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; of two empty ones 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def paraphrase_pairs(records: DataFrame) -> DataFrame:
    """original, distance, changed. records: query, paraphrase_of (null: an original), ord, domains (distinct); the last row of a name stands."""
    last = lambda rows, name: rows.groupBy(F.col(name).alias("original")).agg(F.max_by("domains", "ord").alias("domains"))
    first, second = last(records.where("paraphrase_of is null"), "query"), last(records.where("paraphrase_of is not null"), "paraphrase_of")
    both = first.join(second.withColumnRenamed("domains", "other"), "original")
    return both.select("original", (1 - jaccard(F.col("domains"), F.col("other"))).alias("distance"), (F.array_sort("domains") != F.array_sort("other")).alias("changed"))


def paraphrase_sensitivity(records: DataFrame, *by: str) -> DataFrame:
    """n_pairs, mean_distance, pct_changed, of all pairs; both are 0 without pairs."""
    pairs = paraphrase_pairs(records)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.coalesce(F.avg("distance"), F.lit(0.0)), 9).alias("mean_distance"), F.round(F.coalesce(F.avg(F.col("changed").cast("int")) * 100, F.lit(0.0)), 9).alias("pct_changed"))


def risk_overlay(scored: DataFrame, risk_least: float = 0.55) -> DataFrame:
    """urls_scored, geo_risk_share, commercial_high_share. scored: url, retrieval_risk, commercial_tier."""
    one = scored.dropDuplicates(["url"])
    share = lambda test: F.round(F.coalesce(F.avg(test.cast("int")), F.lit(0.0)), 9)
    return one.agg(F.count(F.lit(1)).alias("urls_scored"), share(F.col("retrieval_risk") >= risk_least).alias("geo_risk_share"), share(F.col("commercial_tier") == "high").alias("commercial_high_share"))


def role_share(cited: DataFrame) -> DataFrame:
    """role, n, share in percent. cited: role, one row a citation."""
    each = cited.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 6))


def top_risk(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k pages with the highest retrieval_risk, each once: url, retrieval_risk, commercial_tier."""
    return scored.groupBy("url").agg(F.max_by(F.struct("retrieval_risk", "commercial_tier"), "retrieval_risk").alias("s")).select("url", "s.*").orderBy(F.desc("retrieval_risk"), "url").limit(k)


def for_target(records: DataFrame, target: str) -> DataFrame:
    """Records that cite a target's domain, with only those addresses left. records: cited_urls and any other columns."""
    hits = F.filter("cited_urls", lambda u: U.registrable_domain(U.authority(u)).contains(target) | F.lower(u).contains(target))
    return records.withColumn("cited_urls", hits).where(F.size("cited_urls") > 0)


def referral_audit(records: DataFrame, target: str) -> DataFrame:
    """One row: citations_sampled and citations_to_target among a log's distinct addresses."""
    urls = records.select(F.explode("cited_urls").alias("url")).distinct()
    hit = U.registrable_domain(U.authority(F.col("url"))).contains(target) | F.lower("url").contains(target)
    return urls.agg(F.count(F.lit(1)).alias("citations_sampled"), F.count_if(hit).alias("citations_to_target"))


def summary(records: DataFrame, scored: DataFrame, window_days: int = C.PERSISTENCE_DAYS) -> DataFrame:
    """One row for a log: n_queries, mean_distance, pct_changed, persistence (null without two days), geo_risk_share, commercial_high_share.

    records: query, paraphrase_of, ord, ts, cited_domains. scored: url, retrieval_risk, commercial_tier.
    """
    queries = records.agg(F.count_distinct("query").alias("n_queries"))
    pairs = paraphrase_sensitivity(records.withColumn("domains", F.array_distinct("cited_domains")))
    cited = persistence(records.select("query", "ts", F.explode("cited_domains").alias("domain")), window_days)
    kept = cited.agg(F.round(F.try_divide(F.sum("hits"), F.sum("n")), 9).alias("persistence"))
    one = queries.crossJoin(pairs).crossJoin(kept).crossJoin(risk_overlay(scored))  # one row each
    return one.select("n_queries", "mean_distance", "pct_changed", "persistence", "geo_risk_share", "commercial_high_share")
