"""Tiers of cited pages, and the list of domains that comes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import urls as U

#: Columns that list_tiers reads, with what stands for a missing one or a null.
DEFAULTS = {
    "is_ugc": False, "semantic_risk": 0.0, "retrieval_risk": 0.0, "endorsement_risk": 0.0, "n_high_risk": 0, "coordinated": False, "elevated": False,
    "parasitic_risk": 0.0, "n_verified": 0, "n_editorial": 0, "discovery": "", "role": "", "confidence": "low",
}
UNSETTLED = ["inconclusive", "skipped", "unknown"]


def list_tiers(rows: DataFrame) -> DataFrame:
    """Adds tier and mechanisms. rows: llm_action, and of DEFAULTS, suspected, share and status what there is."""
    col = {name: F.coalesce(F.col(name), F.lit(v)) if name in rows.columns else F.lit(v) for name, v in DEFAULTS.items()}
    known = lambda name, kind: F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    action, suspected, share = F.col("llm_action"), known("suspected", "boolean"), known("share", "double")
    given = known("status", "string")
    status = F.coalesce(given, F.when(col["is_ugc"], "skipped").otherwise("unknown"))
    sure = lambda test: F.coalesce(test, F.lit(False))
    referred = sure(suspected) | (col["n_high_risk"] >= 2) | col["coordinated"]
    page_hard = sure(action.isin(C.HARD_ACTIONS)) & ~referred
    raised = F.greatest(col["semantic_risk"], col["retrieval_risk"], col["endorsement_risk"]) >= 0.35
    page_soft = ~page_hard & (sure(action.isin(C.SOFT_ACTIONS)) | raised)
    band = (col["n_verified"] >= 10) & (col["n_editorial"] == 0) & sure(share.between(0.35, 0.5))
    unreferred = (col["n_verified"] == 0) & col["discovery"].isin("success", "partial") & sure(~given.isin("inconclusive", "skipped")) & ~col["role"].isin("editorial", "institutional")
    soft = sure(given == "sparse_suspicious") | (col["n_high_risk"] == 1) | band | col["elevated"] | ((col["parasitic_risk"] >= 0.35) & ~sure(suspected)) | unreferred
    referred_soft = ~referred & soft
    settled = status.isin("complete", "sparse")
    strong = ~col["is_ugc"] & (col["n_verified"] >= 10) & settled & (col["confidence"] != "low")
    weak = col["is_ugc"] | status.isin(*UNSETTLED, "sparse_suspicious") | (col["n_verified"] < 5) | (suspected.isNull() & settled)
    any_hard, any_soft = page_hard | referred, page_soft | referred_soft
    tier = (
        F.when(page_hard & referred & strong & ~weak, "very_high")
        .when(any_hard & strong & ~weak, "high")
        .when(any_hard, "medium")
        .when(any_soft & strong, "medium")
        .when(any_soft | col["is_ugc"] | weak | status.isin(UNSETTLED), "review")
        .when(action.isNull() | (action == "pass"), "clean")
        .otherwise("review")
    )
    mechanisms = F.array_compact(F.array(F.when(page_hard | page_soft, "on_page"), F.when(referred | referred_soft, "referrer")))
    return rows.withColumns({"tier": tier, "mechanisms": mechanisms})


def _rank(tier: Column) -> Column:
    return F.array_position(F.lit(C.TIERS), tier)


def domain_tiers(rows: DataFrame, samples: int = 8) -> DataFrame:
    """Per registrable domain: tier (the worst; the two worst need two queries), n_queries, mechanisms, urls (the first few by name).

    rows: query, url, tier, mechanisms. Rows without a url are left out.
    """
    own = rows.where(F.coalesce("url", F.lit("")) != "").withColumn("domain", U.registrable_domain(U.authority(F.col("url"))))
    worst = own.groupBy("domain").agg(
        F.min(_rank(F.col("tier"))).alias("rank"),
        F.count_distinct("query").alias("n_queries"),
        F.max(F.array_contains("mechanisms", "on_page")).alias("on_page"),
        F.max(F.array_contains("mechanisms", "referrer")).alias("referrer"),
    )
    place = F.row_number().over(W.partitionBy("domain").orderBy("url"))
    urls = own.select("domain", "url").distinct().withColumn("k", place).where(F.col("k") <= samples).groupBy("domain").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    rank = F.when(F.col("n_queries") < 2, F.greatest("rank", F.lit(C.TIERS.index("medium") + 1))).otherwise(F.col("rank"))
    return worst.join(urls, "domain").select(
        "domain",
        F.element_at(F.lit(C.TIERS), rank.cast("int")).alias("tier"),
        "n_queries",
        F.array_compact(F.array(F.when(F.col("on_page"), "on_page"), F.when(F.col("referrer"), "referrer"))).alias("mechanisms"),
        "urls",
    )
