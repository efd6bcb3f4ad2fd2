"""Referral edges between pages and sites, and who promotes whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import urls as U
from sourcelens.operators.pages import AFFILIATE_LINK

#: An address in running text; marks at its end belong to the sentence.
ADDRESS = r"(https?://[^\s\])>\"']+)"


def _external(edges: DataFrame) -> DataFrame:
    """Edges to other registrable domains, with target_domain."""
    domain = lambda c: U.registrable_domain(U.authority(F.col(c)))
    out = edges.withColumn("target_domain", domain("target_url"))
    return out.where((F.col("target_domain") != "") & (F.col("target_domain") != domain("source_url")))


def text_edges(pages: DataFrame) -> DataFrame:
    """source_url, segment, target_url, target_domain: addresses that a page's text names. pages: url, text."""
    found = pages.select(F.col("url").alias("source_url"), F.lit("text").alias("segment"), F.explode(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(1))).alias("target_url"))
    return _external(found.withColumn("target_url", F.regexp_replace("target_url", r"[.,;:!?]+$", "")).distinct())


def link_edges(links: DataFrame, *by: str) -> DataFrame:
    """source_url, source_role, segment, target_url, target_domain, anchor, affiliate: a page's links to other sites, each address once whatever its case and last slash.

    links: as page_links gives them, with the columns by.
    """
    own = links.where(F.col("external") & F.col("target").rlike("(?i)^[a-z][a-z0-9+.-]*://[^/?#]"))
    told = own.select(
        *by, F.col("url").alias("source_url"), U.page_role(F.col("url")).alias("source_role"), F.when(F.col("chrome"), "chrome").otherwise("main").alias("segment"), F.col("target").alias("target_url"), "target_domain",
        "anchor", F.col("target").rlike(AFFILIATE_LINK).alias("affiliate"), F.lower(F.regexp_replace("target", "/+$", "")).alias("_t"),
    )
    names = ["source_role", "target_url", "target_domain", "anchor", "affiliate"]
    one = told.groupBy(*by, "source_url", "segment", "_t").agg(F.min_by(F.struct(*names), F.struct("target_url", "anchor")).alias("e"))
    return one.select(*by, "source_url", "segment", "e.*")


def referral_edges(*sources: DataFrame) -> DataFrame:
    """All edges, each source, segment and target once, whatever the target's case; the first spelling by name stays."""
    own = sources[0]
    for more in sources[1:]:
        own = own.unionByName(more, allowMissingColumns=True)
    own = _external(own.drop("target_domain"))
    return own.groupBy("source_url", "segment", F.lower("target_url").alias("_t")).agg(F.min("target_url").alias("target_url"), F.first("target_domain").alias("target_domain")).drop("_t")


def promotion(edges: DataFrame, role_of: DataFrame, least_hosts: int = C.CONVERGENCE_HOSTS) -> DataFrame:
    """Per target domain: n_edges, concentration, n_hosts, converges, n_cross_platform.

    edges: source_url, target_domain. role_of: url, role; hosts with a thread, review or listicle page are cross-platform.
    """
    own = edges.join(role_of.withColumnRenamed("url", "source_url"), "source_url", "left").withColumn("host", U.registrable_domain(U.authority(F.col("source_url"))))
    placed = own.groupBy("target_domain", "host").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("role").isin("ugc_thread", "review_profile", "expert_listicle"), F.lit(False))).alias("cross"))
    out = placed.groupBy("target_domain").agg(F.sum("n").alias("n_edges"), F.count(F.lit(1)).alias("n_hosts"), F.count_if("cross").alias("n_cross_platform"))
    total = out.agg(F.sum("n_edges").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("target_domain", "n_edges", F.round(F.col("n_edges") / F.col("total"), 9).alias("concentration"), "n_hosts", (F.col("n_hosts") >= least_hosts).alias("converges"), "n_cross_platform")


def pointing_at(edges: DataFrame, target: str) -> DataFrame:
    """Edges to one registrable domain."""
    return edges.where(F.lower("target_domain") == target.lower())
