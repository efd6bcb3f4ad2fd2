"""The last check before an answer: what a query's ranked sources together allow it to say.

Features of a query are one aggregation over its ranked rows; the verdict is a `when` chain on the leading row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T
from sourcelens.functions import urls as U
from sourcelens.operators import claims, pages, signals

INSTITUTION_TRUST, INSTITUTION_DAYS, SOUND_TRUST = 0.75, 365 * 5, 0.55
COORDINATED_LEAST = 0.35


def is_institution(host: Column, trust: Column, whois_age_days: Column) -> Column:
    return host.contains(".gov") | host.contains(".edu") | F.coalesce((trust >= INSTITUTION_TRUST) & (whois_age_days > INSTITUTION_DAYS), F.lit(False))


def query_context(clusters: DataFrame, visibility: DataFrame) -> DataFrame:
    """query_id, consensus, dominance. clusters: query_id, n_urls, n_clusters (null: not analysed), max_similarity.
    visibility: query_id, dominant_share in percent, alert; a query without it has no dominance."""
    rows = clusters.join(visibility, "query_id", "left")
    together = (F.col("n_clusters") == 1) & (F.col("n_urls") >= 2) & (F.col("max_similarity") >= COORDINATED_LEAST)
    consensus = F.when(together, "coordinated").when(F.col("n_clusters") < 2, "shaky").otherwise("healthy")
    share = F.coalesce(F.col("dominant_share") / 100, F.lit(0.0))
    return rows.select("query_id", consensus.alias("consensus"), F.when(F.coalesce("alert", F.lit(False)), F.greatest(share, F.lit(0.65))).otherwise(share).alias("dominance"))


def corroboration(sources: DataFrame, claims_: DataFrame) -> DataFrame:
    """Per query's claim: n_support, institutional, endorsement_allowed, reasons.

    sources: query_id, host, text, trust, endorsement_allowed, whois_age_days. claims_: query_id, claim, intent, n_clusters.
    """
    rows = claims_.join(sources.select("query_id", "host", "text", "trust", "endorsement_allowed", "whois_age_days"), "query_id", "left")
    names = F.coalesce(F.lower(F.substring("text", 1, signals.EXCERPT)).contains(F.lower("claim")), F.lit(False))
    support = names & (F.col("trust") >= SOUND_TRUST) & F.coalesce("endorsement_allowed", F.lit(False))
    backed = names & is_institution(F.col("host"), F.col("trust"), F.col("whois_age_days"))
    by = ["query_id", "claim", "intent", "n_clusters"]
    out = rows.groupBy(*by).agg(F.count_if(support).alias("n_support"), F.coalesce(F.bool_or(backed), F.lit(False)).alias("institutional"))
    asks_fact = F.col("intent").startswith("informational")
    told = F.array_compact(F.array(
        F.when(F.col("n_clusters") < 2, F.format_string("only_%d_independent_text_cluster(s)", F.col("n_clusters").cast("int"))),
        F.when(F.col("n_support") < 2, F.format_string("only_%d_trusted_source(s)_mention_%s", F.col("n_support"), F.col("claim"))),
        F.when(asks_fact & ~F.col("institutional"), "no_institutional_corroboration"),
    ))
    return out.select("query_id", "claim", "n_support", "institutional", ((F.col("n_clusters") >= 2) & (F.col("n_support") >= 2) & (~asks_fact | F.col("institutional"))).alias("endorsement_allowed"), told.alias("reasons"))


def _mode(factual: Column) -> Column:
    return F.when(factual == "deny", "refuse_factual_use").when(factual == "require_corroboration", "hedged_answer").when(factual == "attribute_only", "attributed_answer").otherwise("direct_answer")


def features(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query with rows: what verdicts() decides on. See there for the columns."""
    place = W.partitionBy("query_id").orderBy("rank")
    usable = F.coalesce(F.col("mention_permission") != "deny", F.lit(True))
    rows = ranked.withColumn("usable", usable).withColumn("place", F.when(F.col("usable"), F.row_number().over(W.partitionBy("query_id", "usable").orderBy("rank"))))
    own = rows.join(queries.select("query_id", F.col("entity").alias("_given")), "query_id", "left")
    named = F.coalesce("_given", F.get(claims.names(F.col("text")), F.lit(0)), F.lit("unknown"))
    own = own.withColumn("entity", F.first(F.when(F.col("place") == 1, named), ignorenulls=True).over(W.partitionBy("query_id")))
    names = F.col("usable") & F.lower("text").contains(F.lower("entity"))
    role, segment = F.col("role"), F.coalesce("segment", F.lit("body"))
    institution = is_institution(F.col("host"), F.col("trust"), F.col("whois_age_days"))
    soft = pages.is_low_trust(segment, role)
    planted = F.array_contains("flags", "planted_mention") | (F.col("semantic_risk") >= 0.45)
    parasitic = U.is_parasitic(F.col("url"), role, planted)
    editorial = role.isin("institutional", "editorial") | ((role == "factual_blog") & segment.isin("main_post", "body") & (F.col("trust") >= SOUND_TRUST))
    lead = lambda c: F.max(F.when(F.col("place") == 1, c))  # noqa: E731  one row a query
    has = lambda flag: F.array_contains("flags", flag)
    plain = T.plain(F.coalesce("text", F.lit("")))
    hedged = has("balanced_hedging") | has("mentions_alternatives") | plain.rlike(C.ALTERNATIVES)
    return own.groupBy("query_id").agg(
        F.count_if("usable").alias("n_usable"),
        F.count_if(~F.col("usable")).alias("n_skipped"),
        F.max("entity").alias("entity"),
        F.count_distinct(F.when(names & (F.col("trust") >= 0.5) & ~soft, F.coalesce("host", "url"))).alias("n_support"),
        F.bool_or(names & editorial).alias("editorial"),
        F.bool_or(institution).alias("any_institution"),
        F.count_if(names).alias("n_names"),
        F.count_if(names & (soft | parasitic)).alias("n_soft"),
        F.count_distinct(F.when(names, F.col("url"))).alias("n_urls"),
        F.bool_or(names & institution).alias("names_institution"),
        F.max(F.when(names, F.col("trust"))).alias("most_trust"),
        lead(F.col("url")).alias("lead_url"),
        lead(F.col("trust")).alias("lead_trust"),
        lead(F.col("factual_permission")).alias("factual"),
        lead(F.col("endorsement_permission")).alias("endorsement"),
        lead(F.col("endorsement_allowed")).alias("lead_allowed"),
        lead(F.col("response_mode")).alias("commercial_mode"),
        lead(plain.rlike(C.MEDICAL_CLAIM)).alias("cures"),
        lead(plain.rlike(C.ENDORSES)).alias("endorses"),
        lead(hedged).alias("hedged"),
        lead(has("planted_mention")).alias("planted"),
    )


def verdicts(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: kind, passed, action, response_mode, entity, skipped. The first rule that holds decides.

    ranked: query_id, rank, url, host, role, segment, text, trust, whois_age_days, semantic_risk, flags, the permissions,
    endorsement_allowed, response_mode (of commerce, or null). queries: query_id, query, intent, entity (null: the first
    name of the leading text), consensus, n_clusters (of the texts that name the entity; null: not analysed).
    """
    f = queries.drop("entity").join(features(ranked, queries), "query_id", "left")
    none, asks = F.coalesce("n_usable", F.lit(0)) == 0, T.plain(F.coalesce("query", F.lit(""))).rlike(C.WANTS_RECOMMENDATION)
    synthetic = (F.col("n_clusters") == 1) & (F.col("n_urls") >= 2) & ~F.col("names_institution") & (F.col("most_trust") < SOUND_TRUST)
    low, relief = F.col("lead_trust") < C.TRUST_ENDORSEMENT_MIN, F.col("editorial") | F.col("any_institution")
    soft_only, denied = (F.col("n_names") >= 1) & (F.col("n_names") == F.col("n_soft")), F.coalesce(F.col("endorsement") == "deny", F.lit(False))
    balanced = (F.col("lead_trust") >= SOUND_TRUST) & F.col("hedged")
    mode = _mode(F.col("factual"))
    rule = lambda kind, passed, action, how: F.struct(F.lit(kind).alias("kind"), passed.alias("passed"), F.lit(action).alias("action"), how.alias("response_mode"))
    yes, no, said = F.lit(True), F.lit(False), F.lit
    told = (
        F.when(F.col("n_usable").isNull(), rule("mention", yes, "empty_retrieval", said("defer_fetch")))
        .when(none, rule("mention", no, "omit_unmentionable_sources", said("omit_sources")))
        .when(F.col("consensus") == "coordinated", rule("false_consensus", no, "reject_consensus", said("refuse_endorsement")))
        .when(synthetic, rule("false_consensus", no, "reject_false_consensus", said("refuse_endorsement")))
        .when(F.col("factual") == "deny", rule("factual_claim", no, "block_factual_use", said("refuse_factual_use")))
        .when(F.col("cures") & F.col("intent").endswith("high_stakes") & (F.col("lead_trust") < SOUND_TRUST), rule("factual_claim", no, "downgrade_to_attribution", said("attributed_answer")))
        .when(balanced, rule("mention", yes, "pass_balanced_editorial", F.when(mode != "direct_answer", mode).otherwise("hedged_answer")))
        .when(F.col("factual") == "attribute_only", rule("mention", yes, "attribute_only", said("attributed_answer")))
        .when(F.col("factual") == "require_corroboration", rule("factual_claim", no, "require_corroboration", said("hedged_answer")))
        .when(soft_only & ~relief & low & F.col("endorses") & (asks | denied), rule("endorsement", no, "block_endorsement_ugc_only_cluster", said("refuse_endorsement")))
        .when(soft_only & ~relief & low & F.col("planted") & ~F.col("endorses") & asks, rule("mention", yes, "hedge_ugc_planted_cluster", said("hedged_answer")))
        .when((F.col("endorses") | denied) & low & ((F.col("n_support") < 2) | ~F.coalesce("lead_allowed", no)), rule("endorsement", F.col("n_support") >= 2, "block_endorsement_insufficient_corroboration", said("refuse_endorsement")))
        .otherwise(rule("mention", yes, "pass_through", F.coalesce("commercial_mode", mode)))
    )
    return f.withColumn("v", told).select("query_id", "v.*", "entity", "lead_url", F.coalesce(F.col("n_skipped") > 0, F.lit(False)).alias("skipped"))
