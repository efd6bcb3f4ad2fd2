"""What an answer may do with a source: subscores, four permissions, the actions that follow from them.

All of it is columns over one row per (query, source): cascades are `when` chains in the order in which rules win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T
from sourcelens.functions import urls as U
from sourcelens.operators import signals

# Patterns and the order of severity.
BRAND_LEGIT = r"\b(legit|scam|trustworthy|safe\s+to\s+buy|good\s+brand|real\s+brand|worth\s+it|trusted)\b"
UGC_INTENT = r"\b(reddit|forums?|quora|tiktok|ugc|community|youtube\s+comments?)\b"
REFERENCE_PATH = r"(?i)/(wiki|baike|docs|reference|encyclopedia)\b"
COMMERCIAL_PATH = r"(?i)/(pricing|buy|shop|cart|checkout|trial)\b"
ACTION_ORDER = ["reject", "reject_consensus", "defer_fetch", "block_factual_use", "block_endorsement", "require_corroboration", "require_authoritative_corroboration", "attribute_only", "mention_only", "downrank", "pass"]
STRICTNESS = {
    "retrieve_permission": ["allow", "downrank", "defer", "reject"],
    "mention_permission": ["allow", "deny"],
    "factual_permission": ["allow", "attribute_only", "require_corroboration", "deny"],
    "endorsement_permission": ["allow", "deny"],
}


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _add(test: Column, value) -> Column:
    return F.when(test, value).otherwise(F.lit(0.0))


def subscores(rows: DataFrame) -> DataFrame:
    """Adds role, failure, confidence, reliability, mismatch, harm and endorsement_risk, and sets rhetorical and retrieval_risk anew.

    rows: url, text, query, intent, trust, the content signals, and of these what there is: ok, status_code, error,
    fetch_engine, commercial_score, commercial_tier, context_flags, list_items, concealment_risk, concealment_flags,
    whois_age_days, and role, where it is known already. A missing or null fact is the unknown one: fetched, no
    commerce, nothing hidden, no age.
    """
    has = lambda name, default: F.coalesce(F.col(name), default) if name in rows.columns else default
    ok, status = has("ok", F.lit(True)), has("status_code", F.lit(200))
    empty = F.array().cast("array<string>")
    commerce, hidden, context = has("commercial_score", F.lit(0.0)), has("concealment_risk", F.lit(0.0)), has("context_flags", empty)
    host, path, informational = U.hostname(F.col("url")), U.path(F.col("url")), F.col("intent").startswith("informational")
    wants = T.plain(F.coalesce("query", F.lit(""))).rlike(C.WANTS_RECOMMENDATION)
    balanced = F.arrays_overlap(F.col("flags"), F.array(F.lit("balanced_hedging"), F.lit("mentions_alternatives")))
    concealed = has("concealment_flags", empty)
    n = F.col("n_words")
    rhet = F.least(F.lit(1.0), F.col("rhetorical") + F.when(F.array_contains(concealed, "hidden_geo_rhetoric"), 0.2).when(F.array_contains(concealed, "hidden_chrome_rhetoric"), 0.08).otherwise(0.0))

    broken = F.lower(has("error", F.lit(""))).rlike("invalid url|unsupported protocol")
    failure = F.when((~ok & status.isin(404, 410)) | broken, "reject").when(~ok, "defer")
    browser = _add(has("fetch_engine", F.lit("")) == "playwright", 0.05)
    confidence = F.when(~ok & (failure == "reject"), 0.0).when(~ok, 0.2).otherwise(_clamp(0.75 + F.when(n >= 80, 0.15).when(n >= 40, 0.05).when(n < 20, -0.25).otherwise(0.0) + browser))
    risk = signals.retrieval_manipulation(rhet) + _add(F.array_contains(context, "faq_schema") & (rhet > 0.25), 0.12) + _add((has("list_items", F.lit(0)) > 8) & (rhet > 0.25), 0.08)
    risk = _clamp(risk + _add(commerce > 0.45, 0.1 * commerce) + _add(wants & (rhet > 0.3), 0.1) + 0.55 * hidden)
    established = has("whois_age_days", F.lit(0)) > 1095
    reliability = _clamp(
        0.55 + _add(balanced, 0.18) + _add(F.array_contains("flags", "quote_citation_heavy"), 0.08) + _add(established, 0.1) + _add(ok & (host.rlike(r"\.(gov|edu)$") | U.is_news(host)), 0.1) + _add(n < C.THIN_WORDS, -0.18)
        + _add(rhet > 0.45, -0.2 * rhet) + _add(informational & (commerce > 0.45) & ~wants, -0.2) + _add(F.array_contains("flags", "high_stakes_medical_claim") & (F.col("trust") < 0.55), -0.25)
        + _add(path.rlike(REFERENCE_PATH), 0.12)
    )
    sells, reference = path.rlike(COMMERCIAL_PATH), path.rlike(REFERENCE_PATH)
    plain = (_add(commerce > 0.5, 0.45) + _add(sells, 0.35)) * F.when(balanced, 0.3).otherwise(1.0) * F.when(reference, 0.2).otherwise(1.0)
    mismatch = F.when(F.col("intent").isin("commercial", "navigational"), F.when(sells, 0.0).when(commerce > 0.5, 0.15).otherwise(0.25)).otherwise(_clamp(plain + _add(F.col("query").isNotNull() & ~wants & (plain > 0), 0.1)))
    harm = F.when(F.col("intent").endswith("high_stakes"), 0.85).when(informational, 0.35).otherwise(0.15)
    tier = F.col("commercial_tier") if "commercial_tier" in rows.columns else None
    role = F.col("role") if "role" in rows.columns else U.page_role(F.col("url"), tier, F.array_contains(context, "commercial_cta"), F.col("text"))
    out = rows.withColumn("endorsement_risk", signals.endorsement_risk(F.col("query"), F.col("intent"), commerce))
    return out.withColumns({"role": role, "rhetorical": rhet, "failure": failure, "confidence": confidence, "retrieval_risk": risk, "reliability": reliability, "mismatch": mismatch, "harm": harm, "concealment_risk": hidden, "concealment_flags": concealed})


def permissions(rows: DataFrame) -> DataFrame:
    """Adds the four permissions to rows with subscores; consensus and dominance of the query count where rows has them."""
    has = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)
    coordinated, dominance = has("consensus", "healthy") == "coordinated", has("dominance", 0.0)
    query = T.plain(F.coalesce("query", F.lit("")))
    legit, asks_ugc = query.rlike(BRAND_LEGIT), query.rlike(UGC_INTENT)
    shopping, role, trust, hidden = F.col("intent").isin("commercial", "navigational"), F.col("role"), F.col("trust"), F.col("concealment_risk")
    reject, defer = F.col("failure").eqNullSafe("reject"), F.col("failure").eqNullSafe("defer")
    floor = role.isin("ugc_thread", "institutional") | ((role == "factual_blog") & (trust >= 0.55))
    weak = F.col("confidence") < 0.25
    listicle, vendor = shopping & role.isin("expert_listicle", "review_profile"), role == "commercial_product"
    promo = F.array_contains("concealment_flags", "promotional_instruction_pattern")
    spared = listicle | (role == "institutional") | (vendor & (shopping | legit))
    soft = (hidden >= 0.5) & (hidden < 0.9)
    doubtful = (soft & ~listicle) | (F.col("mismatch") >= 0.5) | (dominance >= 0.6) | coordinated | (trust < 0.35)
    wanted_thread = (role == "ugc_thread") & asks_ugc & ~coordinated
    retrieve = (
        F.when(reject, "reject").when(defer | (weak & ~floor), "defer")
        .when((hidden >= 0.9) & spared & ~promo & (F.col("mismatch") < 0.5), "downrank").when(hidden >= 0.9, "reject")
        .when(doubtful & ~wanted_thread, "downrank")
        .when(shopping & vendor & (legit | (trust < 0.35) | (soft & (F.col("mismatch") >= 0.5))), "downrank").otherwise("allow")
    )
    mention = F.when(reject | defer | ((F.col("confidence") < 0.1) & ~floor), "deny").otherwise("allow")

    sound = (trust >= 0.55) & (F.col("reliability") >= 0.55) & (F.col("mismatch") < 0.35)
    deny = (weak & ~floor) | (~weak & ((coordinated & (F.col("reliability") < 0.5)) | ((F.col("harm") >= 0.7) & ((F.col("reliability") < 0.45) | (trust < 0.5)))))
    corroborate = ~weak & (F.col("harm") >= 0.7) & ((F.col("reliability") < 0.6) | (trust < 0.6))
    concealed = (hidden >= 0.45) & ((F.col("reliability") < 0.55) | (hidden >= 0.7))
    plain = F.when(weak, F.when((role == "institutional") & sound, "allow").otherwise("attribute_only")).when(concealed, "attribute_only").when(sound & (hidden < 0.45), "allow").otherwise("attribute_only")
    capped = (
        F.when(vendor & legit, "attribute_only").when(shopping & legit & role.isin("ugc_thread", "review_profile"), "require_corroboration")
        .when(shopping & (role.isin("ugc_thread", "review_profile", "expert_listicle") | (vendor & (trust < 0.55))), "attribute_only").otherwise(plain)
    )
    factual = F.when(reject, "deny").when(defer, "attribute_only").when(deny, "deny").when(corroborate, "require_corroboration").otherwise(capped)

    persuasive = F.arrays_overlap(F.col("flags"), F.array(F.lit("comparative_superlatives"), F.lit("authority_stacking"))) | (F.col("comparative") > 0.35)
    low = trust < C.TRUST_ENDORSEMENT_MIN
    risky = (F.col("endorsement_risk") >= C.ENDORSEMENT_BLOCK) | ((F.col("endorsement_risk") >= 0.05) & low) | ((F.col("harm") >= 0.7) & persuasive & low)
    claims_cure = F.array_contains("flags", "high_stakes_medical_claim") & T.plain(F.coalesce(F.substring("text", 1, signals.EXCERPT), F.lit(""))).rlike(C.MEDICAL_CLAIM)
    cure = (F.coalesce("query", F.lit("")) != "") & (F.col("intent") == "informational_high_stakes") & claims_cure & (trust < 0.55) & ~F.array_contains("flags", "balanced_hedging")
    out = rows.withColumns({"retrieve_permission": retrieve, "mention_permission": mention, "_factual": factual})
    attacked = (F.col("retrieve_permission") == "reject") & ~reject
    out = out.withColumn("factual_permission", F.when(attacked, "deny").otherwise(F.col("_factual")))
    endorse = F.when((F.col("_factual") == "deny") | attacked | defer | coordinated | (shopping & role.isin("commercial_product", "institutional")) | risky | cure, "deny").otherwise("allow")
    return out.withColumn("endorsement_permission", endorse).drop("_factual")


def actions(rows: DataFrame) -> DataFrame:
    """Adds actions (in order, distinct) and recommended_action, the gravest of them, to rows with permissions."""
    coordinated = (F.coalesce("consensus", F.lit("healthy")) if "consensus" in rows.columns else F.lit("healthy")) == "coordinated"
    r, m, f, e = (F.col(c) for c in STRICTNESS)
    one = lambda test, name: F.when(test, F.lit(name))
    found = F.array_compact(
        F.array(
            F.when(r == "reject", "reject").when(r == "defer", "defer_fetch").when(r == "downrank", "downrank"), one(coordinated, "reject_consensus"), one((m == "deny") & (r != "defer"), "reject"),
            F.when(f == "deny", "block_factual_use").when(f == "require_corroboration", "require_corroboration").when(f == "attribute_only", "attribute_only"),
            one((f == "require_corroboration") & (F.col("harm") >= 0.7), "require_authoritative_corroboration"), one(e == "deny", "block_endorsement"),
        )
    )
    last = F.when((F.size(found) == 0) | ((m == "allow") & (f == "allow") & (e == "allow")), F.array(F.lit("pass"))).when(m == "allow", F.array(F.lit("mention_only"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("actions", F.array_distinct(F.concat(found, last))).withColumn("recommended_action", primary(F.col("actions")))


def primary(actions: Column) -> Column:
    """The gravest of a row's actions; unknown ones come last."""
    order = F.array(*map(F.lit, ACTION_ORDER))
    places = F.transform(actions, lambda a: F.nullif(F.array_position(order, a), F.lit(0)))
    return F.coalesce(F.get(order, F.array_min(F.array_compact(places)).cast("int") - 1), F.get(actions, F.lit(0)))


def merged_actions(actions: Column, extra: Column) -> Column:
    """actions and extra ones, in order, each once: extra actions may tighten what primary() gives, never loosen it."""
    return F.array_distinct(F.concat(actions, F.coalesce(extra, F.array().cast("array<string>"))))


def summary_action(rows: DataFrame) -> Column:
    """One action for a report, from permissions and subscores."""
    risk, rhet = F.col("endorsement_risk"), F.col("rhetorical")
    denied = F.col("endorsement_permission") == "deny"
    return (
        F.when(F.col("retrieve_permission") == "reject", "reject").when(F.col("retrieve_permission") == "defer", "defer_fetch")
        .when(denied & ((risk >= C.ENDORSEMENT_DOWNRANK) | (rhet >= 0.35)), "block_endorsement")
        .when((F.col("retrieve_permission") == "downrank") | (risk >= C.ENDORSEMENT_DOWNRANK) | (F.col("concealment_risk") >= 0.5) | ((rhet >= 0.55) & (F.col("trust") < 0.55)), "downrank")
        .otherwise("pass")
    )


def for_cited_thread(rows: DataFrame) -> DataFrame:
    """Permissions of open-posting pages that are themselves cited: facts attributed at most, no endorsement."""
    thread = F.col("role") == "ugc_thread"
    return rows.withColumns({
        "factual_permission": F.when(thread & (F.col("factual_permission") == "allow"), "attribute_only").otherwise(F.col("factual_permission")),
        "endorsement_permission": F.when(thread, "deny").otherwise(F.col("endorsement_permission")),
    })


def tightened(permission: str, proposed: Column) -> Column:
    """A permission, or what is proposed for it where that is stricter; null proposes nothing."""
    order = F.array(*map(F.lit, STRICTNESS[permission]))
    return F.when(F.array_position(order, F.coalesce(proposed, F.lit(""))) > F.array_position(order, F.col(permission)), proposed).otherwise(F.col(permission))


def tightest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each keys: of every permission the strictest value given."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, STRICTNESS[c])), F.col(c))
    worst = rows.groupBy(*keys).agg(*(F.max(rank(c)).alias(c) for c in STRICTNESS))
    return worst.select(*keys, *(F.get(F.array(*map(F.lit, v)), F.col(c).cast("int") - 1).alias(c) for c, v in STRICTNESS.items()))


def parasitic_profile(referrers: DataFrame, *keys: str) -> DataFrame:
    """Per target: n, count (parasitic), editorial, high_confidence, share, risk. referrers: parasitic, editorial, high_confidence."""
    a = referrers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("parasitic").alias("count"), F.count_if("editorial").alias("editorial"), F.count_if(F.col("parasitic") & F.col("high_confidence")).alias("high_confidence"))
    share, w = F.col("count") / F.col("n"), 0.35 + 0.35 * F.least(F.lit(1.0), F.col("n") / 10)
    risk = w * share + (1 - w) * F.least(F.lit(1.0), F.col("count") / 5)
    damp = F.when(F.col("editorial") > 0, F.greatest(F.lit(0.25), 1 - 0.55 * F.least(F.lit(1.0), F.col("editorial").cast("double")) - 0.35 * F.col("editorial") / F.col("n"))).otherwise(1.0)
    return a.withColumn("share", share).withColumn("risk", F.round(_clamp(risk * damp + F.least(F.lit(0.25), 0.1 * F.col("high_confidence"))), 4))
