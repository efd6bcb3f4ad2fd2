"""Who refers to a target, from which surfaces, and what that does to the target's standing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.functions import urls as U
from sourcelens.operators import decisions, plants, signals

# Sizes and shares of a referrer mix, and weights of its risk.
HARD_N, COMPLETE_N, LEAST_N = 10, 20, 5
SUSPECTED_SHARE, SOFT_LOW, SOFT_HIGH = 0.5, 0.35, 0.5
SPARSE_SHARE, SPARSE_N, MISMATCH_SHARE, MISMATCH_N = 0.8, 3, 0.8, 5
ELEVATED, ELEVATED_VENDOR, VENDOR_TRUST, BRAND_RISK, BRAND_N = 0.35, 0.55, 0.62, 0.40, 5
HIGH_RISK = 0.45
# Surfaces whose text others can plant or buy.
EDITABLE_PATH = (
    r"(?i)/(posts?|pulse|feed|status|newsletter)\b|/p/[a-z0-9]|/(blog|blogs|article|articles|reviews?|roundup|guides?|picks|best-[\w-]+)\b"
    r"|/(?:customer[-_]reviews?|complaints?|directory|directories)\b"
)
EDITABLE_ROLE = {"expert_listicle": 0.55, "editorial": 0.5, "review_profile": 0.5, "factual_blog": 0.4, "commercial_product": 0.15}
EDITABLE_LEAST, SOFT_ROLES, COMMERCIAL_ROLES = 0.55, ["factual_blog", "expert_listicle", "editorial", "review_profile"], ["commercial_product", "review_profile", "expert_listicle"]
MOST_SCORED, WINDOW = 32, 1200


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def thread_surface(url: Column, segments: Column) -> Column:
    """How much of a page others write: its path and its comments. segments: array of structs with a role."""
    comments = F.size(F.filter(segments, lambda s: s["role"].isin("comment", "nested_comment")))
    posts = F.exists(segments, lambda s: s["role"] == "main_post")
    public = F.regexp_replace(F.lower(U.authority(url)), r"^www\.", "").rlike(r"\.(gov|edu)$")
    path = F.when(U.is_thread(F.concat(F.lit("x://y"), U.path(url))), 0.55).otherwise(0.0)
    return _clamp(path - F.when(public, 0.4).otherwise(0.0) + F.when(comments >= 2, 0.35).when(comments == 1, 0.15).otherwise(0.0) + F.when(posts & (comments >= 1), 0.1).otherwise(0.0))


def editability(url: Column, role: Column) -> Column:
    """How cheaply the body of a page is planted or bought."""
    base = F.coalesce(F.create_map(*(F.lit(x) for kv in EDITABLE_ROLE.items() for x in kv))[role], F.lit(0.0))
    public = F.regexp_replace(F.lower(U.authority(url)), r"^www\.", "").rlike(r"\.(gov|edu)$")
    return _clamp(F.when(U.path(url).rlike(EDITABLE_PATH), F.greatest(base, F.lit(EDITABLE_LEAST))).otherwise(base) - F.when(public, 0.4).otherwise(0.0))


def scoped_excerpt(text: Column, segments: Column, entity: Column, marker: Column) -> Column:
    """Struct of excerpt and role: a segment that names the entity, comments first, else a window of the text around it."""
    names = F.filter(F.transform(F.array(marker, entity), F.lower), lambda m: F.length(F.trim(F.coalesce(m, F.lit("")))) >= 2)
    said = F.filter(segments, lambda s: F.exists(names, lambda m: F.lower(s["text"]).contains(m)))
    pick = F.coalesce(F.get(F.filter(said, lambda s: s["role"].isin("comment", "nested_comment")), F.lit(0)), F.get(said, F.lit(0)))
    source = F.coalesce(text, F.lit(""))
    at = F.array_min(F.array_compact(F.transform(names, lambda m: F.nullif(F.instr(F.lower(source), m), F.lit(0)))))
    start = F.greatest(F.lit(1), at - WINDOW // 3)
    around = F.when(at.isNull(), F.substring(source, F.lit(1), F.lit(WINDOW))).otherwise(F.substring(source, start, at + WINDOW - start))
    out = lambda what, role: F.struct(what.alias("excerpt"), role.alias("role"))
    return F.when(pick.isNotNull(), out(F.substring(pick["text"], 1, 2 * WINDOW), pick["role"])).otherwise(out(around, F.lit("body")))


def is_scored(url: Column, role: Column, llm_parasitic: Column) -> Column:
    return llm_parasitic | U.is_parasitic(url, role) | role.isin(SOFT_ROLES)


def eligible(candidates: DataFrame, most: int = MOST_SCORED) -> DataFrame:
    """Of each target's referrers with an excerpt those worth scoring: parasitic ones first, then the most manipulable, so many at most.

    candidates: target_id, url, role, excerpt, manipulability, llm_parasitic. Adds parasitic and place.
    """
    told = F.coalesce("llm_parasitic", F.lit(False))
    own = candidates.where(F.coalesce("excerpt", F.lit("")).rlike(r"\S") & is_scored(F.col("url"), F.col("role"), told))
    own = own.withColumn("parasitic", told | U.is_parasitic(F.col("url"), F.col("role")))
    order = W.partitionBy("target_id").orderBy(F.desc("parasitic"), F.desc("manipulability"), "url", *(["doc_id"] if "doc_id" in own.columns else []))
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def scored_excerpts(excerpts: DataFrame) -> DataFrame:
    """Adds content signals, planted, high_risk and stance to rows of excerpt and entity."""
    from sourcelens.operators import claims

    rows = signals.content_signals(excerpts.withColumn("text", F.col("excerpt")))
    bucket = plants.diagnosis(F.col("text"), F.col("flags"), plants.name_placement(F.col("text"), F.col("entity")))
    rows = rows.withColumn("planted", bucket["planted"])
    rows = rows.withColumn("flags", F.concat(F.array_remove("flags", "planted_mention"), F.when(F.col("planted"), F.array(F.lit("planted_mention"))).otherwise(F.array().cast("array<string>"))))
    return rows.withColumns({"high_risk": F.col("planted") | (F.col("semantic_risk") >= HIGH_RISK), "stance": claims.plant_stance(F.col("text"), F.col("flags"))})


def content_summary(scored: DataFrame, coordinated: DataFrame) -> DataFrame:
    """target_id, scored, content_high_risk, coordinated. coordinated: target_id, coordinated, of the excerpts' similarity."""
    own = scored.groupBy("target_id").agg(F.count(F.lit(1)).alias("scored"), F.count_if("high_risk").alias("content_high_risk"))
    return own.join(coordinated, "target_id", "left").withColumn("coordinated", (F.col("scored") >= 2) & F.coalesce("coordinated", F.lit(False)))


def resolved_stance(stance: Column, flags: Column, high_risk: Column) -> Column:
    given = F.lower(F.trim(F.coalesce(stance, F.lit(""))))
    planted = high_risk | F.arrays_overlap(flags, F.array(F.lit("planted_mention"), F.lit("comparative_superlatives")))
    return F.when((given != "") & (given != "unknown"), given).when(planted, "promotional").otherwise("unknown")


def counted(referrers: DataFrame) -> DataFrame:
    """Adds surface, hard and high_confidence: whether a referrer is a parasitic surface, counts as planted, and is sure.

    referrers: url, role, flags, stance, high_risk, llm_parasitic and coordinated (of its target's referrers).
    """
    risk, told = F.coalesce("high_risk", F.lit(False)), F.coalesce("llm_parasitic", F.lit(False))
    surface = told | U.is_parasitic(F.col("url"), F.col("role"), risk)
    gated = F.col("role").isin("ugc_thread", "review_profile") | U.is_open_posting(F.col("url"))
    promotes = resolved_stance(F.col("stance"), F.col("flags"), risk) == "promotional"
    return referrers.withColumns({"surface": surface, "hard": surface & (~gated | F.coalesce("coordinated", F.lit(False)) | risk | promotes), "high_confidence": surface & risk})


#: Referrers, and their parasitic share, that settle a mix; where editorial ones are among them, so many.
DECISIVE_LEAST, DECISIVE_SHARE, DECISIVE_MIXED = 8, 0.8, 10


def until_decisive(referrers: DataFrame, most: int = 0) -> DataFrame:
    """Of each target's verified referrers those up to the one with which their mix is settled, in order: a search would have stopped there.

    referrers: counted(), with target_id and ord (unique in a target). Adds seen, count and editorial of the prefix, and
    decisive, true of the last row where the mix settled. most: stop at so many in any case (0: no such limit); Spark
    keeps that many of a target in each task before it shuffles. Running counts need a target's rows in one order, but
    hold one row at a time.
    """
    rows = referrers
    order = W.partitionBy("target_id").orderBy("ord")
    if most:
        rows = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    editorial = F.col("role").isin("editorial", "institutional").cast("int")
    rows = rows.withColumns({"seen": F.count(F.lit(1)).over(so_far), "count": F.sum(F.col("hard").cast("int")).over(so_far), "editorial": F.sum(editorial).over(so_far)})
    share = F.col("count") / F.col("seen")
    one_sided = (share >= DECISIVE_SHARE) & (F.col("editorial") == 0)
    rows = rows.withColumn("decisive", (F.col("seen") >= DECISIVE_LEAST) & (one_sided | ((F.col("seen") >= DECISIVE_MIXED) & (F.col("editorial") > 0))))
    before = F.coalesce(F.max(F.col("decisive").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).where("_before = 0").drop("_before")


def profiles(referrers: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: its referrer mix, risk, and how far that mix is suspect.

    referrers: verified ones, as for counted(), with target_id. targets: target_id, role, trust, commercial_tier, query,
    discovery (success, partial, failed), n_errors, n_sampled, coordinated, scored, content_high_risk.
    """
    rows = counted(referrers.join(targets.select("target_id", "coordinated"), "target_id"))
    mix = rows.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hard").alias("count"), F.count_if("surface").alias("n_surface"), F.count_if("high_confidence").alias("n_sure"),
        F.count_if(F.col("role").isin("editorial", "institutional")).alias("editorial"), F.count_if(F.col("role").isin(COMMERCIAL_ROLES)).alias("n_commercial"),
    )
    counts = ["n", "count", "n_surface", "n_sure", "editorial", "n_commercial"]
    out = targets.join(mix, "target_id", "left").fillna(0, counts)
    n, count, sure, editorial, none = F.col("n"), F.col("count"), F.col("n_sure"), F.col("editorial"), F.col("editorial") == 0
    out = out.withColumns({"share": F.coalesce(F.try_divide(count, n), F.lit(0.0)), "commercial_share": F.coalesce(F.try_divide(F.col("n_commercial"), n), F.lit(0.0)), "risk": F.when(n == 0, 0.0).otherwise(risk(n, count, editorial, sure))})
    share, tier = F.col("share"), F.coalesce("commercial_tier", F.lit("none"))
    together = F.col("role").isin("editorial", "institutional", "factual_blog") & (F.col("commercial_share") >= 0.7) & (F.col("n_commercial") >= 2)
    sells = F.col("role").isin(COMMERCIAL_ROLES) | tier.isin("low", "medium", "high")
    out = out.withColumn("alignment", F.when(n == 0, "inconclusive").when(together, "coordinated_commercial").when(sells & (F.col("commercial_share") < 0.3) & (n >= 3), "mismatch").otherwise("aligned"))
    few = n < HARD_N
    failed = (n == 0) & (F.col("n_errors") > 0)
    lone = few & (share >= SPARSE_SHARE) & (n >= SPARSE_N)
    status = F.when(failed, "inconclusive").when(n == 0, "sparse").when(n >= COMPLETE_N, "complete").when(lone, "sparse_suspicious").otherwise("sparse")
    discovery = F.when(failed & (F.col("n_sampled") == 0), "failed").when(failed, F.col("discovery")).when(n == 0, "success").otherwise(F.col("discovery"))
    heavy = ~few & (share > SUSPECTED_SHARE) & none
    odd = (F.col("alignment") == "mismatch") & (share >= MISMATCH_SHARE) & (n >= MISMATCH_N) & none
    suspected = F.when(failed, F.lit(None)).when(n == 0, F.lit(False)).when(heavy | odd, F.lit(True)).when(F.col("alignment") == "coordinated_commercial", F.lit(None)).otherwise(F.lit(False))
    band = ~few & none & share.between(SOFT_LOW, SOFT_HIGH)
    out = out.withColumns({"status": status, "discovery": discovery, "confidence": F.when((n >= HARD_N) | ((n == 0) & ~failed), "medium").otherwise("low"), "suspected": suspected.cast("boolean"), "soft_band": band})
    enough = (n >= LEAST_N) & none
    by_count, by_sure = enough & (count >= 3) & (sure >= 1), enough & (sure >= 2) & (count >= 2)
    vendor = (F.col("role") == "commercial_product") | tier.isin("medium", "high")
    as_vendor = by_count | by_sure | ((F.coalesce("trust", F.lit(0.0)) < VENDOR_TRUST) & (F.col("risk") >= ELEVATED_VENDOR))
    dense = (F.col("risk") >= ELEVATED) & (n >= LEAST_N) & ((sure >= 1) | (share >= SOFT_LOW))
    raised = F.when(vendor, as_vendor).otherwise(F.col("soft_band") | (F.col("status") == "sparse_suspicious") | dense | by_count | by_sure)
    out = out.withColumn("elevated", (n > 0) & ~F.coalesce("suspected", F.lit(False)) & raised)
    legit = F.lower(F.coalesce("query", F.lit(""))).rlike(decisions.BRAND_LEGIT)
    brand = ~F.coalesce("suspected", F.lit(False)) & (F.col("role") == "commercial_product") & (n <= BRAND_N) & F.col("discovery").isin("success", "partial") & (F.col("status") != "inconclusive") & legit
    return out.withColumns({"risk": F.when(brand, F.greatest("risk", F.lit(BRAND_RISK))).otherwise(F.col("risk")), "elevated": F.col("elevated") | brand})


def risk(n: Column, count: Column, editorial: Column, sure: Column) -> Column:
    """Share and number of planted referrers, damped by editorial ones, raised by sure ones."""
    weight = 0.35 + 0.35 * F.least(F.lit(1.0), n / 10)
    raw = weight * F.try_divide(count, n) + (1 - weight) * F.least(F.lit(1.0), count / 5)
    damped = F.when(editorial > 0, raw * F.greatest(F.lit(0.25), 1 - 0.55 * F.least(F.lit(1.0), editorial.cast("double")) - 0.35 * editorial / n)).otherwise(raw)
    return F.round(_clamp(damped + F.least(F.lit(0.25), 0.1 * sure)), 4)


def gates(profile: DataFrame) -> Column:
    """Names of the trial rules that a target's mix meets; none of them acts."""
    n, count, share, sure = F.col("n"), F.col("count"), F.col("share"), F.col("n_sure")
    told = {
        "parasitic_count_ge_3": count >= 3, "parasitic_count_ge_2": count >= 2, "share_ge_0.35_n_ge_5": (n >= 5) & (share >= 0.35), "share_ge_0.40_n_ge_5": (n >= 5) & (share >= 0.4),
        "share_ge_0.50_n_ge_5": (n >= 5) & (share >= 0.5), "share_gt_0.50_hard": (n >= HARD_N) & (share > SUSPECTED_SHARE), "high_conf_parasitic_ge_2": sure >= 2,
        "sparse_80_current": (n < 10) & (n >= 3) & (share >= 0.8), "parasitic_geo_risk_elevated": F.col("risk") >= ELEVATED,
    }
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in told.items())))


def extra_actions(profile: DataFrame) -> Column:
    """Actions that a target's mix and its referrers' texts add; they only tighten. Needs engine_cited and n_cited as well."""
    none = F.array().cast("array<string>")
    names = lambda *a: F.array(*map(F.lit, a))
    cited = (F.col("n") == 0) & F.col("discovery").isin("success", "partial") & (F.col("status") != "inconclusive") & ~F.col("role").isin("editorial", "institutional") & (F.col("engine_cited") | (F.col("n_cited") > 0))
    mix = (
        F.when(F.coalesce("suspected", F.lit(False)), names("attribute_only", "block_endorsement")).when(F.col("status") == "sparse_suspicious", names("attribute_only"))
        .when(F.col("elevated") | F.col("soft_band") | cited, names("downrank")).otherwise(none)
    )
    risky, scored = F.col("content_high_risk"), F.col("scored") > 0
    content = F.when(scored & ((risky >= 2) | F.col("coordinated")), names("attribute_only", "block_endorsement")).when(scored & (risky == 1), names("downrank")).otherwise(none)
    return F.when(F.col("status") == "skipped", none).otherwise(F.array_distinct(F.concat(mix, content)))


def verdict(profile: DataFrame) -> Column:
    """Why a target's action is what it is, as one word."""
    cited = (F.col("n") == 0) & F.col("discovery").isin("success", "partial") & ~F.col("role").isin("editorial", "institutional") & (F.col("n_cited") > 0)
    return (
        F.when(F.col("status").isin("skipped", "inconclusive"), F.col("status")).when(F.coalesce("suspected", F.lit(False)), "suspected").when(F.col("elevated"), "elevated")
        .when((F.col("content_high_risk") >= 2) | F.col("coordinated"), "high_risk_content").when(F.col("status") == "sparse_suspicious", "sparse_suspicious")
        .when(F.col("content_high_risk") == 1, "one_high_risk_excerpt").when(F.col("soft_band"), "soft_band").when(cited, "cited_without_referrers").when(F.col("role") == "editorial", "editorial").otherwise("clear")
    )


def is_decisive(profile: DataFrame) -> Column:
    """A mix that more referrers would not change."""
    return (F.col("n") >= 8) & (((F.col("share") >= SPARSE_SHARE) & (F.col("editorial") == 0)) | ((F.col("n") >= HARD_N) & (F.col("editorial") > 0)))


def role_mix(referrers: DataFrame, *keys: str) -> DataFrame:
    """keys and mix, a map of role to number."""
    each = referrers.groupBy(*keys, "role").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("mix"))


FROZEN = "target_id long, status string, discovery string, confidence string, n long, count long, n_sure long, editorial long, share double, risk double, suspected boolean, elevated boolean, soft_band boolean"


def frozen(profile: DataFrame) -> DataFrame:
    """target_id and the profile as JSON, so that a later run need not discover it anew."""
    names = [c.split()[0] for c in FROZEN.split(", ")]
    return profile.select("target_id", F.to_json(F.struct(*names)).alias("profile"))


def thawed(rows: DataFrame) -> DataFrame:
    """Profiles from frozen() ones; what doesn't parse counts as skipped."""
    out = rows.select("target_id", F.from_json("profile", FROZEN).alias("p"))
    return out.select("target_id", F.coalesce("p.status", F.lit("skipped")).alias("status"), *(F.col(f"p.{c.split()[0]}").alias(c.split()[0]) for c in FROZEN.split(", ")[2:]))


def with_content(referrers: DataFrame, candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Verified referrers with their excerpt's candidate and score, by address whatever its case and last slash; nulls where there is none.

    All: target_id, url. candidates: manipulability, excerpt. scores: semantic_risk, high_risk, stance.
    """
    key = lambda df: df.withColumn("_key", F.lower(F.regexp_replace("url", "/+$", "")))
    one = lambda df, *names: key(df).groupBy("target_id", "_key").agg(*(F.first(n).alias(n) for n in names))
    out = key(referrers).join(one(candidates, "manipulability", "excerpt"), ["target_id", "_key"], "left").join(one(scores, "semantic_risk", "high_risk", "stance"), ["target_id", "_key"], "left")
    return out.drop("_key")
