"""What a hosted model suggested, kept as an input table, and how far it may change what rules decided.

Every merge fails open: a null or invalid suggestion, or a row beyond its gate, leaves the rules' decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.functions import text as T
from sourcelens.functions import urls as U
from sourcelens.operators import decisions, signals

LISTICLES = ["expert_listicle", "review_profile"]


def valid(value: Column, allowed: list[str]) -> Column:
    """A suggested level, trimmed and in lower case; null where it is none of the allowed ones."""
    tidy = F.lower(F.trim(value))
    return F.when(tidy.isin(allowed), tidy)


def reply(raw: Column) -> Column:
    """The JSON object that a model's reply holds, as VARIANT: the whole reply, without a code fence around it, else what stands between its first and last brace, of several objects the first; null where neither is an object."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    text = F.when(F.trim(raw).startswith("```"), bare).otherwise(F.trim(raw))
    whole, inner = F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def said(answer: Column, name: str) -> Column:
    """A field of a reply if it is a text; a number, a list or an object is none."""
    value = F.try_variant_get(answer, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def suggested(rows: DataFrame, raw: str) -> DataFrame:
    """rows with what the replies in column raw suggest: suggested_ and each permission (null: nothing valid) and suggestion_reason."""
    own = rows.withColumn("_reply", reply(F.col(raw)))
    levels = {f"suggested_{p}": valid(said(F.col("_reply"), p), allowed) for p, allowed in decisions.STRICTNESS.items()}
    reason = F.substring(F.trim(F.regexp_replace(F.coalesce(said(F.col("_reply"), "reason"), F.lit("")), r"\s+", " ")), 1, REASON_CHARS)
    return own.withColumns(levels | {"suggestion_reason": reason}).drop("_reply")


# Characters of a reason, from when on a source is trusted, and how far concealment leaves a model a say.
REASON_CHARS, TRUSTED = 240, 0.7
SOFT_CONCEALMENT, HARD_CONCEALMENT, LOW_CONFIDENCE, COMMERCE = 0.5, 0.9, 0.25, 0.45


def skipped(rows: DataFrame) -> Column:
    """Why a model isn't asked about a row, or null where it is: only rows on which the rules are blunt are worth a call.

    rows: role, intent, url, ok, failure, confidence, trust, concealment_risk, commercial_score, commercial_tier,
    context_flags, flags, comparative, text and the permissions that the rules gave.
    """
    retrieve, _, factual, endorse = (F.col(p) for p in decisions.STRICTNESS)
    role, shopping, hidden = F.col("role"), F.col("intent").isin("commercial", "navigational"), F.col("concealment_risk")
    has = lambda column, *names: F.arrays_overlap(column, F.array(*map(F.lit, names)))
    sells = F.coalesce(F.col("commercial_tier").isin("medium", "high") | (F.col("commercial_score") > COMMERCE) | has("context_flags", "affiliate_link_params", "commercial_cta"), F.lit(False))
    persuades = has("flags", "comparative_superlatives", "authority_stacking") | signals.endorses(F.substring("text", 1, signals.EXCERPT), F.col("comparative"), F.col("flags"))
    trusted = (F.col("trust") >= TRUSTED) | U.hostname(F.col("url")).rlike(r"\.(gov|edu)$")
    spared = role.isin("ugc_thread", "institutional") | ((role == "factual_blog") & (F.col("trust") >= 0.55))
    fetched = F.col("failure").isNull() & F.col("ok")
    blunt = (
        (shopping & ((hidden >= SOFT_CONCEALMENT) | (endorse == "allow") | sells | role.isin("expert_listicle", "editorial", "review_profile") | trusted))
        | ((endorse == "allow") & (persuades | sells))
        | ((factual == "allow") & ((role == "commercial_product") | sells))
    )
    return (
        F.when(hidden >= HARD_CONCEALMENT, "concealment_hot")
        .when(F.col("failure").eqNullSafe("reject") | (retrieve == "reject"), "hard_floor")
        .when(fetched & (F.col("confidence") < LOW_CONFIDENCE) & spared, "soft_fetch_floor")
        .when(~fetched | ~blunt, "not_ambiguous")
    )


def from_replies(rows: DataFrame, raw: str) -> DataFrame:
    """rows with permissions after a model's replies: gate, parse, floors and merge. Adds skipped, merge_source and suggestion_reason.

    A row outside the gate keeps its permissions whatever its reply says, as does one whose reply holds nothing valid.
    """
    told = suggested(rows.withColumn("skipped", skipped(rows)), raw)
    names = [f"suggested_{p}" for p in decisions.STRICTNESS]
    told = told.withColumns({n: F.when(F.col("skipped").isNull(), F.col(n)) for n in names})
    return merged_permissions(told).drop(*names)


def merged_permissions(rows: DataFrame) -> DataFrame:
    """rows with permissions, their suggested_ columns merged in, and merge_source.

    rows: role, query, intent, failure, confidence, trust, mismatch, concealment_risk, the permissions and the same names
    with suggested_ before them. Hard faults keep the rules; soft concealment lets a model deny endorsement only.
    """
    got = {p: valid(F.col(f"suggested_{p}"), levels) for p, levels in decisions.STRICTNESS.items()}
    retrieve, mention, factual, endorse = (F.col(p) for p in decisions.STRICTNESS)
    role, shopping = F.col("role"), F.col("intent").isin("commercial", "navigational")
    query = T.plain(F.coalesce("query", F.lit("")))
    legit = query.rlike(decisions.BRAND_LEGIT)
    hidden = F.col("concealment_risk")
    floor = F.col("failure").isNull() & (F.col("confidence") < 0.25) & (role.isin("ugc_thread", "institutional") | ((role == "factual_blog") & (F.col("trust") >= 0.55)))
    nothing = F.coalesce(*got.values()).isNull()
    kept = (hidden >= 0.9) | F.col("failure").isNotNull() | floor | nothing
    soft = hidden >= 0.5
    some = {p: F.coalesce(v, F.col(p)) for p, v in got.items()}
    holds_allow = (retrieve == "allow") & (F.col("mismatch") < 0.5) & ((role != "commercial_product") | (shopping & ~legit))
    holds_down = (retrieve == "downrank") & (((role == "commercial_product") & (shopping | legit)) | ((role == "ugc_thread") & legit) | (shopping & role.isin("institutional", "factual_blog")))
    new_retrieve = F.when(holds_allow, "allow").when(holds_down & (some["retrieve_permission"] == "allow"), "downrank").otherwise(some["retrieve_permission"])
    told = some["factual_permission"]
    attributed = shopping & ((role.isin(LISTICLES) & factual.isin("allow", "attribute_only")) | (role.isin("ugc_thread", "review_profile") & (factual == "attribute_only") & ~legit))
    told = F.when(attributed & told.isin("require_corroboration", "deny"), factual).otherwise(told)
    told = F.when(shopping & role.isin(*LISTICLES, "factual_blog") & (factual == "attribute_only") & (told == "allow"), "attribute_only").otherwise(told)
    told = F.when((role == "institutional") & (factual == "allow"), "allow").otherwise(told)
    told = F.when((factual == "require_corroboration") & told.isin("allow", "attribute_only"), "require_corroboration").otherwise(told)
    new_endorse = F.when((endorse == "deny") | (got["endorsement_permission"] == "deny"), "deny").otherwise(endorse)
    return rows.withColumns({
        "retrieve_permission": F.when(kept | soft, retrieve).otherwise(new_retrieve),
        "mention_permission": F.when(kept | soft, mention).otherwise(some["mention_permission"]),
        "factual_permission": F.when(kept | soft, factual).otherwise(told),
        "endorsement_permission": F.when(kept, endorse).otherwise(new_endorse),
        "merge_source": F.when(kept, "heuristic").otherwise("llm_hybrid"),
    })


def top_for_stance(referrers: DataFrame, most: int = 4) -> DataFrame:
    """Per target the referrers whose stance is worth asking a model for: threads, then review profiles, the most manipulable first.

    referrers: target_id, url, role, stance, manipulability; rows with a stance that rules are sure of stay out.
    """
    rank = F.when(F.col("role") == "ugc_thread", 0).when(F.col("role") == "review_profile", 1).otherwise(2)
    own = referrers.where(F.coalesce("stance", F.lit("unknown")).isin("unknown", "neutral")).withColumn("rank", rank)
    place = W.partitionBy("target_id").orderBy("rank", F.desc("manipulability"), "url", *(["doc_id"] if "doc_id" in own.columns else []))
    return own.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).drop("rank")


def resolved(rule: Column, suggested: Column, allowed: list[str], ambiguous: Column) -> Column:
    """A role, stance or intent: the model's where the rule's is ambiguous and the model's is valid."""
    return F.when(ambiguous, F.coalesce(valid(suggested, allowed), rule)).otherwise(rule)
