"""What a source's commercial ties do to its permissions, and what an answer has to disclose of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T
from sourcelens.operators import decisions, signals

# Tiers in rising order, and what is shown to a reader.
TIERS = ["none", "low", "medium", "high"]
LABEL_HIGH = (
    "This answer uses sources with disclosed commercial relationships (e.g. affiliate or sponsored content). "
    "Commercial ties do not necessarily mean the information is incorrect."
)
LABEL_COORDINATED = "Sources supporting this claim appear coordinated and include commercial content."
HEDGE_MEDIUM = "Note: some cited sources may have commercial interests in the topic discussed."
OVERLAP_LEAST = 0.15


def influence(rows: DataFrame) -> DataFrame:
    """Adds tier, triggers, the actions proposed for permissions, disclosure_level, disclosure_text and response_mode.

    rows: one chunk a row with text, query, intent, trust, comparative, flags, context_flags, commercial_tier, harm,
    retrieve_permission, coordinated and defended_rank (null: unranked).
    """
    context, flags = F.col("context_flags"), F.col("flags")
    asks = T.plain(F.coalesce("query", F.lit(""))).rlike(C.WANTS_RECOMMENDATION)
    praise, low = signals.endorses(F.col("text"), F.col("comparative"), flags), F.col("trust") < C.TRUST_ENDORSEMENT_MIN
    told = F.col("commercial_tier")
    press = F.array_contains(context, "press_release") & F.array_contains(flags, "comparative_superlatives") & (told != "high")
    after = F.when(press, "high").otherwise(told)
    sells = F.array_contains(context, "commercial_cta") & praise & (after == "low")
    tier = F.when(sells, "medium").otherwise(after)
    group = F.coalesce("coordinated", F.lit(False)) & tier.isin("medium", "high")
    shopping = ~group & F.col("intent").isin("commercial", "navigational")
    open_ = ~group & ~shopping
    high, medium = open_ & (tier == "high"), open_ & (tier == "medium") & asks & praise
    plant = open_ & (tier == "none") & F.array_contains(flags, "planted_mention") & asks & ~praise
    triggers = F.array_compact(F.array(F.when(press, "press_release_with_comparative_superlatives"), F.when(sells, "commercial_cta_with_endorsement"), F.when(group, "coordinated_cluster")))
    return rows.withColumns({
        "tier": tier,
        "triggers": triggers,
        "retrieval_action": F.when(group | high | (medium & low) | (open_ & (tier == "low") & ~praise & (F.col("retrieve_permission") == "allow")), "downrank"),
        "factual_action": F.when(group | (high & (F.col("harm") >= 0.7) & (F.col("trust") < 0.45)), "deny").when(high, "attribute_only").when(medium, "require_corroboration"),
        "endorsement_action": F.when(group | (high & (praise | asks)) | medium | plant, "deny"),
        "disclosure_level": F.when(group | (high & (F.col("defended_rank") <= 3)), "label").when(medium, "hedge").otherwise("none"),
        "disclosure_text": F.when(group, LABEL_COORDINATED).when(high & (F.col("defended_rank") <= 3), LABEL_HIGH).when(medium, HEDGE_MEDIUM).otherwise(""),
        "response_mode": F.when(group | (high & asks & praise & low), "refuse_endorsement").when((high & asks & (praise | low)) | plant, "attributed_answer").when(high | medium, "hedged_answer"),
    })


def tighten(rows: DataFrame) -> DataFrame:
    """rows with influence() and permissions, the permissions no looser than what is proposed."""
    return rows.withColumns({
        "retrieve_permission": decisions.tightened("retrieve_permission", F.col("retrieval_action")),
        "factual_permission": decisions.tightened("factual_permission", F.col("factual_action")),
        "endorsement_permission": decisions.tightened("endorsement_permission", F.col("endorsement_action")),
    })


def disclosures(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Per query with something to disclose: n_disclosures, urls, label. A query's chunks are few, as it ranks them.

    chunks: query_id, rank, url, text, tier, disclosure_level, disclosure_text. answers: query_id, answer. A labelled
    chunk counts if it leads or shares enough words with the answer; the label holds each text once, in order of rank.
    """
    own = chunks.join(answers, "query_id")
    a, b = F.array_distinct(T.tokens(F.coalesce("text", F.lit("")))), F.array_distinct(T.tokens(F.coalesce("answer", F.lit(""))))
    both = F.size(F.array_intersect(a, b))
    overlap = F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))
    lead = F.col("rank") == F.min("rank").over(W.partitionBy("query_id"))
    shown = own.withColumn("lead", lead).where((F.col("disclosure_level") == "label") & (F.col("tier") == "high") & (F.col("lead") | (overlap >= OVERLAP_LEAST)))
    out = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "disclosure_text"))).alias("all"))
    texts = F.array_distinct(F.transform("all", lambda x: x["disclosure_text"]))
    return out.select("query_id", F.size("all").alias("n_disclosures"), F.transform("all", lambda x: x["url"]).alias("urls"), F.array_join(texts, "\n\n").alias("label"))


def disclosed(answer, label):
    """An answer with its disclosure above it; a null label adds nothing."""
    return F.when(F.coalesce(label, F.lit("")) == "", answer).otherwise(F.concat(F.lit("## Disclosure\n"), label, F.lit("\n\n"), answer))
