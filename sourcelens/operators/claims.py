"""Names that sources share, and the stance of a post towards what it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T


def names(text: Column) -> Column:
    """Runs of up to three words in title case, repeats included."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), T.FOREIGN, "q"), F.lit(C.TITLE_CASE), F.lit(1))


def is_usable(name: Column) -> Column:
    """False for names that are short, questions, cut off, or mostly made of common words."""
    words = F.split(F.lower(name), r"\s+")
    own = F.filter(words, lambda w: ~w.isin(C.NAME_STOPWORDS) & ~w.rlike(r"^\d+$"))
    few = (F.size(own) == 0) | ((F.size(words) >= 2) & (F.size(own) * 2 <= F.size(words)))
    return (F.length(name) >= 4) & ~F.get(words, F.lit(0)).isin(C.INTERROGATIVES) & ~F.element_at(words, -1).isin(C.DANGLING) & ~few & ~F.array_join(words, " ").isin(C.WEAK_MARKERS)


def shared_claims(sources: DataFrame, least: int = 2) -> DataFrame:
    """Per scope the usable name in most sources: scope, claim, n_sources; of equals the first by name.

    sources: scope, text, one row a source. A scope without a name in `least` sources has no row.
    """
    each = sources.select("scope", F.explode(F.array_distinct(names(F.col("text")))).alias("claim")).where(is_usable(F.col("claim")))
    counts = each.groupBy("scope", "claim").agg(F.count(F.lit(1)).alias("n_sources")).where(F.col("n_sources") >= least)
    first = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("n_sources"), "claim"))
    return counts.withColumn("k", first).where("k = 1").drop("k")


def plant_stance(text: Column, flags: Column | None = None) -> Column:
    """promotional, complaint, neutral, or unknown for a blank text; promotion wins over complaint."""
    plain = T.plain(F.coalesce(text, F.lit("")))
    promoted = F.lit(False)
    for pattern in (C.AFFILIATE_PROMOTION, C.GLOWING, C.RIVAL_BASHING, C.ENDORSES):
        promoted = promoted | plain.rlike(pattern)
    planted = F.arrays_overlap(flags, F.array(F.lit("planted_mention"), F.lit("comparative_superlatives"))) if flags is not None else F.lit(False)
    return F.when(planted, "promotional").when(~plain.rlike(r"\S"), "unknown").when(promoted, "promotional").when(plain.rlike(C.COMPLAINT), "complaint").otherwise("neutral")


def is_publisher(name: Column, site: Column, organization: Column, domain: Column) -> Column:
    """A name that is the site's own: its name, organisation or domain, with or without spaces."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    stem = F.lower(F.substring_index(domain, ".", 1))
    alike = lambda c: (F.length(F.trim(F.coalesce(c, F.lit("")))) >= 3) & ((F.lower(F.trim(name)) == F.lower(F.trim(c))) | (bare(name) == bare(c)))
    return F.coalesce(alike(site) | alike(organization) | alike(domain) | ((F.length(stem) >= 3) & (bare(name) == bare(stem))), F.lit(False))


def brands(sources: DataFrame) -> DataFrame:
    """Per scope the first source's product, else brand, that is usable and not its publisher: scope, brand.

    sources: scope, ord, product, brand, site_name, organization, domain.
    """
    each = sources.select("*", F.posexplode(F.array("product", "brand")).alias("k", "name")).withColumn("name", F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", " ")))
    fit = each.where((F.col("name") != "") & is_usable(F.col("name")) & ~is_publisher(F.col("name"), F.col("site_name"), F.col("organization"), F.col("domain")))
    return fit.groupBy("scope").agg(F.min_by("name", F.struct("ord", "k")).alias("brand"))


#: Roles that speak for a brand or for facts when a claim is named.
COMMERCIAL, FACTUAL = ["commercial_product", "review_profile", "expert_listicle"], ["factual_blog", "institutional", "editorial"]


def resolved_claim(intent: Column, topic: Column, brand: Column, shared: Column, roles: Column) -> Column:
    """What a query's answer is about: brand, topic or shared name, by intent and by the roles of its sources."""
    commercial = F.exists(roles, lambda r: r.isin(COMMERCIAL))
    threads = (F.size(roles) > 0) & F.forall(roles, lambda r: r == "ugc_thread")
    by_topic = F.coalesce(topic, brand, shared)
    pick = (
        F.when((intent == "commercial") & ~threads & brand.isNotNull() & (commercial | (F.size(roles) == 0)), brand).when(intent == "commercial", by_topic)
        .when(intent.startswith("informational") & commercial & brand.isNotNull(), brand).when(intent == "navigational", F.coalesce(brand, topic, shared)).otherwise(by_topic)
    )
    return F.when(pick.isNotNull() & ~is_usable(pick) & topic.isNotNull(), topic).otherwise(pick)
