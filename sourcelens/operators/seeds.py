"""Questions with which to look for those who refer to a page, from templates and what the page calls itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens.functions import urls as U
from sourcelens.operators import claims

# Templates by a target's role, in order of use; entity, category, topic, price and org are filled in.
DISCUSSION = ["{entity} reddit", "{entity} reddit review", "{entity} site:reddit.com", "is {entity} legit reddit", "{category} reddit recommendations", "{entity} forum discussion"]
PRODUCT = ["best {category} 2026", "best {category} under {price}", "{entity} review", "{entity} vs", "is {entity} worth it", "top {category} recommendations", "best budget {category}", "{category} buying guide"]
EDITORIAL = ["best {category} 2026", "best {category} tested", "{category} buying guide", "top {category} picks"]
INSTITUTIONAL = ["{org} {topic}", "official guidance on {topic}", "{topic} {org}"]
INFORMATIONAL = ["what is {topic}", "{topic} explained", "how does {topic} work", "{topic} guide", "evidence for {topic}"]
FORUMS = [
    "{category} forums", "best {category} forums", "{category} forum directory", "best forums for {category}", "{entity} forum", "{entity} forums list", "{entity} forum discussion", "{entity} board",
    "{entity} community forum", "{entity} site:reddit.com", "is {entity} legit forum", "{entity} bbb", "{entity} complaints", "{entity} customer reviews forum",
]
DISCUSSED = ["commercial_product", "editorial", "expert_listicle", "review_profile", "factual_blog"]
MOST = 12


def confidence(role: Column) -> Column:
    return F.when(role.isin("commercial_product", "editorial"), "high").when(role.isin("institutional", "factual_blog"), "medium").otherwise("low")


def metadata(pages: DataFrame) -> DataFrame:
    """Adds entity, org, category, topic, price to pages with identity(): what seeds and ties are made of.

    pages: url, title, text, site_name, organization, brand, product. The entity is the product, else the brand, the
    title, the organisation, the publisher: the first that is a usable name.
    """
    publisher = F.substring_index(U.registrable_domain(U.authority(F.col("url"))), ".", 1)
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    title = F.nullif(F.trim(F.substring(F.regexp_extract("title", r"^(.*?)(?:\s*[|\-\x{2013}\x{2014}]\s*.*)?$", 1), 1, 120)), F.lit(""))
    org = F.coalesce(filled("organization"), filled("site_name"), filled("brand"), publisher)
    usable = lambda c: F.when(claims.is_usable(c), c)
    product = F.when((F.lower("product") != F.lower(org)) & (F.lower("product") != F.lower(F.coalesce("brand", F.lit("")))), filled("product"))
    category = U.category_hint(F.col("url"))
    out = {"entity": F.coalesce(usable(product), usable(filled("brand")), usable(title), usable(org), publisher), "org": org, "category": category, "topic": F.coalesce(title, category), "price": U.price_hint(F.col("text"), F.col("url"))}
    return pages.withColumns(out)


def _filled(templates: list[str], category: Column) -> Column:
    values = {"entity": F.col("entity"), "category": category, "topic": F.col("topic"), "price": F.col("price"), "org": F.col("org")}

    def one(template: str) -> Column:
        out = F.lit(template)
        for name, value in values.items():
            if f"{{{name}}}" in template:
                out = F.replace(out, F.lit(f"{{{name}}}"), value)
        return F.trim(out)

    return F.array(*map(one, templates))


def _category() -> Column:
    return F.trim(F.regexp_replace("category", r"(?i)^best ", ""))


def seeds(role: Column, most: int = MOST) -> Column:
    """So many distinct questions about a row of metadata(), by its role."""
    category, none = _category(), F.array().cast("array<string>")
    own = (
        F.when(role == "commercial_product", _filled(PRODUCT, category)).when(role == "editorial", _filled(EDITORIAL, category))
        .when(role == "institutional", _filled(INSTITUTIONAL, category)).otherwise(_filled(INFORMATIONAL, category))
    )
    return F.slice(F.array_distinct(F.concat(own, F.when(role.isin(DISCUSSED), _filled(DISCUSSION, category)).otherwise(none))), 1, most)


def with_forums(queries: Column, most: int = MOST) -> Column:
    """Questions that find forums and complaints before the others."""
    category = F.trim(F.regexp_replace(_category(), r"(?i)\s+forums?$", ""))
    return F.slice(F.array_distinct(F.concat(_filled(FORUMS, category), queries)), 1, most)


def with_names(queries: Column, aliases: Column, most: int = MOST) -> Column:
    """Questions that only name the brand before the others."""
    domain = U.registrable_domain(U.authority(F.col("url")))
    others = F.slice(F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.lower(a) != F.lower("entity")), 1, 2)
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(F.col("entity"), F.concat("entity", F.lit(" reviews")), domain), others, queries), lambda q: q != "")), 1, most)


def untried(seeds_: DataFrame, tried: DataFrame) -> DataFrame:
    """target_id, query of questions that were not asked yet."""
    return seeds_.join(tried, ["target_id", "query"], "left_anti")
