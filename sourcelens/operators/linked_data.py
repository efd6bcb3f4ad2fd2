"""What a page's JSON-LD says, from its flat rows: nodes that rules on structured data look at, and names a page gives itself.

A page's rows are few; everything is higher-order functions over one array of ROW, in Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T

ROW = "struct<node int, parent int, path string, listed boolean, key string, text string, many boolean>"
# Keys by which nodes are reached, for claims and for names; types; keys that hold a node's text and its name.
CLAIMS_UNDER = ["mainEntity", "acceptedAnswer", "suggestedAnswer", "step", "itemListElement", "review", "aggregateRating", "author", "brand", "publisher", "provider"]
NAMES_UNDER = ["brand", "manufacturer", "publisher", "provider", "organizer"]
STEPS = ["HowTo", "HowToStep", "HowToDirection", "HowToTip"]
PRODUCTS, ORGANIZATIONS = ["Product", "ProductModel", "SoftwareApplication"], ["Organization", "Corporation", "LocalBusiness"]
TEXT_KEYS, NAME_KEYS = ["text", "name", "description", "reviewBody", "answer"], ["name", "legalName", "alternateName"]
SITE_METAS = ["og:site_name", "application-name", "apple-mobile-web-app-title"]


def reached(ld: Column, keys: list[str]) -> Column:
    """Rows of nodes that are reached by these keys alone."""
    pattern = "^(?:/(?:" + "|".join(keys) + "))*$"
    return F.filter(ld, lambda x: x["path"].rlike(pattern))


def _heads(rows: Column) -> Column:
    return F.filter(rows, lambda x: x["key"] == "")


def _values(rows: Column, node: Column, key: str) -> Column:
    """Plain values of a node under a key."""
    return F.transform(F.filter(rows, lambda x: (x["node"] == node) & (x["key"] == key)), lambda x: x["text"])


def _children(rows: Column, head: Column, key: str) -> Column:
    """Nodes that stand in a node under a key."""
    return F.filter(_heads(rows), lambda x: (x["parent"] == head["node"]) & (x["path"] == F.concat(head["path"], F.lit(f"/{key}"))))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), T.SPACE, " "))


def _one(rows: Column, node: Column, *keys: str) -> Column:
    """The first of a node's values under these keys that isn't empty; null where there is none."""
    return F.coalesce(*(F.nullif(F.get(_values(rows, node, k), F.lit(0)), F.lit("")) for k in keys))


def _texts_under(rows: Column, head: Column, key: str) -> Column:
    """Texts that a node holds under a key, plain or as nodes of their own."""
    inner = F.transform(_children(rows, head, key), lambda c: _flat(_one(rows, c["node"], *TEXT_KEYS)))
    return F.concat(F.transform(_values(rows, head["node"], key), _flat), inner)


def _number(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def nodes(ld: Column) -> Column:
    """schema.NODE of every node that claims can stand in: types, texts of answers and steps, review, rating, votes, profiles."""
    rows = reached(ld, CLAIMS_UNDER)
    empty = F.array().cast("array<string>")

    def told(head: Column) -> Column:
        node = head["node"]
        types = F.filter(F.transform(_values(rows, node, "@type"), lambda t: F.element_at(F.split(t, "/"), -1)), lambda t: t != "")
        has = lambda kinds: F.arrays_overlap(types, F.array(*map(F.lit, kinds)))
        answers = F.concat(*(_texts_under(rows, head, k) for k in ("acceptedAnswer", "suggestedAnswer")))
        own = F.filter(F.array(*(_flat(_one(rows, node, k)) for k in ("text", "name", "description"))), lambda t: T.word_count(t) >= 3)
        chunks = F.concat(F.when(has(["Question"]), answers).otherwise(empty), F.when(has(STEPS), F.concat(own, _texts_under(rows, head, "step"))).otherwise(empty))
        rated = F.when(has(["AggregateRating"]), node).otherwise(F.get(F.filter(_children(rows, head, "aggregateRating"), lambda c: ~c["listed"]), F.lit(0))["node"])
        votes = _number(_one(rows, rated, "ratingCount", "reviewCount"))
        same = F.filter(F.transform(_values(rows, node, "sameAs"), _flat), lambda u: u != "")
        return F.struct(
            types.alias("types"), F.filter(chunks, lambda t: t != "").alias("chunks"), _flat(_one(rows, node, "reviewBody")).alias("review"), _number(_one(rows, rated, "ratingValue")).alias("rating"),
            F.when(F.abs(votes) <= 2**31 - 1, votes.cast("int")).alias("votes"), same.alias("same_as"),
        )

    return F.transform(_heads(rows), told)


def _valid(name: Column) -> Column:
    """A name fit to call a page by, else null."""
    flat = _flat(name)
    return F.when(F.length(flat).between(2, 80) & ~F.lower(flat).isin(C.GENERIC_NAMES), flat)


def named(ld: Column, metas: Column) -> Column:
    """Struct of site_name, organization, brand and product: the first of each that the page's metas and nodes give, in order of the nodes; else empty."""
    rows = reached(ld, NAMES_UNDER)

    def of(head: Column, key: str) -> Column:
        """The name a node has under a key: a value that is no list, or the name of a node that stands there."""
        plain = F.get(F.filter(rows, lambda x: (x["node"] == head["node"]) & (x["key"] == key) & ~x["many"]), F.lit(0))["text"]
        inner = F.get(F.filter(_children(rows, head, key), lambda c: ~c["listed"]), F.lit(0))["node"]
        return F.coalesce(_valid(F.nullif(plain, F.lit(""))), *(_valid(_one(rows, inner, k)) for k in NAME_KEYS))

    def first(tell) -> Column:
        found = F.flatten(F.transform(_heads(rows), lambda h: F.array(*tell(h))))
        return F.get(F.filter(found, lambda n: n.isNotNull()), F.lit(0))

    def own(head: Column, kinds: list[str]) -> Column:
        name = _valid(_one(rows, head["node"], "name", "alternateName"))
        return F.when(F.arrays_overlap(_values(rows, head["node"], "@type"), F.array(*map(F.lit, kinds))), name)

    told = {
        "site_name": F.coalesce(*(_valid(metas[m]) for m in SITE_METAS)),
        "organization": first(lambda h: [own(h, ORGANIZATIONS), F.coalesce(of(h, "publisher"), of(h, "provider"))]),
        "brand": F.coalesce(first(lambda h: [own(h, ["Brand", *ORGANIZATIONS]), of(h, "brand")]), _valid(metas["product:brand"])),
        "product": first(lambda h: [own(h, PRODUCTS)]),
    }
    return F.struct(*(F.coalesce(c, F.lit("")).alias(k) for k, c in told.items()))
