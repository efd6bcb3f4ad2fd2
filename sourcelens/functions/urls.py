"""Columns over URLs: hosts, registrable domains, page roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelens import config as C

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def authority(url: Column) -> Column:
    """Host with port, case kept."""
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def hostname(url: Column) -> Column:
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.|:\d*$", "")


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three where those two are a public suffix."""
    parts = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")
    n = F.size(parts)
    last = lambda k: F.array_join(F.slice(parts, F.greatest(n - (k - 1), F.lit(1)), k), ".")
    return F.when((n >= 3) & last(2).isin(C.TWO_LABEL_SUFFIXES), last(3)).when(n >= 2, last(2)).otherwise(F.array_join(parts, "."))


def is_news(host: Column) -> Column:
    found = F.lit(False)
    for apex in C.NEWS_HOSTS:
        found = found | (host == apex) | host.endswith("." + apex)
    return found


def is_directory(url: Column) -> Column:
    bare = F.regexp_replace(path(url), r"^/+|/+$", "")
    return path(url).rlike(C.DIRECTORY_PATH) | ((bare != "") & ~bare.contains("/") & bare.rlike(r"(?i)forums?$"))


def is_thread(url: Column) -> Column:
    blob = F.concat_ws("?", path(url), F.nullif(query_string(url), F.lit("")))
    return path(url).rlike(C.THREAD_PATH) | blob.rlike(C.THREAD_PATH) | blob.rlike(C.FORUM_QUERY)


def is_video(url: Column) -> Column:
    host, bare = F.lower(authority(url)), F.regexp_replace(path(url), r"^/+|/+$", "")
    short = (host == "youtu.be") | host.endswith(".youtu.be")
    return host.rlike(C.VIDEO_HOST) & F.when(short, (bare != "") & ~bare.contains("/")).otherwise(path(url).rlike(C.VIDEO_PATH))


def is_open_posting(url: Column) -> Column:
    host = hostname(url)
    forum = host.startswith("forums.") | host.startswith("forum.")
    return host.rlike(C.FORUM_HOST) | (forum & ~is_directory(url)) | is_thread(url) | path(url).rlike(C.SOCIAL_PATH) | is_video(url)


def is_publish(url: Column) -> Column:
    return path(url).rlike(C.PUBLISH_PATH)


#: Characters of a page's text that its role is read from.
ROLE_CHARS = 2000


def page_role(url: Column, tier: Column | None = None, has_cta: Column | None = None, text: Column | None = None) -> Column:
    """One of seven roles; the first rule that holds. tier and has_cta come from the page's context, text from its fetch."""
    host, p = hostname(url), F.lower(path(url))
    out = (
        F.when(host.endswith(".gov") | host.endswith(".edu"), "institutional")
        .when(is_open_posting(url), "ugc_thread")
        .when(p.rlike(C.PICKS_PATH), "editorial")
        .when(p.rlike(C.REVIEW_PATH), "review_profile")
        .when(is_directory(url), "expert_listicle")
        .when(p.rlike(C.PUBLISH_PATH) | p.rlike(r"/newsletter\b"), "expert_listicle")
        .when(p.rlike(C.PRODUCT_PATH), "commercial_product")
        .when(p.rlike(C.SPEC_PATH) | host.startswith("psref."), "commercial_product")
    )
    if tier is not None:
        sells = tier.isin("medium", "high")
        out = out.when(sells & F.coalesce(has_cta, F.lit(False)), "commercial_product").when(sells, "expert_listicle")
    out = out.when(p.rlike(r"/(wiki|docs|reference|encyclopedia)\b"), "factual_blog")
    if text is not None:
        head = F.lower(F.substring(text, 1, ROLE_CHARS))
        out = out.when(head.rlike(C.BUY_TEXT), "commercial_product").when(head.rlike(C.AFFILIATE_TEXT), "expert_listicle")
    return out.otherwise("factual_blog")


def is_parasitic(url: Column, role: Column, high_risk: Column | None = None) -> Column:
    """Surfaces on which third parties can place a mention."""
    risk = F.lit(False) if high_risk is None else F.coalesce(high_risk, F.lit(False))
    return is_open_posting(url) | is_publish(url) | is_directory(url) | role.isin("review_profile", "ugc_thread") | ((role == "factual_blog") & risk)


def query_intent(query: Column) -> Column:
    """hostname and navigational phrases, then high stakes, then how-to and information against shopping; default informational."""
    q = F.lower(F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " ")))
    best_how, how, shop, info = q.rlike(C.BEST_HOW_TO), q.rlike(C.HOW_TO), q.rlike(C.COMMERCIAL), q.rlike(C.INFORMATIONAL)
    return (
        F.when(q == "", "informational")
        .when(q.rlike(C.HOSTNAME) | q.rlike(C.NAVIGATIONAL), "navigational")
        .when(q.rlike(C.HIGH_STAKES), "informational_high_stakes")
        .when((best_how | info) & shop & ~best_how & ~how, "commercial")
        .when(best_how | info, "informational")
        .when(shop, "commercial")
        .otherwise("informational")
    )


def apex(host: Column) -> Column:
    """The last two labels; a listed news host as it is."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^www\.", ""), r"^\.+|\.+$", "")
    parts = F.split(bare, r"\.")
    return F.when(bare.isin(C.NEWS_HOSTS) | (F.size(parts) < 2), bare).otherwise(F.array_join(F.slice(parts, -2, 2), "."))


def is_ugc(role: Column) -> Column:
    return role == "ugc_thread"


def normalised(url: Column) -> Column:
    """Lower case, percent signs decoded, no slash at the end; a plus stays one."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"/+$", "")
    return F.lower(F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare))


def distinct_urls(urls: Column, most: int | None = None) -> Column:
    """An array's URLs in order, of those alike once normalised() the first; empty ones go."""
    own = F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != "")
    names = F.transform(own, normalised)
    one = F.filter(own, lambda u, i: F.array_position(names, normalised(u)) == i + 1)
    return one if most is None else F.slice(one, 1, most)


def category_hint(url: Column) -> Column:
    """What a page lists, from its path or its search terms."""
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda p: p.startswith("best-") | p.startswith("the-best-"))
    named = F.trim(F.replace(F.replace(F.get(parts, F.lit(0)), F.lit("-"), F.lit(" ")), F.lit("the "), F.lit("")))
    query = F.lower(query_string(url))
    asked = lambda key: F.nullif(F.array_join(F.slice(F.filter(F.split(F.replace(F.regexp_extract(query, rf"{key}=([^&]+)", 1), F.lit("+"), F.lit(" ")), r"\s+"), lambda w: w != ""), 1, 4), " "), F.lit(""))
    return F.coalesce(named, asked("keywords"), asked("q"), asked("search"), F.lit("product"))


def price_hint(text: Column, url: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", F.substring(F.coalesce(text, F.lit("")), 1, 500), url))
    return F.coalesce(*(F.nullif(F.regexp_extract(blob, p, 1), F.lit("")) for p in C.PRICE_HINTS), F.lit("1000"))


def product_slug(url: Column) -> Column:
    """The last part of a path that looks like a product's name, as words; else empty."""
    parts = F.reverse(F.split(F.regexp_replace(F.lower(path(url)), r"^/+|/+$", ""), "/"))
    spaced = lambda p: F.replace(p, F.lit("-"), F.lit(" "))
    fits = lambda p: ~F.trim(p).isin(C.PATH_SKIP) & (F.length(p) >= 4) & ~p.rlike(C.PATH_DATE) & ~p.rlike(r"^\d+$") & ~spaced(p).rlike(C.LISTICLE_PREFIX)
    likely = lambda p: p.rlike(r"\d") | (p.contains("-") & (F.length(p) >= 6))
    name = F.trim(F.regexp_replace(spaced(F.get(F.filter(parts, lambda p: fits(p) & likely(p)), F.lit(0))), r"\s+", " "))
    return F.when(F.length(name).between(4, 60) & ~name.isin(C.GENERIC_NAMES), name).otherwise("")


def same_brand(a: Column, b: Column) -> Column:
    left, right = registrable_domain(authority(a)), registrable_domain(authority(b))
    return (left != "") & (left == right)


def related_brand(a: Column, b: Column) -> Column:
    """Other domains whose first labels agree but for hyphens."""
    left, right = registrable_domain(authority(a)), registrable_domain(authority(b))
    stem = lambda d: F.replace(F.substring_index(d, ".", 1), F.lit("-"), F.lit(""))
    return (left != "") & (right != "") & (left != right) & (F.length(stem(left)) >= C.STEM_LEAST) & (stem(left) == stem(right))


def saved_names(url: Column) -> Column:
    """Names under which a copy of a page may lie in a folder, the likelier first."""
    host, own = hostname(url), F.regexp_replace(path(url), r"/+$", "")
    own = F.when(own == "", "/").otherwise(own)
    slug = F.replace(F.regexp_replace(own, r"^/+|/+$", ""), F.lit("/"), F.lit("_"))
    slug = F.when(slug == "", "index").otherwise(slug)
    return F.array(F.concat(host, F.lit("_"), slug, F.lit(".html")), F.concat(host, F.replace(own, F.lit("/"), F.lit("_")), F.lit(".html")))


def raw_snapshot(url: Column) -> Column:
    """The address of an archive's snapshot without its toolbar; null where url is no such snapshot."""
    return F.when(url.rlike(r"^.*?/web/\d+/.+") & ~url.contains("id_/") & (F.regexp_extract(url, r"^(.*?)/web/", 1) == F.substring_index(url, "/web/", 1)), F.regexp_replace(url, r"^(.*?)/web/(\d+)/", "$1/web/$2id_/"))


def is_cited(urls: Column, target: Column) -> Column:
    """A target's address, or its path inside another's, among cited ones."""
    bare = lambda u: F.lower(F.regexp_replace(u, r"/+$", ""))
    own = F.lower(F.regexp_replace(path(target), r"/+$", ""))
    return F.coalesce(F.exists(urls, lambda u: (bare(u) == bare(target)) | ((own != "") & F.lower(path(u)).contains(own))), F.lit(False))


def markers(url: Column, entity: Column, org: Column, aliases: Column) -> Column:
    """What in another page's text ties it to this target: publisher, organisation, product and aliases, no generic words."""
    publisher = F.substring_index(registrable_domain(authority(url)), ".", 1)
    first = F.when((F.length(publisher) >= 4) & ~publisher.isin(C.ORG_STOPWORDS), F.array(publisher)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    given = F.concat(F.array(org, entity), F.coalesce(F.split(entity, r"[|\-\x{2013}\x{2014}:]"), none), F.coalesce(aliases, none))
    tidy = F.transform(F.array_compact(given), lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")))
    generic = lambda t: t.isin(C.WEAK_MARKERS) | t.isin(C.NAME_STOPWORDS) | (F.length(t) < 4) | t.rlike(r"^\d+$") | t.rlike("|".join(f"(?:{p})" for p in C.GENERIC_MARKERS))
    kept = F.filter(tidy, lambda t: ~t.isin(C.ORG_STOPWORDS) & ~generic(t))
    both = F.transform(kept, lambda t: F.array(F.when(F.length(t) <= 80, t), F.when(F.length(F.regexp_replace(t, "[^a-z0-9]", "")).between(5, 80), F.regexp_replace(t, "[^a-z0-9]", ""))))
    return F.array_distinct(F.concat(first, F.array_compact(F.flatten(both))))


def connection(blob: Column, target: Column, names: Column) -> Column:
    """How a page's lower-case text and markup tie it to a target: a struct of kind, confidence and marker, or null."""
    domain, own = registrable_domain(authority(target)), F.regexp_replace(F.lower(path(target)), r"^/+|/+$", "")
    link, host_path = F.lower(F.regexp_replace(target, r"/+$", "")), F.lower(F.concat(authority(target), path(target)))
    tie = lambda kind, sure, what: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), what.alias("marker"))
    named = F.get(F.filter(names, lambda m: blob.contains(m)), F.lit(0))
    return (
        F.when(blob.contains(link), tie("url_link", "high", link))
        .when(blob.contains(domain) & (own != "") & blob.contains(own), tie("url_link", "high", F.concat(domain, F.lit("/"), own)))
        .when(blob.contains(host_path), tie("url_link", "high", host_path))
        .when(named.isNotNull(), tie("brand_mention", "weak", named))
    )


def is_near_miss(blob: Column, names: Column) -> Column:
    """A page long enough, without a tie, in which some part of a marker stands after all."""
    parts = F.array_distinct(F.concat(names, F.filter(F.flatten(F.transform(names, lambda m: F.split(m, r"[\s\-_/]+"))), lambda p: F.length(p) >= 4)))
    bare = lambda t: F.regexp_replace(t, "[^a-z0-9]", "")
    return (F.length(blob) >= C.NEAR_MISS_CHARS) & F.exists(parts, lambda p: blob.contains(p) | ((F.length(bare(p)) >= 4) & bare(blob).contains(bare(p))))
