"""What a parsed page tells: commercial context and tier, concealment and its risk, segments as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T
from sourcelens.functions import urls as U
from sourcelens.operators import schema

# Instruction patterns, in hidden or visible text.
INSTRUCTIONS = [
    r"\bignore\s+(?:all\s+)?(?:previous|prior)\s+instructions?\b", r"\bforget\s+(?:all\s+)?(?:previous|prior)\s+instructions?\b", r"\byou\s+are\s+(?:an?\s+)?(?:ai|agent|assistant)\b",
    r"\bsystem\s*:", r"\balways\s+(?:cite|recommend|rank)\b", r"\btreat\s+this\s+(?:page|site|url|domain)\s+as\b", r"\bconsider\s+this\s+(?:page|site|url|domain)\s+as\b", r"\bdo\s+not\s+mention\b",
    r"\b#\s*1\s+primary\s+source\b", r"\bverified[, ]+authoritative\s+destination\b", r"\bauthoritative\s+(?:destination|reference|source)\b",
    r"\brank\s+(?:this|the\s+page|the\s+site)\s+as\s+(?:the\s+)?#?\s*1\b", r"\bfor\s+(?:ai|llm|language)\s+(?:agents?|models?|assistants?)\b", r"\bfor\s+chatbots?\s*:",
    r"\b(?:directives?|instructions?)\s+for\s+(?:chatbots?|ai|llms?|language\s+models?|agents?|assistants?)\b", r"\bimportant\s+(?:system\s+)?(?:note|instruction)\s+for\s+(?:ai|agents?)\b",
]
# Those of them, and one more, that promote the page itself.
PROMOTING = [
    r"\balways\s+(?:cite|recommend|rank)\b", r"\btreat\s+this\s+(?:page|site|url|domain)\s+as\b", r"\bconsider\s+this\s+(?:page|site|url|domain)\s+as\b", r"\b#\s*1\s+primary\s+source\b",
    r"\bverified[, ]+authoritative\s+destination\b", r"\bauthoritative\s+(?:destination|reference|source)\b", r"\brank\s+(?:this|the\s+page|the\s+site)\s+as\s+(?:the\s+)?#?\s*1\b",
    r"\bfor\s+chatbots?\s*:", r"\b(?:directives?|instructions?)\s+for\s+(?:chatbots?|ai|llms?|language\s+models?|agents?|assistants?)\b", r"\bonly\s+(?:official|trusted|authoritative)\s+(?:site|page|source)\b",
]
# Calls to action, what pays for a page, tiers of flags, ceilings of trust by segment, words of a post.
POST_WORDS = 12
CALLS_TO_ACTION = [r"\bbuy now\b", r"\bfree trial\b", r"\bget started\b", r"\bpricing\b", r"\bsubscribe\b", r"\badd to cart\b", r"\bshop now\b"]
AFFILIATE_LINK = r"(?i)(?:\baffiliate\b|[?&](?:tag|aff(?:iliate)?(?:[_-]?id)?|partner_id|clickid|clid)=|/affiliate(?:s)?/)"
PRESS = r"\bfor immediate release\b|\bpress release\b"
COMMERCIAL_PATH = r"(?i)/(pricing|buy|shop|cart|checkout|trial)\b"
HIGH_TIER, MEDIUM_TIER = ("affiliate_disclosure", "link_sponsored", "structured_funding"), ("affiliate_link_params", "press_release", "commercial_cta")
CEILINGS = {"main_post": 1.0, "body": 1.0, "comment": 0.65, "nested_comment": 0.55, "sidebar": 0.45, "footer": 0.35}


def instructs(plain: Column) -> Column:
    """Lower-case plain text with an instruction to a machine."""
    return plain.rlike("|".join(f"(?:{p})" for p in INSTRUCTIONS))


def page_context(parsed: DataFrame) -> DataFrame:
    """Adds cta_density, commercial_score, structure_density, context_flags, commercial_tier to parsed pages."""
    scope = F.when(F.col("main_text") != "", F.col("main_text")).otherwise(F.col("text"))
    parsed = parsed.withColumns({"_scope": T.plain(scope), "_words": F.greatest(T.word_count(scope), F.lit(1))})
    words, plain = F.col("_words"), F.col("_scope")
    cta = F.least(F.lit(1.0), T.hits(plain, CALLS_TO_ACTION) / words * 20)
    main_links = F.filter("links", lambda x: ~x["chrome"])
    affiliate, sponsored = F.exists(main_links, lambda x: x["href"].rlike(AFFILIATE_LINK)), F.exists(main_links, lambda x: x["sponsored"])
    chrome_only = F.exists("links", lambda x: x["chrome"] & (x["sponsored"] | x["href"].rlike(AFFILIATE_LINK))) & ~affiliate & ~sponsored
    faq, ratio = F.array_contains("ld_types", "FAQPage"), F.least(F.lit(1.0), F.col("list_items") / F.greatest(words / 10, F.lit(1.0)))
    flag = lambda test, name: F.when(test, F.lit(name))
    flags = F.array_compact(
        F.array(
            flag(cta > 0.15, "commercial_cta"), flag(plain.rlike(C.AFFILIATE_TEXT), "affiliate_disclosure"), flag(plain.rlike(PRESS), "press_release"),
            flag(affiliate, "affiliate_link_params"), flag(sponsored, "link_sponsored"), flag(chrome_only, "site_chrome_monetization"),
            flag(F.coalesce("funding", F.lit(False)), "structured_funding"), flag(faq, "faq_schema"), flag(ratio > 0.5, "list_heavy"), flag(F.col("tables") >= 2, "table_heavy"),
        )
    )
    out = parsed.withColumn("cta_density", cta).withColumn("context_flags", flags)
    out = out.withColumn("commercial_score", F.least(F.lit(1.0), cta * 0.7 + F.when(F.array_contains("context_flags", "commercial_cta"), 0.3).otherwise(0.0)))
    out = out.withColumn("structure_density", F.least(F.lit(1.0), 0.4 * ratio + 0.3 * F.least(F.lit(1.0), F.col("tables") / 3) + F.when(faq, 0.3).otherwise(0.0)))
    has = lambda *names: F.arrays_overlap("context_flags", F.array(*map(F.lit, names)))
    tier = (
        F.when(has(*HIGH_TIER), "high").when(has(*MEDIUM_TIER), "medium")
        .when((F.col("commercial_score") > 0.5) | U.path(F.col("url")).rlike(COMMERCIAL_PATH), "low").otherwise("none")
    )
    path = U.path(F.col("url")).rlike(COMMERCIAL_PATH)
    named = F.filter("context_flags", lambda f: f.isin(*HIGH_TIER, *MEDIUM_TIER))
    scored = F.array_compact(F.array(F.when(F.col("commercial_score") > 0.5, "commercial_context_score"), F.when(path, "commercial_url_path")))
    return out.withColumns({"commercial_tier": tier, "commercial_triggers": F.when(F.size(named) > 0, named).otherwise(scored)}).drop("_scope", "_words")


def _with_rhetoric(rows: DataFrame, *texts: str) -> DataFrame:
    """Adds for each column of plain lower-case text, as _r and its name, which of three kinds of rhetoric it has.

    Words and the two windows are columns of their own, so that a pattern doesn't split the text anew.
    """
    window, both = C.FRONT_WINDOW_WORDS, C.AUTHORITY + C.COMPARATIVE
    out = rows.withColumns({f"_w{t}": T.words(F.col(t)) for t in texts})
    out = out.withColumns({f"_h{t}": F.array_join(F.slice(f"_w{t}", 1, window), " ") for t in texts} | {f"_t{t}": F.array_join(F.slice(f"_w{t}", window + 1, F.greatest(F.size(f"_w{t}") - window, F.lit(0))), " ") for t in texts} | {f"_n{t}": F.size(f"_w{t}") for t in texts})
    told = {}
    for t in texts:
        n = F.col(f"_n{t}")
        told |= {f"_h{t}": T.density(F.col(f"_h{t}"), F.least(n, F.lit(window)), both), f"_t{t}": T.density(F.col(f"_t{t}"), F.greatest(n - window, F.lit(0)), both)}
        told |= {f"_a{t}": T.density(F.col(t), n, C.AUTHORITY), f"_c{t}": T.density(F.col(t), n, C.COMPARATIVE)}
    out = out.drop(*(f"_w{t}" for t in texts)).withColumns(told)
    flag = lambda test, name: F.when(test, F.lit(name))
    front = lambda t: (F.col(f"_n{t}") >= C.FRONT_LEAST_WORDS) & (F.coalesce(F.try_divide(f"_h{t}", F.col(f"_h{t}") + F.col(f"_t{t}")), F.lit(0.0)) > 0.65)
    made = {f"_r{t}": F.array_compact(F.array(flag(F.col(f"_a{t}") > C.AUTHORITY_FLAG, "authority"), flag(F.col(f"_c{t}") > C.COMPARATIVE_FLAG, "comparative"), flag(front(t), "front"))) for t in texts}
    return out.withColumns(made).drop(*(f"_{x}{t}" for x in "htac" for t in texts))


def concealment(parsed: DataFrame) -> DataFrame:
    """Adds hidden_words, hidden_ratio, hidden_blocks, structured_words, concealment_flags, concealment_excerpt, concealment_risk to parsed pages.

    A block for screen readers counts only if it instructs. A meta text counts only where it differs from the page.
    """
    joined = lambda parts: F.array_join(F.transform(parts, lambda b: b["text"]), " ")
    low = lambda text: T.plain(F.coalesce(text, F.lit("")))
    out = parsed.withColumns({"_visible": low(F.col("text")), "_seen": schema.token_set(F.col("text"))})
    out = out.withColumn("_blocks", F.filter("blocks", lambda b: ~b["reader"] | instructs(low(b["text"]))))
    counts = lambda c: ~c["channel"].startswith("meta:") | schema.meta_diverges(c["text"], F.col("_seen"), instructs(low(c["text"])))
    out = out.withColumn("_parts", F.filter("channels", counts))
    told = lambda c: c["channel"].startswith("meta:") | instructs(low(c["text"])) | ((c["channel"] == "application/ld+json") & schema.sells_software(c["text"]))
    out = out.withColumn("_flagged", F.filter("_parts", told))
    out = out.withColumns({
        "_open": low(F.concat_ws(" ", joined(F.filter("_blocks", lambda b: ~b["chrome"])), joined("_flagged"))),
        "_chrome": low(joined(F.filter("_blocks", lambda b: b["chrome"]))),
        "_hidden": low(F.concat_ws(" ", joined("_blocks"), joined("_parts"))),
        "hidden_words": T.word_count(joined("_blocks")), "structured_words": T.word_count(joined("_parts")), "hidden_blocks": F.size("_blocks"),
    })
    out = _with_rhetoric(out, "_open", "_chrome", "_visible")
    differs = lambda text, own: (F.col(f"_n{text}") >= 8) & (F.size(F.array_except(own, "_r_visible")) > 0)
    blocks, flagged = F.size("_blocks") > 0, F.size("_flagged") > 0
    in_hidden, in_visible, geo = instructs(F.col("_hidden")), instructs(F.col("_visible")), differs("_open", "_r_open")
    structured = flagged | ((F.size("_parts") > 0) & instructs(low(joined("_parts"))))
    any_ = blocks | structured
    promoting = "|".join(f"(?:{p})" for p in PROMOTING)
    promotes = (in_hidden & F.col("_hidden").rlike(promoting)) | (in_visible & F.col("_visible").rlike(promoting))
    flag = lambda test, name: F.when(test, F.lit(name))
    flags = F.array_compact(
        F.array(
            flag(blocks, "css_concealed_content"), flag(F.exists("_blocks", lambda b: b["offscreen"]), "offscreen_positioned"), flag(structured, "structured_concealed"), flag(in_hidden, "hidden_instruction_pattern"),
            flag(any_ & geo, "hidden_geo_rhetoric"), flag(any_ & ~geo & schema.is_dense_chrome(F.col("_chrome")) & differs("_chrome", "_r_chrome"), "hidden_chrome_rhetoric"),
            flag(in_visible, "visible_instruction_pattern"), flag(promotes, "promotional_instruction_pattern"),
        )
    )
    flags = F.concat(flags, schema.mismatch_flags(F.col("ld_nodes"), F.col("text"), F.col("_seen")), F.when(F.col("paywalled"), F.array(F.lit("paywall_suspected"))).otherwise(F.array().cast("array<string>")))
    source = F.filter(F.transform(F.concat(F.transform("_blocks", lambda b: b["text"]), F.transform("_parts", lambda c: c["text"])), lambda t: F.when(instructs(low(t)), t)), lambda t: t.isNotNull())
    longest = F.get(F.array_sort(F.transform("_blocks", lambda b: F.struct((-T.word_count(b["text"])).alias("n"), b["text"].alias("text")))), F.lit(0))["text"]
    excerpt = F.coalesce(F.get(source, F.lit(0)), F.when(in_visible, instruction_excerpt(F.col("text"))), longest, F.get("_flagged", F.lit(0))["text"], F.lit(""))
    total = F.greatest(F.col("hidden_words") + T.word_count(F.col("text")), F.lit(1))
    out = out.withColumns({"hidden_ratio": F.round(F.col("hidden_words") / total, 4), "concealment_flags": flags, "concealment_excerpt": F.substring(excerpt, 1, 300)})
    return out.withColumn("concealment_risk", concealment_risk(F.col("concealment_flags"))).drop("_visible", "_seen", "_blocks", "_parts", "_flagged", "_open", "_chrome", "_hidden", "_r_open", "_r_chrome", "_r_visible", "_n_open", "_n_chrome", "_n_visible")


def instruction_excerpt(text: Column, most: int = 300) -> Column:
    """A window around a text's first instruction; of several kinds the first of INSTRUCTIONS counts."""
    found = [F.nullif(F.regexp_extract(text, rf"(?is)(.{{0,40}}(?:{p}).{{0,{most}}})", 1), F.lit("")) for p in INSTRUCTIONS]
    return F.substring(F.trim(F.regexp_replace(F.coalesce(*found, F.lit("")), r"\s+", " ")), 1, most)


def identity(parsed: DataFrame) -> DataFrame:
    """Adds site_name, organization, brand, product and aliases: what a page calls itself, else its path, title or domain."""
    site, organization, brand, product = (F.nullif(F.col(f"named.{c}"), F.lit("")) for c in ("site_name", "organization", "brand", "product"))
    publisher = F.substring_index(U.registrable_domain(U.authority(F.col("url"))), ".", 1)
    title = F.regexp_replace(F.trim(F.regexp_extract("title", r"^(.*?)(?:\s*[|\-\x{2013}\x{2014}]\s*.*)?$", 1)), f"(?i){C.LISTICLE_PREFIX}", "")
    title = F.substring(F.trim(F.regexp_replace(F.regexp_replace(title, r"(?i)\b(we'?ve\s+tested|buying\s+guide|picks?|reviewed?|reviews?|comparison|vs\.?|for\s+20\d{2}|20\d{2})\b", " "), r"\s+", " ")), 1, 120)
    organization = F.coalesce(organization, site, F.when(F.length(publisher) >= 4, publisher), F.lit(""))
    brand = F.coalesce(brand, site, F.nullif(organization, F.lit("")), F.lit(""))
    repeats = F.lower(title).isin(F.lower(brand), F.lower(organization), F.lower(F.coalesce(site, F.lit(""))))
    product = F.coalesce(product, F.nullif(U.product_slug(F.col("url")), F.lit("")), F.when((F.length(title) >= 4) & ~repeats, title), F.lit(""))
    names = F.filter(F.array(product, brand, organization, F.coalesce(site, F.lit("")), publisher), lambda n: F.length(n).between(4, 80) & ~F.lower(n).isin(C.GENERIC_NAMES) & ~n.rlike(r"^\d+$"))
    low = F.transform(names, F.lower)
    once = F.filter(names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)
    bare = F.filter(F.transform(once, lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", "")), lambda n: (F.length(n) >= 5) & ~n.rlike(r"^\d+$"))
    return parsed.withColumns({"site_name": F.coalesce(site, F.lit("")), "organization": organization, "brand": brand, "product": product, "aliases": F.concat(once, F.array_distinct(F.array_except(bare, F.transform(once, F.lower))))})


def concealment_risk(flags: Column) -> Column:
    has = lambda name: F.array_contains(flags, name)
    mismatch = F.exists(flags, lambda f: f.startswith("schema_"))
    attack = has("hidden_instruction_pattern") | (has("structured_concealed") & has("promotional_instruction_pattern")) | (has("visible_instruction_pattern") & has("promotional_instruction_pattern"))
    return F.when(attack, 0.95).when(has("visible_instruction_pattern") | has("hidden_geo_rhetoric") | mismatch, 0.55).when(has("hidden_chrome_rhetoric"), 0.35).otherwise(0.0)


def segment_chunks(parsed: DataFrame, *by: str) -> DataFrame:
    """url, chunk_id, segment, text: the chunks of each segment, or of the whole visible text where there is none.

    A thread without any mark-up of its posts is read by its sentences: the first long one is the post, the others comments.
    by: columns that tell pages of one url apart; their segments are then numbered together, footers last, so that no two
    chunks of a url share a name.
    """
    whole = F.array(F.struct(F.lit("body").alias("role"), F.col("text").alias("text")))
    said = F.filter(F.split(F.regexp_replace("text", r"([.!?])\s+(?=[A-Z\"'])", "$1\u0001"), "\u0001"), lambda p: T.word_count(p) >= POST_WORDS)
    posts = F.transform(said, lambda p, i: F.struct(F.when(i == 0, "main_post").otherwise("comment").alias("role"), p.alias("text")))
    thread = F.lower(U.path(F.col("url"))).rlike(C.THREAD_PATH) & (F.size(said) >= 2)
    parsed = parsed.withColumn("segments", F.when((F.size("segments") == 0) & thread, posts).otherwise(F.col("segments")))
    rows = parsed.select(*by, "url", F.size("segments").alias("n"), F.posexplode(F.when(F.size("segments") > 0, F.col("segments")).otherwise(whole)).alias("i", "s"))
    if by:
        order = W.partitionBy("url", F.col("n") > 0).orderBy(F.col("s.role") == "footer", "i", *by)
        rows = rows.withColumn("i", F.row_number().over(order) - 1)
    cut = rows.select("url", "n", "i", F.col("s.role").alias("segment"), F.explode(T.chunks(F.col("s.text"))).alias("c"))
    name = F.when(F.col("n") > 0, F.concat("segment", F.lit("__"), "segment", F.lit("_"), F.col("i").cast("string"), F.lit("_"), F.col("c.chunk_id"))).otherwise(F.col("c.chunk_id"))
    return cut.select("url", name.alias("chunk_id"), "segment", F.col("c.text").alias("text"))


def trust_ceiling(segment: Column, role: Column) -> Column:
    base = F.coalesce(F.create_map(*(x for k, v in CEILINGS.items() for x in (F.lit(k), F.lit(v))))[segment], F.lit(1.0))
    out = F.when((role == "ugc_thread") & segment.isin("comment", "nested_comment"), F.least(base, F.lit(0.6))).otherwise(base)
    return F.when((role == "review_profile") & (segment != "main_post"), F.least(out, F.lit(0.5))).otherwise(out)


def is_low_trust(segment: Column, role: Column) -> Column:
    """Parts of a page that others than its author can write."""
    return segment.isin("comment", "nested_comment", "sidebar", "footer") | (role.isin("ugc_thread", "review_profile", "expert_listicle") & (segment != "main_post"))


def retrieval_multiplier(segment: Column, role: Column, intent: Column) -> Column:
    base = F.when(segment.isin("sidebar", "footer"), 0.35).when(segment == "nested_comment", 0.45).when(segment == "comment", 0.5).otherwise(1.0)
    thread = F.when(intent == "commercial", 0.4).otherwise(0.55)
    return F.when((role == "ugc_thread") & segment.isin("comment", "nested_comment"), F.least(base, thread)).otherwise(base)
