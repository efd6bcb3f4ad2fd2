"""Rhetoric, front-loading, trust and endorsement risk of texts, row by row in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T
from sourcelens.functions import urls as U
from sourcelens.operators import plants


def front_load_for(query: Column, head: Column, tail: Column, n_words: Column) -> Column:
    """Share of a query's own terms found in the first words of a text, as parts of words too, against those in the rest."""
    terms = F.filter(F.array_distinct(T.tokens(F.coalesce(query, F.lit("")))), lambda t: ~t.isin(C.QUERY_STOPWORDS) & (F.length(t) > 2))
    seen = lambda where: F.size(F.filter(terms, lambda t: where.contains(t)))
    return F.when(n_words < C.FRONT_LEAST_WORDS, 0.0).otherwise(F.coalesce(F.try_divide(seen(head), seen(head) + seen(tail)), F.lit(0.0)))


def densities(rows: DataFrame) -> DataFrame:
    """Adds what a text's signals are made of and no query changes: n_words, the densities, narrative, hedges, quotes, marks.

    A text that answers many queries is read once; for_query() makes the rest.
    """
    text = F.coalesce("text", F.lit(""))
    out = rows.withColumns({"n_words": T.word_count(F.col("text")), "_plain": T.plain(text), "_kept": F.regexp_replace(text, T.LETTER, "q")})
    families = (("authority", C.AUTHORITY), ("comparative", C.COMPARATIVE), ("temporal", C.TEMPORAL), ("purpose", C.PURPOSE), ("hedges", C.HEDGES))
    made = {name: T.density(F.col("_plain"), F.col("n_words"), patterns) for name, patterns in families}
    made["quotes"] = F.least(F.lit(1.0), T.hits(F.col("_kept"), C.QUOTES) / F.greatest("n_words", F.lit(1)) * 10)
    told = (("high_stakes_medical_claim", F.col("_plain").rlike(C.MEDICAL_CLAIM)), ("mentions_alternatives", F.col("_plain").rlike(C.ALTERNATIVES)), ("planted_mention", plants.planted(F.col("_plain"), F.col("n_words"))))
    made["marks"] = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in told)))
    out = out.withColumns(made).drop("_kept")
    return out.withColumn("narrative", F.least(F.lit(1.0), (F.col("authority") + F.col("comparative") + F.col("purpose")) / 2))


def _windows(w: Column) -> tuple[Column, Column]:
    """A text's first words and the rest, from its words."""
    n = C.FRONT_WINDOW_WORDS
    return F.array_join(F.slice(w, 1, n), " "), F.array_join(F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0))), " ")


def _scored(rows: DataFrame) -> DataFrame:
    """Adds rhetorical, semantic_risk, flags and retrieval_risk to rows with densities() and front_load."""
    raw = F.greatest(F.lit(0.0), 0.3 * F.col("authority") + 0.3 * F.col("narrative") + 0.25 * F.col("comparative") + 0.15 * F.col("temporal") - 0.35 * F.col("hedges"))
    out = rows.withColumn("_raw", raw)
    boosted = F.when((F.col("front_load") > 0.6) & (F.col("_raw") > 0), F.least(F.lit(1.0), F.col("_raw") * (1 + 0.25 * F.col("front_load")))).otherwise(F.col("_raw"))
    told = (
        ("authority_stacking", F.col("authority") > C.AUTHORITY_FLAG), ("comparative_superlatives", F.col("comparative") > C.COMPARATIVE_FLAG), ("high_stakes_medical_claim", F.array_contains("marks", "high_stakes_medical_claim")),
        ("balanced_hedging", F.col("hedges") > C.HEDGING_FLAG), ("front_loaded", F.col("front_load") > 0.65), ("quote_citation_heavy", F.col("quotes") > C.QUOTES_FLAG),
        ("mentions_alternatives", F.array_contains("marks", "mentions_alternatives")), ("planted_mention", F.array_contains("marks", "planted_mention")),
    )
    flags = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in told)))
    out = out.withColumns({"rhetorical": F.least(F.lit(1.0), F.col("_raw")), "semantic_risk": boosted, "flags": F.when(F.col("n_words") == 0, F.array(F.lit("empty_content"))).otherwise(flags)})
    return out.withColumn("retrieval_risk", retrieval_manipulation(F.col("rhetorical"))).drop("_raw", "marks")


def for_query(rows: DataFrame, query: str = "query") -> DataFrame:
    """rows with densities(), text and a query each: adds front_load (of the query's terms) and the signals that follow from it."""
    head, tail = _windows(F.col("_w"))
    out = rows.withColumn("_w", T.words(F.lower(F.coalesce("text", F.lit(""))))).withColumns({"_head": head, "_tail": tail})
    return _scored(out.withColumn("front_load", front_load_for(F.col(query), F.col("_head"), F.col("_tail"), F.col("n_words"))).drop("_w", "_head", "_tail"))


def content_signals(rows: DataFrame, query: str | None = None) -> DataFrame:
    """Adds n_words, the four densities, narrative, hedges, quotes, front_load, semantic_risk, flags, rhetorical, retrieval_risk.

    query: the column of the query that a text answers; then front_load counts the query's terms.
    """
    out = densities(rows)
    if query:
        return for_query(out.drop("_plain"), query)
    head, tail = _windows(F.col("_w"))
    out = out.withColumn("_w", T.words(F.col("_plain"))).withColumns({"_head": head, "_tail": tail})
    both, n = C.AUTHORITY + C.COMPARATIVE, C.FRONT_WINDOW_WORDS
    out = out.withColumns({"_first": T.density(F.col("_head"), F.least(F.size("_w"), F.lit(n)), both), "_rest": T.density(F.col("_tail"), F.greatest(F.size("_w") - n, F.lit(0)), both)})
    front = F.when(F.col("n_words") < C.FRONT_LEAST_WORDS, 0.0).otherwise(F.coalesce(F.try_divide(F.col("_first"), F.col("_first") + F.col("_rest")), F.lit(0.0)))
    return _scored(out.withColumn("front_load", front).drop("_first", "_rest", "_plain", "_w", "_head", "_tail"))


def retrieval_manipulation(rhetorical: Column) -> Column:
    """Front-loading, more where a row's text persuades."""
    persuasive = F.greatest(F.lit(0.2), rhetorical, F.col("comparative"), F.col("authority") * 0.5)
    return F.least(F.lit(1.0), F.col("front_load") * persuasive)


def trust_score(pages: DataFrame) -> Column:
    """Trust of a page. Uses those of these columns that pages has: ok, broken_link_ratio, dns_resolves, redirect_count,
    whois_age_days, cert_age_days, has_privacy_page, has_contact_page, commercial_score, hidden_instruction,
    hidden_payload; and always url, n_words and flags."""
    has = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in pages.columns else F.lit(default)
    host = U.hostname(F.col("url"))
    ok = has("ok", True)
    add = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    age = F.col("whois_age_days") if "whois_age_days" in pages.columns else F.lit(None).cast("int")
    cert = F.col("cert_age_days") if "cert_age_days" in pages.columns else F.lit(None).cast("int")
    total = F.lit(0.55)
    for part in (
        add(~ok, -0.35),
        add(has("broken_link_ratio", 0.0) > 0.4, -0.15),
        add(~has("dns_resolves", True) & ~ok, -0.20),
        add(host.rlike(C.SUSPICIOUS_TLD), -0.08),
        add(has("redirect_count", 0) > 2, -0.06),
        add((F.size(F.split(host, r"\.")) >= 4) & ~host.rlike(r"\.(gov|edu)$"), -0.05),
        F.when(age < 90, -0.20).when(age > 1095, 0.10).when(age.isNull() & (cert < 60), -0.08).otherwise(0.0),
        add(ok & host.rlike(r"\.(gov|edu)$"), 0.10),
        add(ok & U.is_news(host), 0.10),
        add(~F.col("url").rlike("(?i)^https:"), -0.12),
        add(has("has_privacy_page", False), 0.03),
        add(has("has_contact_page", False), 0.03),
        add(F.col("n_words") < C.THIN_WORDS, -0.10),
        add(F.array_contains("flags", "balanced_hedging"), 0.08),
        add(has("commercial_score", 0.0) > 0.5, -0.04),
        add(has("hidden_instruction", False), -0.25),
        add(has("hidden_payload", False), -0.08),
    ):
        total = total + part
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


#: Characters of a source's text that rules on its wording see.
EXCERPT = 500


def endorses(text: Column, comparative: Column, flags: Column) -> Column:
    """A text that recommends outright or by superlatives."""
    return T.plain(F.coalesce(text, F.lit(""))).rlike(C.ENDORSES) | (comparative > C.COMPARATIVE_FLAG) | F.array_contains(flags, "comparative_superlatives")


def endorsement_risk(query: Column, intent: Column, commercial_score: Column | None = None) -> Column:
    """Of a row with text, trust and content signals: high only where query, text and trust together earn no endorsement."""
    asks = T.plain(F.coalesce(query, F.lit(""))).rlike(C.WANTS_RECOMMENDATION)
    praise = endorses(F.substring("text", 1, EXCERPT), F.col("comparative"), F.col("flags"))
    balanced = F.arrays_overlap(F.col("flags"), F.array(F.lit("balanced_hedging"), F.lit("mentions_alternatives")))
    risk = F.col("semantic_risk") * F.greatest(F.col("front_load"), F.lit(0.35)) * (1 - F.col("trust"))
    risk = risk * F.when(asks, F.when(praise, 1.0).otherwise(0.35)).otherwise(0.25) * F.when(balanced, 0.2).otherwise(1.0)
    if commercial_score is not None:
        risk = risk * F.when((F.coalesce(commercial_score, F.lit(0.0)) > 0.4) & ~asks, 0.1).otherwise(1.0)
    low = F.col("trust") < C.TRUST_ENDORSEMENT_MIN
    risk = F.when(asks & praise & low & ~balanced, F.greatest(risk, F.lit(C.ENDORSEMENT_BLOCK))).otherwise(risk)
    risk = F.when(asks & low & F.array_contains("flags", "planted_mention"), F.greatest(risk, F.lit(C.ENDORSEMENT_DOWNRANK))).otherwise(risk)
    return F.when(intent.startswith("informational"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk))).otherwise(0.0)


def endorsement_action(risk: Column) -> Column:
    return F.when(risk >= C.ENDORSEMENT_BLOCK, "block_endorsement").when(risk >= C.ENDORSEMENT_DOWNRANK, "downrank").otherwise("pass")


def domain_signals(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds host and domain_flags. pages: url, redirect_count. facts: host, whois_age_days, cert_age_days, dns_resolves; a host without facts resolves."""
    host = F.lower(F.regexp_replace(U.authority(F.col("url")), r"^.*@|:\d*$", ""))
    own = pages.withColumn("host", host).join(facts.dropDuplicates(["host"]), "host", "left")
    https = F.col("url").rlike("(?i)^https:")
    whois, cert = F.col("whois_age_days"), F.col("cert_age_days")
    flags = F.array(
        F.when(~F.coalesce("dns_resolves", F.lit(True)), "dns_failure"),
        F.when(~https, "no_https"),
        F.when(whois < 90, F.format_string("young_domain_%dd", whois)).when(whois.isNull() & https & (cert < 60), F.format_string("young_cert_%dd", cert)),
        F.when(F.col("host").rlike(C.SUSPICIOUS_TLD), F.concat(F.lit("suspicious_tld."), F.substring_index("host", ".", -1))),
        F.when(F.col("redirect_count") > 2, F.format_string("excess_redirects_%d", F.col("redirect_count"))),
        F.when((F.size(F.split("host", r"\.")) >= 4) & ~F.col("host").rlike(r"\.(gov|edu)$"), "deep_subdomain"),
    )
    return own.select(*(pages[c] for c in pages.columns), "host", F.array_compact(flags).alias("domain_flags"))
