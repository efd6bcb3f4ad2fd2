"""Structured data that claims what a page doesn't show: answers, ratings, reviews, profiles.

Works on a page's JSON-LD nodes as the parse gives them: types, chunks (texts of answers and steps), review, rating,
votes and same_as. A page's nodes are few; everything is higher-order functions over its arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import fetch
from sourcelens.functions import text as T

NODE = "struct<types array<string>, chunks array<string>, review string, rating double, votes int, same_as array<string>>"


def token_set(text: Column) -> Column:
    """Runs of four or more letters and digits, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{4,})"), F.lit(1)))


def overlap(needle: Column, tokens: Column) -> Column:
    """Share of a text's tokens among others; 1 for a text without any."""
    own = token_set(needle)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, tokens)), F.size(own)), F.lit(1.0))


def meta_diverges(meta: Column, seen: Column, instructs: Column) -> Column:
    """seen: the visible text's token_set()."""
    own = token_set(meta)
    return instructs | ((F.size(own) >= 5) & (overlap(meta, seen) < 0.25))


def is_stuffed(text: Column) -> Column:
    """Comparative or authoritative packaging of answers."""
    low = F.lower(text)
    hits, best = F.regexp_count(low, F.lit(C.COMPARATIVE_HIT)), best_phrases(low)
    return (hits >= 3) | ((F.size(best) >= 2) & (hits >= 2)) | ((F.regexp_count(low, F.lit(C.STACKED_AUTHORITY)) >= 2) & (hits >= 1))


def best_phrases(low: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(f"({C.BEST_PHRASE})"), F.lit(1)), lambda p: F.trim(p)))


def is_dense_chrome(text: Column) -> Column:
    """Hidden chrome that is more than boilerplate."""
    low = F.lower(F.coalesce(text, F.lit("")))
    best, ranked = best_phrases(low), F.regexp_count(low, F.lit(C.RANKED))
    return (T.word_count(text) >= 40) | (F.regexp_count(low, F.lit(C.COMPARATIVE_HIT)) >= 3) | (F.size(best) >= 2) | ((F.size(best) >= 1) & (ranked >= 1))


def sells_software(text: Column) -> Column:
    """Structured data about payment, or a priced application."""
    low = F.lower(text)
    return fetch.holds(low, C.PAYMENT_WORDS) | (F.replace(low, F.lit(" "), F.lit("")).contains("softwareapplication") & (low.contains("offer") | low.contains("price")))


def mismatch_flags(nodes: Column, visible: Column, seen: Column) -> Column:
    """schema_ flags, in order; of the two about answers and of the two about ratings at most one.

    seen: the visible text's token_set(), as a column of its own, so that it is made once a page and not for each answer.
    """
    n_visible = T.word_count(visible)
    has = lambda node, kinds: F.arrays_overlap(node["types"], F.array(*map(F.lit, kinds)))
    all_chunks = F.flatten(F.transform(nodes, lambda x: x["chunks"]))
    low = F.transform(all_chunks, F.lower)
    chunks = F.filter(all_chunks, lambda c, i: F.array_position(low, F.lower(c)) == i + 1)
    questions = F.size(F.filter(nodes, lambda x: has(x, ["Question"])))
    joined = F.array_join(chunks, " ")
    n_words, n = T.word_count(joined), F.size(chunks)
    large = (n > 0) & ((questions >= 5) | (n_words >= 150) | (n >= 5))
    mean = F.coalesce(F.try_divide(F.aggregate(chunks, F.lit(0.0), lambda a, c: a + overlap(c, seen)), n), F.lit(1.0))
    dwarfs = (n_words >= 150) & (n_visible > 0) & (n_words >= 3 * n_visible)
    differs = large & ((mean < 0.25) | (dwarfs & (mean < 0.4)))
    mirrored = large & ~differs & (mean >= 0.6) & is_stuffed(joined)

    extreme = F.exists(nodes, lambda x: F.coalesce((x["rating"] >= 4.5) & (x["votes"] >= 50), F.lit(False)))
    reviews = F.filter(F.transform(F.filter(nodes, lambda x: has(x, ["Review"])), lambda x: x["review"]), lambda r: F.coalesce(r, F.lit("")) != "")
    shown = F.filter(reviews, lambda r: overlap(r, seen) >= 0.5)
    words = F.lower(F.coalesce(visible, F.lit("")))
    told, stars = F.regexp_count(words, F.lit(r"\breviews?\b")), F.regexp_count(words, F.lit(r"\b(?:stars?|out of 5|/\s*5)\b"))
    evident = (n_visible > 0) & ((F.size(shown) >= 2) | (told >= 3) | ((told >= 1) & (stars >= 2)))
    missing = F.size(F.filter(reviews, lambda r: overlap(r, seen) < 0.25))
    unshown = (extreme & ~evident) | ((F.size(reviews) >= 5) & (missing >= 0.7 * F.size(reviews)))
    alike = F.flatten(F.transform(shown, lambda a, i: F.transform(F.slice(shown, i + 2, F.size(shown)), lambda b: (overlap(a, token_set(b)) + overlap(b, token_set(a))) / 2)))
    cloned = extreme & (F.size(shown) >= 3) & (F.size(F.filter(alike, lambda s: s >= 0.7)) >= 0.5 * F.size(alike))

    def inflated(node: Column) -> Column:
        host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://([^/]+)", 1)), r"^www\.", "")
        hosts = F.filter(F.transform(F.coalesce(node["same_as"], F.array().cast("array<string>")), host), lambda h: h != "")
        known = lambda h: F.exists(F.array(*map(F.lit, C.STRONG_PROFILES)), lambda s: (h == s) | h.endswith(F.concat(F.lit("."), s)))
        strong, weak = F.size(F.filter(hosts, known)), F.size(F.filter(hosts, lambda h: fetch.holds(h, C.WEAK_PROFILES)))
        repeats = 1 - F.try_divide(F.size(F.array_distinct(hosts)), F.size(hosts))
        return has(node, C.ENTITY_TYPES) & (F.size(hosts) >= 8) & ((F.size(hosts) - strong >= 6) | (repeats >= 0.35) | (weak >= 4))

    flag = lambda test, name: F.when(test, F.lit(name))
    return F.array_compact(F.array(
        flag(differs, "schema_faq_body_mismatch"), flag(mirrored, "schema_faq_dual_channel_stuffed"), flag(unshown, "schema_rating_without_reviews"),
        flag(cloned & ~unshown, "schema_rating_templated_reviews"), flag(F.exists(nodes, inflated), "schema_sameas_inflated"),
    ))
