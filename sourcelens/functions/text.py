"""Columns over texts: tokens, words, pattern densities, chunks. All stay inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelens import config as C

#: Unicode white space, written so that every regex engine at hand reads it alike.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Letters beyond ASCII become one ASCII letter, so that \b and \w treat them as letters in every engine.
FOREIGN = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}]"
#: The same two for Spark's engine, which asks a class's parts one after the other: most characters are done with the first ones.
SPLIT = rf"[\x{{09}}-\x{{20}}\x{{85}}\x{{A0}}\x{{1680}}-\x{{3000}}&&{SPACE[:-1]}]+"
LETTER = rf"[\x{{AA}}-\x{{D7FF}}&&{FOREIGN}]"


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text, in order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def words(text: Column) -> Column:
    """What white space parts; a null text has no words."""
    return F.coalesce(F.array_remove(F.split(text, SPLIT), ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def plain(text: Column) -> Column:
    """Lower-case text fit for patterns with word boundaries."""
    return F.regexp_replace(F.lower(text), LETTER, "q")


def needed(pattern: str) -> str:
    """A literal that stands in every hit of the pattern, the longest that is easily told; may be empty."""
    if re.search(r"\(\?[a-zA-Z]", pattern):  # flags, as for letters of either case
        return ""
    gap = "\0"
    left = re.sub(r"\[[^\]]*\]", gap, re.sub(r"\\.", gap, pattern))
    while re.search(r"\([^()]*\)", left):
        left = re.sub(r"\([^()]*\)", gap, left)
    left = re.sub(r"[^{}]\{[^}]*\}|.[?*]|[.^$+]", gap, left)
    return "" if "|" in left else max(left.split(gap), key=len)


def hits(plain_text: Column, patterns: list[str]) -> Column:
    """Hits of each pattern, summed; none in a null. A text without a pattern's literal, which is quickly seen, isn't scanned for it.

    In a lambda, because a plan's scans would else make one generated method, larger than what the JVM compiles.
    """

    def count(t: Column) -> Column:
        total = F.lit(0)
        for p in patterns:
            one, literal = F.coalesce(F.regexp_count(t, F.lit(p)), F.lit(0)), needed(p)
            total = total + (F.when(t.contains(literal), one).otherwise(F.lit(0)) if literal else one)
        return total

    return F.transform(F.array(plain_text), count)[0]


def density(plain_text: Column, n_words: Column, patterns: list[str]) -> Column:
    """Eight hits a word count as one, at most one."""
    return F.least(F.lit(1.0), hits(plain_text, patterns) / F.greatest(n_words, F.lit(1)) * 8)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, or between a sentence's end and a capital letter."""
    mark = "\u0001"
    marked = F.regexp_replace(F.regexp_replace(F.trim(text), r"([.!?])\s+([A-Z])", f"$1{mark}$2"), r"\n{2,}", mark)
    return F.transform(F.split(marked, mark), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))


def chunks(text: Column) -> Column:
    """Chunks as (chunk_id, text): paragraphs of CHUNK_MIN_WORDS or more, cut at CHUNK_MAX_WORDS; else the whole text."""
    own = F.filter(paragraphs(text), lambda p: F.size(words(p)) >= C.CHUNK_MIN_WORDS)
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = F.when(F.size(own) > 0, own).when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))

    def cut(p: Column, i: Column) -> Column:
        w = words(p)
        name = F.concat(F.lit("p"), i.cast("string"))
        n = F.ceil(F.size(w) / C.CHUNK_MAX_WORDS).cast("int")
        many = F.transform(
            F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
            lambda j: F.struct(F.concat(name, F.lit("_"), j.cast("string")).alias("chunk_id"), F.array_join(F.slice(w, j * C.CHUNK_MAX_WORDS + 1, C.CHUNK_MAX_WORDS), " ").alias("text")),
        )
        return F.when(F.size(w) <= C.CHUNK_MAX_WORDS, F.array(F.struct(name.alias("chunk_id"), p.alias("text")))).otherwise(many)

    return F.flatten(F.transform(F.coalesce(parts, F.array().cast("array<string>")), cut))
