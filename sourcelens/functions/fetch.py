"""What the outcome of a fetch says: walls of bots, faults worth another try, useless snapshots, paywalls, broken links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T
from sourcelens.functions import urls as U


def holds(text: Column, snippets: list[str]) -> Column:
    found = F.lit(False)
    for s in snippets:
        found = found | text.contains(s)
    return found


def is_challenge_path(url: Column) -> Column:
    return F.lower(U.path(F.coalesce(url, F.lit("")))).contains("/bot/challenge")


def is_wall(status: Column, text: Column, final_url: Column, title: Column) -> Column:
    """A block or a script gate in place of content."""
    blob = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    return F.coalesce(status.isin(C.BLOCKED_STATUS), F.lit(False)) | is_challenge_path(final_url) | holds(blob, C.WALL_SNIPPETS) | (T.word_count(text) < C.USEFUL_WORDS)


def is_ok(status: Column, text: Column, final_url: Column, title: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False)) & ~is_wall(status, text, final_url, title)


def is_transient(error: Column) -> Column:
    return holds(F.lower(F.coalesce(error, F.lit(""))), C.TRANSIENT_ERRORS)


def is_challenge(html: Column, title: Column, final_url: Column) -> Column:
    head = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(html, F.lit("")), 1, 6000))
    return is_challenge_path(final_url) | holds(F.lower(head), C.CHALLENGE_SNIPPETS)


def is_blocked_still(status: Column, text: Column, final_url: Column, title: Column) -> Column:
    """After all fetching there is no content."""
    return is_wall(status, text, final_url, title) | ~is_ok(status, text, final_url, title) | is_challenge(text, title, final_url)


def is_junk_snapshot(text: Column, title: Column) -> Column:
    blob = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    return holds(blob, C.SNAPSHOT_JUNK) | (T.word_count(text) < C.USEFUL_WORDS)


def is_paywalled(html: Column, text: Column) -> Column:
    blob = F.lower(F.concat(F.coalesce(html, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return holds(blob, C.PAYWALL_SNIPPETS) | F.replace(blob, F.lit(" "), F.lit("")).contains('"isaccessibleforfree":false') | holds(blob, C.PAYWALL_TOKENS)


def broken_link_ratio(links: DataFrame, status: DataFrame, most: int = C.LINKS_CHECKED) -> DataFrame:
    """url, broken_link_ratio over a page's first few distinct links to its own host. links: url, position, target.
    status: target, status_code (null or absent: an error)."""
    own = links.where(F.lower(U.authority(F.col("url"))) == F.lower(U.authority(F.col("target"))))
    own = own.withColumn("target", F.substring_index("target", "#", 1)).groupBy("url", "target").agg(F.min("position").alias("position"))
    few = own.withColumn("k", F.row_number().over(W.partitionBy("url").orderBy("position"))).where(F.col("k") <= most)
    known = few.join(status.dropDuplicates(["target"]), "target", "left")
    bad = F.coalesce(F.col("status_code") >= 400, F.lit(True))
    found = known.groupBy("url").agg(F.avg(bad.cast("int")).alias("ratio"))
    pages = links.select("url").distinct()
    return pages.join(found, "url", "left").select("url", F.coalesce("ratio", F.lit(0.0)).alias("broken_link_ratio"))
