"""Lists of hosts as tables: a host meets a list's entry if it is the entry or ends with it after a dot.

Every host is exploded into its suffixes, one a label, and these meet the list by an equi-join, so lists may be of any
size and change without a new plan. Hosts are few against the rows that have them and are exploded once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a list that are broadcast at most (some 60 bytes each); beyond, the join shuffles.
BROADCAST_ENTRIES = 500_000


def bare(host: Column) -> Column:
    """A host in lower case, without port, www. and dots at its ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r":\d*$", ""), r"^www\.|^\.+|\.+$", "")


def suffixes(host: Column) -> Column:
    """All ends of a host that begin at a label, the longest first, each with its number of labels."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(parts, i, n), ".").alias("suffix"), (n - i + 1).alias("labels")))


def meets(rows: DataFrame, host: str, listed: DataFrame, name: str = "entry") -> DataFrame:
    """rows with the longest entry of the list (entry) that each host meets, or null, in a new column."""
    entries = listed.select(bare(F.col("entry")).alias("_entry")).where("_entry <> ''").distinct()
    entries = F.broadcast(entries) if entries.count() <= BROADCAST_ENTRIES else entries
    own = rows.select(bare(F.col(host)).alias("_host")).distinct()
    met = own.select("_host", F.explode(suffixes(F.col("_host"))).alias("s")).join(entries, F.col("s.suffix") == F.col("_entry"))
    best = met.groupBy("_host").agg(F.max_by("_entry", "s.labels").alias(name))
    return rows.withColumn("_own", bare(F.col(host))).join(best, F.col("_own") == F.col("_host"), "left").drop("_own", "_host")


def registrable(rows: DataFrame, host: str, public: DataFrame, name: str = "domain") -> DataFrame:
    """rows with each host's registrable domain: one label more than the longest public suffix (entry) it ends with; without one, its last two labels."""
    met = meets(rows, host, public, "_public")
    parts = F.split(bare(F.col(host)), r"\.")
    n = F.size(parts)
    take = F.least(n, F.when(F.col("_public").isNull(), F.lit(2)).otherwise(F.size(F.split("_public", r"\.")) + 1))
    return met.withColumn(name, F.array_join(F.slice(parts, n - take + 1, take), ".")).drop("_public")


def counted(profiles: DataFrame, strong: DataFrame) -> DataFrame:
    """Per node with profiles elsewhere: node_id, n_hosts, n_distinct, n_strong. profiles: node_id, url. strong: entry."""
    host = F.lower(F.regexp_extract("url", r"(?i)^https?://([^/]+)", 1))
    own = profiles.select("node_id", bare(host).alias("host")).where("host <> ''")
    return meets(own, "host", strong).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_hosts"), F.count_distinct("host").alias("n_distinct"), F.count("entry").alias("n_strong"))
