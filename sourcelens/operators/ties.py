"""Which pages tie themselves to which targets: all markers of all targets are looked for in one pass over the texts.

Markers are a table. Those that differ make an Aho-Corasick automaton of bounded size, which every task runs over its
pages in an Arrow step; where they are more than fit, shards of them take a pass each. What is found, (page, needle),
meets the targets' rules by an equi-join, so no page is held against every target.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.functions import urls as U
from sourcelens.operators import similarity

#: Characters of an automaton's needles: some hundred bytes each in a task's memory.
SHARD_CHARS = 2_000_000


def rules(targets: DataFrame) -> DataFrame:
    """target_id, place, kind, confidence, marker, needle, other: the ties of each target in order; both needles must stand in a page.

    targets: target_id, url, entity, org, aliases. First the address, then its domain and path apart, then host and path
    together, then names from the most to the least distinctive.
    """
    domain, own = U.registrable_domain(U.authority(F.col("url"))), F.regexp_replace(F.lower(U.path(F.col("url"))), r"^/+|/+$", "")
    link, host_path = F.lower(F.regexp_replace("url", r"/+$", "")), F.lower(F.concat(U.authority(F.col("url")), U.path(F.col("url"))))
    tie = lambda place, kind, sure, marker, needle, other: F.struct(place.alias("place"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), marker.alias("marker"), needle.alias("needle"), other.alias("other"))
    names = F.transform(U.markers(F.col("url"), F.col("entity"), F.col("org"), F.col("aliases")), lambda m, i: tie(i + 3, "brand_mention", "weak", m, m, m))
    paths = F.when(own != "", F.array(tie(F.lit(1), "url_link", "high", F.concat(domain, F.lit("/"), own), domain, own))).otherwise(F.array().cast(f"array<{_TIE}>"))
    ties = F.concat(F.array(tie(F.lit(0), "url_link", "high", link, link, link)), paths, F.array(tie(F.lit(2), "url_link", "high", host_path, host_path, host_path)), names)
    return targets.select("target_id", F.explode(ties).alias("t")).select("target_id", "t.*").where((F.col("needle") != "") & (F.col("other") != ""))


_TIE = "struct<place:int,kind:string,confidence:string,marker:string,needle:string,other:string>"


def _sought(needles):
    """needles: a broadcast list of (number, needle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, needle in needles.value:
            automaton.add_word(needle, number)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column("low").to_pylist()):
                own = {n for _, n in automaton.iter(text or "")}
                at += [k] * len(own)
                found += sorted(own)
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], ["page_id", "number"])

    return run


def occurrences(spark: SparkSession, pages: DataFrame, needles: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """page_id, needle: which of the needles (needle, none empty) stand in each page's text (page_id long, low: lower-case text), each once.

    The driver holds one shard of needles at a time, and no page: shards are ranges of numbers over a running sum of lengths.
    """
    own = needles.select("needle").distinct()
    sized = own.select("needle", F.length("needle").cast("long").alias("n"), F.pmod(F.xxhash64("needle"), F.lit(1024)).alias("part"))
    sums = sized.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # 1,024 rows at most
    shards, held = [[]], 0
    for part, n in sums:
        if held and held + n > shard_chars:
            shards.append([])
            held = 0
        shards[-1].append(part)
        held += n
    numbered = similarity.written(sized.withColumn("number", F.monotonically_increasing_id()), "needles")
    out = None
    for shard in shards if sums else []:
        rows = [(r.number, r.needle) for r in numbered.where(F.col("part").isin(shard)).toLocalIterator()]
        sent = spark.sparkContext.broadcast(rows)
        found = similarity.written(pages.select("page_id", "low").mapInArrow(_sought(sent), "page_id long, number long"), "found")
        sent.unpersist()
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "page_id long, needle string")
    return out.join(numbered.select("number", "needle"), "number").select("page_id", "needle")


def ties(spark: SparkSession, pages: DataFrame, targets: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """page_id, target_id, kind, confidence, marker: of each page and target that are tied the first tie in order.

    pages: page_id (long), blob (text and markup). targets: as rules() takes them.
    """
    wanted = similarity.written(rules(targets), "ties")
    needles = wanted.select("needle").union(wanted.select(F.col("other").alias("needle")))
    own = pages.select("page_id", F.lower(F.coalesce("blob", F.lit(""))).alias("low"))
    found = similarity.written(occurrences(spark, own, needles, shard_chars), "occurrences")
    hits = wanted.join(found, "needle")
    both = hits.where("needle = other").select("page_id", "target_id", "place", "kind", "confidence", "marker").unionByName(
        hits.where("needle <> other").join(found.withColumnsRenamed({"page_id": "_p", "needle": "_n"}), (F.col("page_id") == F.col("_p")) & (F.col("other") == F.col("_n"))).select("page_id", "target_id", "place", "kind", "confidence", "marker")
    )
    first = both.groupBy("page_id", "target_id").agg(F.min_by(F.struct("kind", "confidence", "marker"), "place").alias("t"))
    return first.select("page_id", "target_id", "t.*")


def promoters(edges: DataFrame, k: int) -> DataFrame:
    """Of tied pages the k of each target that are tied best: strong ties first, then by page. edges: as ties() gives them."""
    order = W.partitionBy("target_id").orderBy(F.col("confidence") != "high", "page_id")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
