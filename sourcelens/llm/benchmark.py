"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only (operator 9).

Texts become lower-case words of letters and digits, and shingles of five words (a shorter item is one shingle of all
its words). Items are partitioned by size: class k holds items of 2**k to 2**(k+1)-1 distinct shingles. A class has one
sketch length, sized for its largest items: the s least shingle hashes of an item, where s - 1 is the most shingles an
item of that class can miss and still reach the containment. So a document that contains an item enough has one of its
sketch hashes, however long the document is, and the search misses nothing.

1. Documents' shingle hashes, and nothing else of them, meet the sketches: a fifth of the items' shingles. What hits
   is a candidate pair, written to the shared folder.
2. Only candidates' documents make their shingles as words, and a pair stays if it shares enough of the item's: exact
   containment, joined by document and shingle, so no document or passage gathers in one task.

Null, empty and wordless texts match nothing. A text of any length is read whole. Rows that repeat a doc_id, or have
none, are one document; items that repeat an item_id are one item. Empty tables give no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sourcelens.llm import common

WORDS, CONTAINMENT = 5, 0.8
#: The items' sketches are broadcast up to so many hashes (some 40 bytes each), their shingles up to as many (some 100 bytes each); beyond, joins shuffle.
BROADCAST_HASHES = 500_000
_GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; none: an empty array."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), _GAP), ""), F.array().cast("array<string>"))


def _shingles(n: int) -> Column:
    """Hashes of all runs of n words, from the words' hashes in column wh."""
    last = F.size("wh") - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(n), *(F.get(F.col("wh"), i + k) for k in range(n))))


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, words(F.col("text")).alias("w")).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))


def item_index(items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """Distinct shingles of the items: item_id, width, h, shingle, n_shingles, in_sketch."""
    base = _hashed(items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")), "item_id").where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(n))
    by_width = F.coalesce(*(F.when(width == k, _shingles(k)) for k in range(1, n + 1)))
    rows = base.withColumn("width", width).select("item_id", "width", "w", F.posexplode(by_width).alias("pos", "h"))
    rows = rows.select("item_id", "width", "h", F.array_join(F.slice("w", F.col("pos") + 1, F.col("width")), " ").alias("shingle")).distinct()
    of_item = W.partitionBy("item_id")
    rows = rows.withColumn("n_shingles", F.count(F.lit(1)).over(of_item)).withColumn("rank", F.row_number().over(of_item.orderBy("h", "shingle")))
    top = F.pow(F.lit(2), F.floor(F.log2("n_shingles")) + 1) - 1  # the largest size of the item's class
    sketch = top - F.ceil(top * containment) + 1
    return rows.select("item_id", "width", "h", "shingle", "n_shingles", (F.col("rank") <= sketch).alias("in_sketch"))


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_HASHES else rows.hint("merge")  # else Spark may broadcast the documents' hashes, which it takes for one a document


def candidates(docs: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, item_id of documents with a hash of an item's sketch; docs has doc_id (never null) and text."""
    sketch = index.where("in_sketch").select("item_id", "width", "h")
    total, widths = sketch.agg(F.count(F.lit(1)), F.collect_set("width")).first()  # at most WORDS widths

    def placed(k: int) -> Column:
        return F.transform(_shingles(k), lambda h: F.struct(h.alias("h"), F.lit(k).alias("width")))

    made = [placed(k) for k in sorted(widths or [WORDS])]
    hashes = _hashed(docs, "doc_id").select("doc_id", F.explode(F.concat(*made) if len(made) > 1 else made[0]).alias("s"))
    return hashes.select("doc_id", "s.h", "s.width").join(_few(sketch, total), ["h", "width"]).select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs of document and item: doc_id, item_id, n_shared, n_shingles, containment."""
    index, own = common.cut(item_index(items, n, containment), "items"), common.keyed(docs)
    found = common.cut(candidates(own, index), "candidates")
    total, widths = index.agg(F.count(F.lit(1)), F.collect_set("width")).first()

    def placed(k: int) -> Column:
        return F.transform(_shingles(k), lambda h, i: F.struct(F.lit(k).alias("width"), h.alias("h"), F.array_join(F.slice("w", i + 1, F.lit(k)), " ").alias("shingle")))

    made = [placed(k) for k in sorted(widths or [n])]
    some = _hashed(own.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    shingles = some.select("doc_id", F.explode(F.concat(*made) if len(made) > 1 else made[0]).alias("s")).select("doc_id", "s.*").distinct()
    wanted = found.join(_few(index, total), "item_id").select("doc_id", "item_id", "width", "h", "shingle", "n_shingles")
    pairs = wanted.join(shingles.hint("merge"), ["doc_id", "width", "h", "shingle"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.first("n_shingles").alias("n_shingles"))
    out = pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * containment))
    return common.unkeyed(out)


def clean_of(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that contain an item. Each row is judged by its own text: rows of equal text fare alike, whatever their doc_id.

    A first search names texts by a 64-bit hash, so texts of one name count as one and none is missed. What it finds is
    searched once more, each text, told from others by 128 bits, under a number of its own.
    """
    text = docs["text"].cast("string")
    name, second = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    found = contained_items(docs.select(name.alias("doc_id"), text.alias("text")), items, **options).select(F.col("doc_id").alias("_found")).distinct()
    doubtful = docs.select(name.alias("_a"), second.alias("_b"), text.alias("text")).join(found, F.col("_a") == F.col("_found"), "left_semi")
    doubtful = common.cut(doubtful.groupBy("_a", "_b").agg(F.first("text").alias("text")).withColumn("doc_id", F.monotonically_increasing_id()), "doubtful")
    sure = contained_items(doubtful, items, **options).select(F.col("doc_id").alias("_sure")).distinct()
    gone = doubtful.join(sure, doubtful["doc_id"] == sure["_sure"], "left_semi").select("_a", "_b")
    return docs.join(gone, (name == gone["_a"]) & (second == gone["_b"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
widths AS (SELECT DISTINCT k FROM items),
shingles AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, widths WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM shingles JOIN items USING (k, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM hits JOIN sizes USING (item_id) WHERE n_shared >= ceil(n_shingles * 0.8)
"""
