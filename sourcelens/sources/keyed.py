"""Tables that are written again and again: one row a key, the last write stays; logs by day. Replaying a batch changes nothing.

Both are Parquet with partitions that a write replaces whole (dynamic partition overwrite), so a job that dies half-way
is run once more, and readers prune to the keys' slots or the days they ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.operators import similarity

#: Partitions of a keyed table: a write reads and replaces those that its keys fall into.
SLOTS = 64


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _replace(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def upsert(rows: DataFrame, path: str, key: str, order: str, batch: int, slots: int = SLOTS) -> None:
    """Put rows into the table at path: of each key the row with the greatest (order, batch) stays; equal ones are one write.

    A null key is a key. Rows of one key, order and batch that differ: the greatest by their text stays, so that a replay decides alike.
    """
    spark = rows.sparkSession
    own = rows.withColumns({"_batch": F.lit(batch).cast("long"), "_slot": _slot(F.col(key), slots)})
    own = similarity.written(own, "upsert")
    if _exists(spark, path):
        touched = [r[0] for r in own.select("_slot").distinct().collect()]  # SLOTS at most
        own = own.unionByName(spark.read.parquet(path).where(F.col("_slot").isin(touched)), allowMissingColumns=True)
    names = [c for c in own.columns if c != "_slot"]
    last = F.row_number().over(W.partitionBy("_slot", key).orderBy(F.desc(order), F.desc("_batch"), F.desc(F.to_json(F.struct(*names)))))
    merged = similarity.written(own.withColumn("_k", last).where("_k = 1").drop("_k"), "merged")
    _replace(merged, path, "_slot")


def keyed(spark: SparkSession, path: str, key: str, values: list | None = None, slots: int = SLOTS) -> DataFrame:
    """The table at path; of values, where given, only the slots of these keys are read."""
    rows = spark.read.parquet(path)
    if values is not None:
        kind = dict(rows.dtypes)[key]
        wanted = spark.createDataFrame([(v,) for v in values], f"k {kind}").select(_slot(F.col("k"), slots)).distinct().collect()
        rows = rows.where(F.col("_slot").isin([r[0] for r in wanted]) & F.col(key).isin(values))
    return rows.drop("_slot", "_batch")


def append_days(records: DataFrame, path: str, batch: int, ts: str = "ts") -> None:
    """Add a batch to the log at path, a folder a day; the same batch again takes its own place. Rows without a time go to no day's folder."""
    _replace(records.withColumns({"day": F.to_date(ts), "batch": F.lit(batch).cast("long")}), path, "day", "batch")


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The log's rows from day first to day last; no other day's files are opened."""
    return spark.read.parquet(path).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
