"""The citation log as a stream: the same daily shares as over the table, with late rows handled by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, folder: str, schema: str = "event_id long, query long, ts timestamp, domain string") -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def daily_counts(log: DataFrame, late: str = "7 days") -> DataFrame:
    """day, domain, n: citations by day. Rows later than `late` behind the newest are dropped; a repeated event_id counts once.

    Works on a stream and, where the watermark means nothing, on a table.
    """
    once = log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if log.isStreaming else log.dropDuplicates(["event_id"])
    return once.groupBy(F.window("ts", "1 day").alias("w"), "domain").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "domain", "n")


def write_counts(log: DataFrame, path: str, checkpoint: str):
    """Append closed days to a Parquet table; started, not awaited."""
    return daily_counts(log).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
