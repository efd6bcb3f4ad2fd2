"""Persistence of citations as a stream: every query's days are state, and a day that closes meets those before it.

A day is closed when the watermark passes its end; until then its rows may come in any order and any number of times.
Which day counts as the one before is known only over all queries, so a query hands on its pairs of days within the
window, and measured() keeps those that follow each other in the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sourcelens import config as C

DAY_MS = 86_400_000
#: A row without before and domain says that the query was seen that day.
PAIRS = "query long, before date, now date, domain string, hit boolean"
_NAMES = ["query", "before", "now", "domain", "hit"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Days(StatefulProcessor):
    """Domains by day of one query; a day's timer is its end, and days beyond the window are forgotten."""

    def __init__(self, window_days: int):
        self.window_days = window_days

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "domains array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for day, own in batch.groupby("day")["domain"]:
                day = int(day)
                if (day + 1) * DAY_MS <= closed:
                    continue  # too late: its pairs are out
                if self.days.containsKey((day,)):
                    held = set(self.days.getValue((day,))[0])
                else:
                    held = set()
                    self.handle.registerTimer((day + 1) * DAY_MS)
                self.days.updateValue((day,), (sorted(held | set(own.dropna())),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        date = lambda d: pd.Timestamp(d, unit="D").date()
        known = {int(k[0]): list(v[0]) for k, v in self.days.iterator()}
        now = set(known.get(day, ()))
        rows = [(key[0], None, date(day), None, None)]
        for before in sorted(known):
            if before <= day - self.window_days:
                self.days.removeKey((before,))  # no later day can need it
            if day - self.window_days <= before < day:
                rows += [(key[0], date(before), date(day), d, d in now) for d in sorted(known[before])]
        yield pd.DataFrame(rows, columns=_NAMES)


def pairs(log: DataFrame, late: str = "2 days", window_days: int = C.PERSISTENCE_DAYS) -> DataFrame:
    """PAIRS of a streaming log (query, ts, domain). Rows more than `late` behind the newest may be left out."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = log.withWatermark("ts", late).select("query", "ts", "domain", F.unix_date(F.to_date("ts")).alias("day"))
    return own.groupBy("query").transformWithStateInPandas(_Days(window_days), PAIRS, "append", "eventTime")


def write_pairs(log: DataFrame, path: str, checkpoint: str, late: str = "2 days", window_days: int = C.PERSISTENCE_DAYS):
    """Append the pairs of closed days to a Parquet table; started, not awaited. A restart goes on where the checkpoint ends."""
    return pairs(log, late, window_days).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def measured(found: DataFrame, window_days: int = C.PERSISTENCE_DAYS) -> DataFrame:
    """audit.persistence() of the closed days from PAIRS: domain, n, hits, persistence."""
    days = found.where("before is null").select("now").distinct()  # one row a calendar day
    steps = days.select("now", F.lag("now").over(W.orderBy("now")).alias("before")).where(F.datediff("now", "before") <= window_days)
    kept = found.join(F.broadcast(steps), ["before", "now"])
    out = kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    return out.withColumn("persistence", F.round(F.col("hits") / F.col("n"), 9))
