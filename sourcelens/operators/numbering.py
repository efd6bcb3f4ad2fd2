"""Running numbers over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourcelens.operators import similarity

_BITS = 33


def numbered(rows: DataFrame, name: str, *keys: Column | str) -> DataFrame:
    """rows with their place, from 1, in order of keys (which no two rows should share).

    Rows are dealt by ranges of the keys and sorted in each task; how many rows lie before a task's is a sum over tasks,
    one row each.
    """
    ranged = similarity.written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", _BITS)
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before)
    own = ranged.withColumn("_part", part).join(F.broadcast(sizes.select("_part", "_before")), "_part")
    return own.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1).drop("_part", "_at", "_before")
