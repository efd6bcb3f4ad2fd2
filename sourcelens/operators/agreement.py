"""Agreement of two annotators: confusion matrices and the measures made from their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, levels: list[str]) -> DataFrame:
    """field, gold, pred, n for all cells. pairs: field, gold, pred; labels that are no level are dropped."""
    return filled(pairs.groupBy("field", "gold", "pred").agg(F.count(F.lit(1)).alias("n")), levels)


def filled(counts: DataFrame, levels: list[str]) -> DataFrame:
    """field, gold, pred, n for all cells. counts: field, gold, pred, n, each once; labels that are no level are dropped."""
    grid = counts.sparkSession.createDataFrame([(g, p) for g in levels for p in levels], "gold string, pred string")  # levels x levels rows
    cells = counts.where(F.col("gold").isin(levels) & F.col("pred").isin(levels))
    return counts.select("field").distinct().crossJoin(F.broadcast(grid)).join(cells, ["field", "gold", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def measures(cells: DataFrame, levels: list[str]) -> DataFrame:
    """Per field: n, accuracy, macro_f1 (absent classes skipped), kappa (quadratic weights), off_by_one; null where undefined."""
    rank = F.create_map(*(x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(i))))
    rows = cells.select("field", rank[F.col("gold")].alias("g"), rank[F.col("pred")].alias("p"), F.col("n").cast("double").alias("n"))
    total = rows.groupBy("field").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n"))).alias("right"), F.sum(F.when(F.abs(F.col("g") - F.col("p")) == 1, F.col("n"))).alias("near"))
    by_gold = rows.groupBy("field", F.col("g").alias("c")).agg(F.sum("n").alias("as_gold"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0.0)).alias("tp"))
    by_pred = rows.groupBy("field", F.col("p").alias("c")).agg(F.sum("n").alias("as_pred"))
    marginals = by_gold.join(by_pred, ["field", "c"])
    f1 = marginals.where("as_gold + as_pred > 0").groupBy("field").agg(F.avg(2 * F.col("tp") / (F.col("as_gold") + F.col("as_pred"))).alias("macro_f1"))
    weight = F.pow(F.col("g") - F.col("p"), 2) / float(max(1, len(levels) - 1) ** 2)
    seen = rows.groupBy("field").agg(F.sum(weight * F.col("n")).alias("seen"))
    chance = marginals.select("field", F.col("c").alias("g"), "as_gold").join(marginals.select("field", F.col("c").alias("p"), "as_pred"), "field")
    chance = chance.join(total, "field").groupBy("field").agg(F.sum(weight * F.col("as_gold") * F.try_divide(F.col("as_pred"), F.col("total"))).alias("chance"))
    kappa = F.when(F.col("chance") == 0, F.when(F.col("seen") == 0, 1.0)).when(F.col("chance") == F.col("total"), None).otherwise(1 - F.try_divide(F.col("seen"), F.col("chance")))
    out = total.join(f1, "field", "left").join(seen, "field").join(chance, "field")
    return out.select(
        "field", F.col("total").cast("long").alias("n"), F.round(F.try_divide(F.col("right"), F.col("total")), 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"),
        F.round(F.when(F.col("total") > 0, kappa), 9).alias("kappa"), F.round(F.try_divide(F.coalesce("near", F.lit(0.0)), F.col("total")), 9).alias("off_by_one"),
    )
