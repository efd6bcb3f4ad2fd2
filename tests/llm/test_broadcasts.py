"""Sides of joins that Spark takes for smaller than they are aren't broadcast."""

import pytest
from helpers import documents
from pyspark.sql import functions as F

from sourcelens.llm import benchmark, common, simhash


def broadcast(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dealt", [common.dealt, common.dealt_once])
def test_exploded_rows_meet_their_groups_by_merge(spark, dealt):
    rows = spark.range(40).select(F.explode(F.sequence(F.lit(0), F.lit(30))).alias("mask"), F.col("id").alias("fp"))
    cells = dealt(rows, ["mask"], "fp", 100)
    assert not broadcast(cells) and cells.count() == (31 * 40 if dealt is common.dealt else 40)


def test_components_of_many_edges_are_merged(spark, monkeypatch):
    prints = spark.createDataFrame([(k, 1 << k % 9) for k in range(30)], "doc_id long, fp long")
    assert broadcast(simhash.near_components(prints))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5, raising=False)
    groups = simhash.near_components(prints)
    assert not broadcast(groups) and {r.component_id for r in groups.collect()} == {0}


def test_documents_meet_a_long_index_by_merge(spark, monkeypatch):
    docs, items = common.cut(documents(spark, [(1, "a b c d e f")]), "documents"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    monkeypatch.setattr(benchmark, "BROADCAST_HASHES", 0)
    found = benchmark.candidates(common.keyed(docs), benchmark.item_index(items))
    assert not broadcast(found) and [tuple(r) for r in found.collect()] == [(1, 1)]


def test_documents_meet_the_items_they_may_hold_by_merge(spark):
    docs, items = common.cut(documents(spark, [(1, "a b c d e f"), (2, "g h")]), "documents"), common.cut(spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"), "items")
    found = benchmark.contained_items(docs, items)
    assert "SortMergeJoin [doc_id" in found._jdf.queryExecution().executedPlan().toString() and [r.doc_id for r in found.collect()] == [1]
