"""Rows that share an id pack like any others."""

import numpy as np
from pyspark.sql import functions as F

from sourcelens.llm import packing


def test_many_rows_without_an_id(spark):
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b c d e f "), F.col("id").cast("string")).alias("text"))
    got = packing.pack_documents(docs, capacity=16, group=2_000).select("sequence_id", "offset", "length").collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) >= 30_000
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 16


def test_search_visits_bins_past_many_that_resist():
    lengths = np.array([59] * 200 + [71] * 3 + [30] * 3)  # nothing empties the bins of 59; the one of three 30s can go
    bins = packing.improve([*([k] for k in range(203)), [203, 204, 205]], lengths, 101)
    assert sorted(i for b in bins for i in b) == list(range(206)) and len(bins) == 203
