"""Concealment splits each text into words once, and hands on how many they are."""

from sourcelens.operators import pages


def test_words_are_counted_once(spark):
    rows = pages._with_rhetoric(spark.createDataFrame([("plain words only",), ("",)], "_open string"), "_open")
    assert rows.columns == ["_open", "_n_open", "_r_open"]
    assert [(r._n_open, r._r_open) for r in rows.collect()] == [(3, []), (0, [])]
