"""Comparisons of a sheet read it once."""

from sourcelens.operators import labels


def test_measures_read_cells_only(spark):
    side = "element_at(array('allow', 'deny', null), cast(id % 3 + 1 as int))"
    rows = spark.range(60).selectExpr("id", "'mention_permission' field", f"{side} adjudicated", f"{side} human", "'allow' llm", "'deny' anti", "'x' parasitic_source")
    out = labels.comparisons(rows)
    assert "Range (" not in out._jdf.queryExecution().toString()
    got = {r.comparison: (r.n, r.accuracy) for r in out.collect()}
    assert (got["human_vs_llm"], got["anti_vs_adjudicated"]) == ((40, 0.5), (40, 0.5))
