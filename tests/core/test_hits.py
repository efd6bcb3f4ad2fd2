"""Counting of patterns in texts: what is skipped has no hit, and Spark's classes are the SQL's."""

import re

import pytest
from pyspark.sql import functions as F

from sourcelens import config as C
from sourcelens.functions import text as T
from sourcelens.operators import pages, signals


@pytest.mark.parametrize("pattern, literal", [(r"\bexperts?\b", "expert"), (r"\bstud(y|ies)\b", "stud"), (r"\b20\d{2}\b", "20"), (r"a|b", ""), (r"(?i)\bsay\b", ""), (r"x{0,2}yz?", "y"), (r"[ab]+", "")])
def test_needed_literal(pattern, literal):
    assert T.needed(pattern) == literal


def test_hits_are_those_of_every_pattern(spark):
    texts = ["", None, "experts study 2024 studies 50% dr. who", 'He states: "it is the best thing I saw", According to Nature', "may may best #1 x#1 compared to", "get started: buy now, add to cart", "newer besting mayor"]
    for patterns in (C.AUTHORITY, C.COMPARATIVE, C.TEMPORAL, C.PURPOSE, C.HEDGES, C.QUOTES, pages.CALLS_TO_ACTION):
        got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.hits(F.col("t"), patterns).alias("n")).collect()]
        assert got == [sum(len(re.findall(p, t or "")) for p in patterns) for t in texts]


def test_classes_agree(spark):
    chars = spark.range(0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert chars.where(F.col("c").rlike(T.SPACE) != F.col("c").rlike(T.SPLIT)).count() == 0
    assert chars.where(F.col("c").rlike(T.FOREIGN) != F.col("c").rlike(T.LETTER)).count() == 0
    assert chars.where(F.col("c").rlike(T.SPLIT)).count() == 29 and chars.where(F.col("c").rlike(T.LETTER)).count() > 40_000


def test_scans_stay_out_of_the_generated_method(spark):
    plan = signals.content_signals(spark.createDataFrame([("x",)], "text string"))
    made = plan._jdf.queryExecution().debug().codegenToSeq()
    sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    assert sizes and max(sizes) < 8000  # bytes beyond which the JVM interprets a method
