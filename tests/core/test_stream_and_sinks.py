"""The persistence stream against the table, with late rows and a restart; keyed tables and logs under replays."""

import random
import re

from pyspark.sql import functions as F

from sourcelens.operators import audit
from sourcelens.sources import keyed
from sourcelens.streaming import citations, persistence


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_persistence_of_a_stream_with_late_rows_and_a_restart(spark, tmp_path):
    r = random.Random(7)
    days = [1, 2, 3, 5, 6, 15, 16, 17, 24]  # a gap of more than a week, and one of a week
    rows = [(k, r.randrange(6), f"2024-03-{r.choice(days):02d}T{r.randrange(24):02d}:30:00", r.choice("abcd")) for k in range(260)]
    rows.sort(key=lambda x: x[2])
    halves = [rows[:120] + rows[118:121], rows[120:] + [(999, 0, "2024-04-20T00:00:00", "z")]]
    for half in halves:  # out of order within a file, repeats; within the lateness between files
        r.shuffle(half)
    schema = "event_id long, query long, ts string, domain string"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k, half in enumerate(halves):
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        persistence.write_pairs(citations.read_log(spark, str(tmp_path / "log")), out, state).awaitTermination(300)
    late = [(2000, 1, "2024-03-02T10:00:00", "late")]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    persistence.write_pairs(citations.read_log(spark, str(tmp_path / "log")), out, state).awaitTermination(300)
    found = spark.read.parquet(out)
    table = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    want = {tuple(x) for x in audit.persistence(table).collect()}
    assert {tuple(x) for x in persistence.measured(found).collect()} == want and len(want) == 4
    assert found.count() == found.distinct().count()


def test_upserts_keep_the_last_write(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda rows: spark.createDataFrame(rows, "k string, at int, v string")
    read = lambda: sorted((tuple(x) for x in keyed.keyed(spark, path, "k").collect()), key=repr)
    first, second = frame([("a", 1, "one"), ("b", 1, "one"), ("b", 1, "one"), (None, 1, "none")]), frame([("a", 2, "two"), ("c", 2, "two"), ("b", 0, "old"), ("d", 2, None)])
    keyed.upsert(first, path, "k", "at", 1, slots=4)
    keyed.upsert(second, path, "k", "at", 2, slots=4)
    want = read()
    assert want == sorted([("a", 2, "two"), ("b", 1, "one"), ("c", 2, "two"), ("d", 2, None), (None, 1, "none")], key=repr)
    for batch, rows in ((2, second), (1, first), (2, second)):
        keyed.upsert(rows, path, "k", "at", batch, slots=4)
        assert read() == want
    keyed.upsert(frame([("a", 2, "three")]), path, "k", "at", 3, slots=4)  # of equal times the later batch
    some = keyed.keyed(spark, path, "k", ["a"], slots=4)
    assert [tuple(x) for x in some.collect()] == [("a", 2, "three")]
    assert re.search(r"PartitionFilters: \[[^\n]*_slot", plan_of(some))


def test_logs_by_day(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'a' AS q UNION ALL SELECT timestamp'2024-01-02 10:00:00', 'b' UNION ALL SELECT timestamp'2024-01-02 10:00:00', 'b'")
    two = spark.sql("SELECT timestamp'2024-01-02 11:00:00' AS ts, 'c' AS q UNION ALL SELECT timestamp'2024-01-09 10:00:00', 'd'")
    keyed.append_days(one, path, 1)
    keyed.append_days(two, path, 2)
    keyed.append_days(one, path, 1)
    got = keyed.read_days(spark, path, "2024-01-02", "2024-01-03")
    assert sorted(x.q for x in got.collect()) == ["b", "b", "c"]
    assert re.search(r"PartitionFilters: \[[^\n]*day", plan_of(got)) and len(got.inputFiles()) >= 2
