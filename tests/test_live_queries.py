"""Live query registry: impact test, shared evaluation, unchanged results, diffs, guard."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import log as folds
from factloom.operators import writes
from factloom.streaming.live_queries import LiveQueries, LiveQuery, ResultTooLarge

SCHEMA = "lsn long, kind string, tbl string, key string, value double"


def test_refresh_sends_only_changes(spark):
    u, d = folds.UPSERT, folds.DELETE
    log = spark.createDataFrame([(1, u, "t", "a", 5.0), (2, u, "t", "b", 9.0), (3, u, "t", "c", 1.0), (4, d, "t", "b", None), (5, u, "t", "x", 2.0), (6, u, "t", "d", 8.0)], SCHEMA)
    page = lambda at: folds.fold_records(folds.as_of(log, at)).filter("value >= 4").select("key", "lsn", F.col("value").cast("string").alias("value"))
    make = lambda: LiveQuery("plan", "t", page, F.col("value") >= 4)
    live = LiveQueries()
    first = live.subscribe("q1", make(), 2)
    live.subscribe("q2", make(), 2)
    assert live.evaluations == 1 and {r.key for r in first.collect()} == {"a", "b"}
    assert live.subscribe("q3", make(), 2, resume=live.queries["q1"].result_id) is None
    batch = lambda lo, hi: log.filter(F.col("lsn").between(lo, hi))
    assert live.affected(batch(3, 3)) == [] and live.refresh(batch(3, 3), 3) == {}
    got = live.refresh(batch(3, 4), 4)
    assert set(got) == {"q1", "q2", "q3"} and [tuple(r) for r in got["q1"].collect()] == [("b", "removed", True, 4)]
    assert live.evaluations == 2
    assert live.refresh(batch(5, 5), 5) == {}
    assert [tuple(r) for r in live.refresh(batch(5, 6), 6)["q2"].collect()] == [("d", "added", False, 6)]
    with pytest.raises(ResultTooLarge):
        LiveQueries(most_rows=1).subscribe("q", make(), 2)


def test_seals_and_levels(spark):
    log = spark.createDataFrame([(1, "a", None), (2, "b", None)], "lsn long, key string, checksum string")
    done = writes.seal(log, ["lsn", "key"])
    assert writes.broken_seals(done, ["lsn", "key"]).count() == 0
    assert [r.lsn for r in writes.broken_seals(done.withColumn("key", F.lit("a")), ["lsn", "key"]).collect()] == [2]
    assert writes.read_at(log, 2).count() == 2
    with pytest.raises(TimeoutError):
        writes.read_at(log, 3)


def test_deep_search(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": "obj-1"}]}'), (2, '{"obj-1": "x"}'), (3, '{"a": "obj-10"}'), (4, '["obj-1"]')], "i int, j string")
    assert [r.i for r in df.filter(writes.deep_search(F.col("j"), "obj-1")).orderBy("i").collect()] == [1, 4]
