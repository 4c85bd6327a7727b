"""Streams agree with the batch operators over the same facts."""

import pandas as pd

from factloom.operators import log as folds
from factloom.sources import logs, store
from factloom.streaming import live_tables as st

SCHEMA = "lsn long, kind string, tbl string, key string, value double"


def facts(spark, n=300):
    return spark.createDataFrame([(i, folds.DELETE if i % 4 == 0 else folds.UPSERT, "t", f"k{i * 7 % 23}", float(i)) for i in range(n)], SCHEMA)


def test_fold_stream(spark, tmp_path):
    log = facts(spark)
    log.repartitionByRange(4, "lsn").write.parquet(f"{tmp_path}/log")
    numbers = []
    fold = store.fold_runs(f"{tmp_path}/state")
    st.run_available(st.read_log_stream(spark, f"{tmp_path}/log", log.schema), lambda b, n: (fold(b, n), numbers.append(n)), f"{tmp_path}/c")
    got = store.folded_runs(spark, f"{tmp_path}/state", numbers[-1] + 1)
    assert numbers == list(range(4)) and store.runs_after(7) == [(0, 4), (4, 2), (6, 1)]
    assert sorted(map(tuple, got.select("key", "value").collect())) == sorted(map(tuple, folds.fold_records(log).select("key", "value").collect()))


def test_live_counts(spark, tmp_path):
    log = facts(spark)
    log.repartitionByRange(1, "lsn").write.parquet(f"{tmp_path}/log")
    st.run_available(st.live_counts(st.read_log_stream(spark, f"{tmp_path}/log", log.schema)), lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/d/{n}"), f"{tmp_path}/c", "update")
    total = sum(r.delta for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/d").collect())
    assert total == folds.fold_records(log).count()


def test_channel_state(spark, tmp_path):
    rows = [(c, i, None if i % 2 else 0, str(i)) for c in ("x", "y") for i in range(6)]
    log = spark.createDataFrame(rows, "channel string, lsn long, expected long, value string")
    batch = sorted(map(tuple, st.channel_cas(log).collect()))
    done, version, value = st.compare_and_set(pd.DataFrame(rows[:6], columns=["channel", "lsn", "expected", "value"]))
    assert [x[1:] for x in done] == [(True, 1), (True, 2), (False, 2), (True, 3), (False, 3), (True, 4)] and (version, value) == (4, "5")
    assert [x[1:] for x in batch[:6]] == done
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    out = []
    st.run_available(st.channel_cas_stream(st.read_log_stream(spark, f"{tmp_path}/log", log.schema)), lambda b, n: out.extend(map(tuple, b.collect())), f"{tmp_path}/c", "update")
    assert sorted(out) == batch


def test_catch_up_counts_each_fact_once(spark):
    log = facts(spark, 50)
    got = st.catch_up(log.filter("lsn < 40"), log.filter("lsn >= 30"), 10)
    assert sorted(r.lsn for r in got.collect()) == list(range(11, 50))


def test_recoverable_and_bundles(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"lsn": 1, "key": "a"}\n{"lsn": 2, "key": "b"}\n{"lsn": 3, "ke\n{"lsn": 4, "key": "d"}\n')
    intact, bad = logs.read_recoverable(spark, str(tmp_path / "log"))
    assert sorted(r.lsn for r in intact.collect()) == [1, 2] and bad.count() == 2
    log = facts(spark, 20).selectExpr("*", "lsn % 4 as shard", "lsn as ts_ms", "'m' as mutation_id")
    made = logs.export_bundle(log, f"{tmp_path}/b", 9)
    assert made["records"] == 10 and logs.verify_bundle(spark, f"{tmp_path}/b") == []
    assert logs.import_preflight(spark, f"{tmp_path}/b", 9, 4) == [] and len(logs.import_preflight(spark, f"{tmp_path}/b", 8, 2)) == 2
