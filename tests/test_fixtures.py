"""Small hand-written cases for the semantics that the large tables cannot reach."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import paging
from factloom.functions.hashing import shard_index
from factloom.functions.predicates import PredicateError, compile_predicate, parse_index_value, parse_predicate
from factloom.operators import aggregates as agg
from factloom.operators import behaviors as be
from factloom.operators import constraints as co
from factloom.operators import live
from factloom.operators import log as folds
from factloom.operators import objects as ob
from factloom.operators import records as rec
from factloom.operators.scopes import split_scopes
from factloom.plans import schema as sc


@pytest.fixture(scope="module")
def rooms(spark):
    rows = [("a", "Shared", "open", 12, ["urgent", "edge"]), ("b", "Shared", "closed", 15, ["urgent"]), ("c", "Unique", "open", 7, ["urgent"]), ("d", "Shared", "open", 20, ["later"]), ("e", "Other", "open", 30, ["urgent"])]
    return spark.createDataFrame([(f"predicate-{k}", *x) for k, *x in rows], "key string, title string, status string, score long, tags array<string>")


def keys(df):
    return [r.key[-1] for r in df.orderBy("key").collect()]


def terms(*t):
    return {"all": [dict(zip(("path", "op", "value"), x)) for x in t]}


def test_predicate_pages(rooms):
    p = terms(("status", "eq", "open"), ("score", "gte", 10), ("tags", "contains", "urgent"))
    got = rec.list_records(rooms, {"predicate": p, "limit": 2})
    assert keys(got) == ["a", "e"] and not got.first().has_more
    got = rec.index_records(rooms, {"fields": ["title"], "values": ["Shared"], "predicate": terms(("status", "eq", "open"), ("score", "gt", 10))})
    assert keys(got) == ["a", "d"]
    page = rec.index_range(rooms, ["score"], [10], [30], limit=2)
    assert [r.score for r in page.collect()] == [12, 15] and page.first().has_more
    page = rec.index_range(rooms, ["score"], [10], [30], cursor=[15, "predicate-b"], limit=2)
    assert keys(page) == ["d", "e"] and not page.first().has_more
    page = rec.index_records(rooms, {"fields": ["score"], "lower": [10], "upper": [30], "predicate": terms(("status", "eq", "open")), "limit": 2})
    assert keys(page) == ["a", "d"] and page.first().has_more


def test_typed_predicates_reach_the_scan(spark, rooms, tmp_path):
    rooms.write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    plan = rec.list_records(df, {"predicate": terms(("status", "eq", "open")), "after_key": "predicate-a"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,open)" in plan and "GreaterThan(key,predicate-a)" in plan and "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("term, want", [(("n", "eq", 1), "int"), (("n", "eq", 1.0), "float"), (("n", "eq", "1"), "string"), (("n", "ne", 1), "bool float null string"), (("n", "gte", 1), "float int"), (("n", "exists", True), "bool float int null string"), (("n", "exists", False), "missing"), (("n", "eq", None), "null"), (("n", "eq", True), "bool"), (("n", "startsWith", "1"), "string")])
def test_json_is_type_strict(spark, term, want):
    rows = {"int": '{"n": 1}', "float": '{"n": 1.0}', "string": '{"n": "1"}', "null": '{"n": null}', "missing": "{}", "bool": '{"n": true}'}
    df = spark.createDataFrame(list(rows.items()), "name string, j string").select("name", F.parse_json("j").alias("v"))
    path, op, value = term
    got = df.filter(compile_predicate(df, terms((f"v.{path}", op, value))))
    assert sorted(r.name for r in got.collect()) == want.split()


def test_json_arrays_and_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}}'), (2, '{"a": [{"b": 1}]}'), (3, '{"a": {"b": "xyz"}}')], "i int, j string").select("i", F.parse_json("j").alias("v"))
    find = lambda *t: [r.i for r in df.filter(compile_predicate(df, terms(t))).orderBy("i").collect()]
    assert find("v.a.b", "contains", "x") == [1, 3]
    assert find("v.a.b", "contains", 1) == [1]
    assert find("v.a.b", "exists", True) == [1, 3]  # paths never go through arrays


def test_predicate_limits():
    assert parse_predicate(" ") == [] and parse_predicate('{"all": []}') == []
    for bad in (terms(("a..b", "eq", 1)), terms(("a", "like", 1)), {"all": [{"path": "a", "op": "eq"}] * 33}, {"any": []}):
        with pytest.raises(PredicateError):
            parse_predicate(bad)
    assert [parse_index_value(x) for x in ("5", "General", '"5"', "true", "[1]")] == [5, "General", "5", True, "[1]"]


def test_limits_and_cursors():
    assert [paging.normalize_limit(x) for x in (None, 0, 7, 501)] == [50, 1, 7, 500]
    assert paging.decode_cursor(paging.encode_cursor([1, "a", None])) == [1, "a", None]
    assert paging.parse_order("desc(createdAtMs), id") == [("createdAtMs", True), ("id", False)]


def test_full_page_still_says_more(spark):
    df = spark.range(501).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("key"))
    assert rec.key_scan(df, limit=500).first().has_more


def test_overlay(spark):
    s = "key string, title string, lsn long"
    stored = spark.createDataFrame([("a", "Disk A", 1), ("b", "Disk B", 2), ("d", "Disk D", 4)], s)
    hot = spark.createDataFrame([("b", "Hot B", 20), ("c", "Hot C", 30)], s)
    assert [r.title for r in rec.key_scan(rec.overlay(stored, hot), limit=4).orderBy("key").collect()] == ["Disk A", "Hot B", "Hot C", "Disk D"]
    dead = spark.createDataFrame([("a",)], "key string")
    assert keys(rec.overlay(stored, hot, dead)) == ["b", "c", "d"]
    assert keys(rec.overlay(stored, hot).filter("title like 'Disk%'")) == ["a", "d"]  # a live row shadows even if it is filtered


def test_visibility(spark):
    df = spark.createDataFrame([("1", "user-a"), ("2", "user-b")], "key string, ownerId string")
    assert keys(rec.visible_rows(df, ["ownerId"], "user-a")) == ["1"] and keys(rec.visible_rows(df, ["ownerId"], None)) == []


def facts(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], "tbl string, lsn long, kind string, key string, value double")


U, D = folds.UPSERT, folds.DELETE


def test_incremental_counts_and_sums(spark):
    log = facts(spark, (1, U, "a", 10.5), (2, U, "b", 4.5), (3, U, "c", 2.0), (4, U, "c", None), (5, D, "a", None))
    assert {tuple(r) for r in agg.count_updates(log).collect()} == {(1, 1), (2, 2), (3, 3), (5, 2)}
    assert {tuple(r) for r in agg.sum_updates(log, F.col("value")).collect()} == {(1, 10.5), (2, 15.0), (3, 17.0), (4, 15.0), (5, 4.5)}
    assert agg.table_sum(folds.fold_records(log), "value").first().total == 4.5
    assert agg.table_sum(log.limit(0), "value").first().total == 0


def test_as_of(spark):
    log = facts(spark, (1, U, "a", 1.0), (2, D, "a", None), (3, U, "a", 3.0))
    state = lambda at: {tuple(r) for r in folds.replay_as_of(log, "t", ["a", "z"], at).collect()}
    assert state(1) == {("a", "exists", 1, 1.0), ("z", "missing", None, None)}
    assert state(2) == {("a", "deleted", 2, None), ("z", "missing", None, None)}
    assert state(3) == {("a", "exists", 3, 3.0), ("z", "missing", None, None)}


def test_integrity(spark):
    log = spark.createDataFrame([(1,), (2,), (2,), (5,)], "lsn long")
    assert tuple(folds.integrity(log).first()) == (4, 3, 1, 1, 5, 2)
    for width in (1 << 20, 2):
        assert [tuple(r) for r in folds.gaps(log, width).collect()] == [(2, 5, 2)]
    assert [tuple(r) for r in folds.duplicates(log).collect()] == [(2, 2)]


def test_sync_keeps_transactions_whole(spark):
    log = spark.createDataFrame([(1, "a")] * 5 + [(2, "b")] * 2 + [(3, "c")], "lsn long, key string")
    assert folds.sync_page(log, 0, 3).count() == 5  # the first one comes whole
    assert {r.lsn for r in folds.sync_page(log, 1, 3).collect()} == {2, 3}
    assert {r.lsn for r in folds.sync_page(log, 1, 2).collect()} == {2}


def test_running_total_over_ranges(spark):
    df = spark.createDataFrame([(i, i % 3 - 1) for i in range(100)], "lsn long, delta long")
    got = {r.lsn: r.total for r in folds.running_total(df, 7).collect()}
    total = 0
    for i in range(100):
        total += i % 3 - 1
        assert got[i] == total


def test_query_diff(spark):
    s = "key string, lsn long, value string"
    before = spark.createDataFrame([("room-a", 1, "Old"), ("room-b", 2, "Deleted")], s)
    after = spark.createDataFrame([("room-a", 3, "New"), ("room-c", 4, "Added")], s)
    deletes = spark.createDataFrame([("room-b", 5)], "key string, lsn long")
    assert {tuple(r) for r in live.query_diff(before, after, deletes).collect()} == {("room-a", "updated", False, 3), ("room-b", "removed", True, 5), ("room-c", "added", False, 4)}
    assert {r.deleted for r in live.query_diff(before, after).collect()} == {False}
    a, b = (live.fingerprint(x).first().result_id for x in (before, before.orderBy(F.desc("key"))))
    assert a == b != live.fingerprint(after).first().result_id


def test_object_ranges_and_chains(spark):
    assert [ob.parse_range(h, 100) for h in ("bytes=0-9", "bytes=90-", "bytes=-5", "bytes=100-", "bytes=5-2", "x", "bytes=95-200")] == [(0, 10), (90, 10), (95, 5), None, None, None, (95, 5)]
    rows = [("f1", 0, 10, True), ("i1", 10, 20, True), ("i2", 10, 30, True), ("i3", 30, 40, False), ("f2", 0, 25, True)]
    assert ob.latest_chain(spark.createDataFrame(rows, "bundle_id string, base_lsn long, current_lsn long, ok boolean")) == ["f1", "i2"]


def test_latest_chain_brute_force_and_long(spark):
    import random
    import time

    def walked(rows):
        good = sorted((r for r in rows if r[3]), key=lambda r: (r[2], r[0]))
        best = []
        for full in (r for r in good if r[1] == 0):
            chain = [full]
            while more := [r for r in good if r[1] == chain[-1][2] and r[2] > r[1] > 0]:
                chain.append(max(more, key=lambda r: (r[2], r[0])))
            if not best or chain[-1][2] > best[-1][2]:
                best = chain
        return [r[0] for r in best]

    schema, r = "bundle_id string, base_lsn long, current_lsn long, ok boolean", random.Random(5)
    for n in (0, 1, 5, 20, 40, 80):
        rows = [(f"b{i}", r.choice([0, r.randrange(-2, 30)]), r.randrange(0, 30), r.random() < 0.8) for i in range(n)]
        assert ob.latest_chain(spark.createDataFrame(rows, schema)) == walked(rows)
    n, start = 40_000, time.time()
    long = spark.range(2 * n).selectExpr("concat('b', id) as bundle_id", f"if(id < {n}, 0, id - {n} + 1) as base_lsn", f"if(id < {n}, id + 1, id - {n} + 2) as current_lsn", "true as ok")
    assert ob.latest_chain(long) == ["b0"] + [f"b{n + i}" for i in range(n)]
    assert time.time() - start < 60


def test_schema(spark):
    fields = {"title": {"kind": "text", "inlineUntil": 4}, "n": {"kind": "int64", "optional": True}, "tags": {"kind": "list", "item": {"kind": "string"}}, "o": {"kind": "object", "fields": {"x": {"kind": "boolean"}}}}
    df = spark.createDataFrame([(1, "éé", None, ["a"], (True,)), (2, "ééé", 1, [None], (None,)), (3, None, 1, [], None)], "i int, title string, n long, tags array<string>, o struct<x:boolean>")
    got = {r.i: r.bad for r in df.select("i", sc.validate(df, fields).alias("bad")).collect()}
    assert got == {1: [], 2: ["title", "tags", "o"], 3: ["title", "o"]}
    assert sc.struct_type(fields)["o"].dataType["x"].dataType.typeName() == "boolean"
    old = {"tables": {"t": {"fields": {"a": {"kind": "string"}, "b": {"kind": "int64"}}}}}
    plan = lambda f, **x: dict(sc.migration_plan(old, {"tables": {"t": {"fields": f, **x}}}))
    assert plan({"a": {"kind": "string"}}) == {"t.b": "replaySafe"}
    assert plan({"a": {"kind": "int64"}, "b": {"kind": "int64"}}) == {"t.a": "unsafe"}
    assert plan({**old["tables"]["t"]["fields"], "c": {"kind": "string", "optional": True}}) == {"t.c": "compatible"}
    assert plan({**old["tables"]["t"]["fields"], "c": {"kind": "string"}}) == {"t.c": "unsafe"}
    assert plan(old["tables"]["t"]["fields"], indexes={"byA": {}}) == {"t#indexes": "rebuild"}
    assert sc.report({"name": " ", "tables": {"t": {"fields": {"a": {"kind": "id", "entity": ""}}, "indexes": {"i": {"fields": ["z"]}}}}}) == ["name is blank", "t.a: entity is blank", "t.i: unknown field z"]


def test_unique_index(spark):
    s = "key string, email string"
    have = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], s)
    batch = spark.createDataFrame([("d", "x"), ("e", None)], s)
    assert [tuple(r) for r in co.unique_violations(have, batch, ["email"]).collect()] == [("x", 2, "a")]
    assert co.unique_violations(have, batch, ["email"], spark.createDataFrame([("a",)], "key string")).count() == 0


def test_shards_and_scopes(spark):
    import hashlib

    df = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    for n in (1, 7, 256):
        got = {r.key: r.s for r in df.select("key", shard_index(F.col("key"), n).alias("s")).collect()}
        assert got == {k: int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big") % n for k in got}
    rows = spark.createDataFrame([("big", f"k{i}") for i in range(60)] + [("small", "k")], "scope string, key string")
    sizes = {r.scope: r["count"] for r in split_scopes(rows, 20, 4).groupBy("scope").count().collect()}
    assert max(sizes.values()) <= 20 and sizes["small"] == 1 and sum(sizes.values()) == 61


def test_behavior_scopes(spark):
    assert be.allowed(["sendMessage:room-*"], "sendMessage", "room-1") and not be.allowed(["sendMessage:room-1"], "sendMessage", "room-2") and be.allowed(["*"], "x", "y")
    with pytest.raises(ValueError):
        be.behavior("bad", reads=["files"])(lambda c: [])

    @be.behavior("greedy", commands=["sendMessage:room-1"])
    def greedy(context):
        return [{"kind": "sendMessage", "target": context["room"], "value": "x"}]

    rows = spark.createDataFrame([("m1", 1, '{"room": "room-1"}'), ("m2", 2, '{"room": "room-2"}')], "mutation_id string, lsn long, context string")
    got = {r.mutation_id: (r.kind, r.child_id) for r in be.invoke("greedy", rows).collect()}
    assert got == {"m1": ("messageCreated", "m1:000:messageCreated"), "m2": ("behaviorRejected", "m2:000:behaviorRejected")}


def test_type_order(spark):
    rows = ['"b"', "2", "null", "true", "false", '"a"', "-1.5", "[1]"]
    df = spark.createDataFrame([(x,) for x in rows], "j string").select("j", F.parse_json("j").alias("v"))
    assert [r.j for r in df.orderBy(paging.typed_sort_key(F.col("v"))).collect()] == ["null", "false", "true", "-1.5", "2", '"a"', '"b"', "[1]"]
