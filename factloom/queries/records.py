"""Registered queries over record tables: scans, indexes, predicates, pages, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import register
from factloom.functions.hashing import record_shard_key, scope_key, shard_index
from factloom.functions.paging import encode_cursor, typed_sort_key
from factloom.functions.predicates import compile_predicate
from factloom.operators import records as op
from factloom.operators.aggregates import top_per_group
from factloom.queries import model as m
from factloom.queries.model import CUSTOMERS, LOG, MESSAGES, OBJECTS, OVERLAY, SHARD, page_sql

C = "key, name, nation, acctbal, segment, lsn, updated_at_ms"
M = "id, key, room, parent_key, nested_key, sender, body_bytes, created_at_ms, lsn"
PREDICATE = {"all": [{"path": "segment", "op": "eq", "value": "BUILDING"}, {"path": "acctbal", "op": "gte", "value": 1000}]}


@register("point_get", f"WITH {CUSTOMERS} SELECT {C} FROM cust WHERE key = '17'")
def point_get(spark, d):
    return op.point_get(m.customers(spark, d), "17")


@register("point_get_overlay", f"WITH {OVERLAY} SELECT {C} FROM merged WHERE key IN ('20', '28', '21')")
def point_get_overlay(spark, d):
    rows = op.overlay(m.customers(spark, d), m.live_customers(spark, d), m.dead_customers(spark, d))
    return rows.filter(F.col("key").isin("20", "28", "21"))


@register("key_scan", f"WITH {CUSTOMERS} {page_sql(f'SELECT {C} FROM cust', 'key', 40, C)}")
def key_scan(spark, d):
    return op.key_scan(m.customers(spark, d), limit=40)


@register("keyset_page2", f"""WITH {CUSTOMERS} {page_sql(f"SELECT {C} FROM cust WHERE key > '1030'", 'key', 50, C)}""")
def keyset_page2(spark, d):
    return op.key_scan(m.customers(spark, d), after_key="1030")


@register("prefix_scan", f"""WITH {CUSTOMERS} {page_sql(f"SELECT {C} FROM cust WHERE starts_with(key, '12')", 'key', 30, C)}""")
def prefix_scan(spark, d):
    return op.prefix_scan(m.customers(spark, d), "12", limit=30)


@register("key_range", f"WITH {CUSTOMERS} SELECT {C} FROM cust WHERE key >= '12' AND key < '13'")
def key_range(spark, d):
    return op.key_range(m.customers(spark, d), "12", "13")


@register("key_range_snapshot", f"WITH {OVERLAY} SELECT {C} FROM merged WHERE key >= '2' AND key < '3' AND segment = 'BUILDING'")
def key_range_snapshot(spark, d):
    rows = op.overlay(m.customers(spark, d), m.live_customers(spark, d), m.dead_customers(spark, d))
    return op.key_range(rows, "2", "3").filter(F.col("segment") == "BUILDING")


@register("nested_partition_scan", f"""WITH {MESSAGES} {page_sql(f"SELECT {M} FROM msg WHERE parent_key = '7' AND nested_key > '0'", 'nested_key', 3, M)}""")
def nested_partition_scan(spark, d):
    return op.partition_scan(m.messages(spark, d), "7", "0", 3)


@register("nested_schema_order", f"""WITH {MESSAGES} {page_sql(f"SELECT {M} FROM msg WHERE parent_key = '7'", 'created_at_ms DESC, id', 4, M)}""")
def nested_schema_order(spark, d):
    return op.ordered_partition_scan(m.messages(spark, d), "7", "desc(created_at_ms), id", limit=4)


@register("schema_order_page2", f"""WITH {MESSAGES} {page_sql(f"SELECT {M} FROM msg WHERE parent_key = '7' AND (created_at_ms < 3000 OR (created_at_ms = 3000 AND id > '7:3'))", 'created_at_ms DESC, id', 4, M)}""")
def schema_order_page2(spark, d):
    return op.ordered_partition_scan(m.messages(spark, d), "7", "desc(created_at_ms), id", encode_cursor([3000, "7:3"]), 4)


@register("recent_records", f"WITH {CUSTOMERS} {page_sql(f'SELECT {C} FROM cust', 'lsn DESC, updated_at_ms DESC, key', 20, C)}")
def recent_records(spark, d):
    return op.recent(m.customers(spark, d), 20)


@register("index_exact", f"""WITH {CUSTOMERS} {page_sql(f"SELECT {C} FROM cust WHERE segment = 'MACHINERY'", 'key', 50, C)}""")
def index_exact(spark, d):
    return op.index_exact(m.customers(spark, d), ["segment"], ["MACHINERY"])


@register("index_prefix", f"""WITH {CUSTOMERS} {page_sql(f"SELECT {C} FROM cust WHERE nation = 7", 'key', 500, C)}""")
def index_prefix(spark, d):
    return op.index_exact(m.customers(spark, d), ["nation", "acctbal"], [7], limit=500)


RANGE = f"SELECT {C} FROM cust WHERE (nation > 3 OR (nation = 3 AND acctbal >= 0)) AND (nation < 5 OR (nation = 5 AND acctbal <= 5000))"


@register("index_range", f"WITH {CUSTOMERS} {page_sql(RANGE, 'nation, acctbal, key', 25, C)}")
def index_range(spark, d):
    return op.index_range(m.customers(spark, d), ["nation", "acctbal"], [3, 0.0], [5, 5000.0], limit=25)


@register("index_range_page2", f"""WITH {CUSTOMERS} {page_sql(RANGE + " AND (nation > 3 OR (nation = 3 AND (acctbal > 5000 OR (acctbal = 5000 AND key > '1'))))", 'nation, acctbal, key', 25, C)}""")
def index_range_page2(spark, d):
    return op.index_range(m.customers(spark, d), ["nation", "acctbal"], [3, 0.0], [5, 5000.0], cursor=[3, 5000.0, "1"], limit=25)


@register("list_records", f"""WITH {CUSTOMERS} {page_sql(f"SELECT {C} FROM cust WHERE segment = 'BUILDING' AND acctbal >= 1000 AND {SHARD.format("'customer:' || key", 4)} = 2 AND key > '1'", 'key', 20, C)}""")
def list_records(spark, d):
    return op.list_records(m.customers(spark, d), {"table": "customer", "predicate": PREDICATE, "shard": 2, "shards": 4, "after_key": "1", "limit": 20})


@register("index_records", f"""WITH {CUSTOMERS} {page_sql(f"SELECT {C} FROM cust WHERE nation >= 4 AND nation <= 9 AND segment = 'BUILDING' AND acctbal >= 1000", 'nation, key', 30, C)}""")
def index_records(spark, d):
    return op.index_records(m.customers(spark, d), {"fields": ["nation"], "lower": [4], "upper": [9], "predicate": PREDICATE, "limit": 30})


@register("predicate_conjunction", f"""WITH {CUSTOMERS} {page_sql(f"SELECT {C} FROM cust WHERE segment = 'BUILDING' AND acctbal >= 1000 AND key > '10'", 'key', 50, C)}""")
def predicate_conjunction(spark, d):
    return op.list_records(m.customers(spark, d), {"predicate": PREDICATE, "after_key": "10"})


def _variant(spark, d):
    return m.log(spark, d).select("lsn", "key", "kind", "value", F.parse_json("props").alias("props"), F.parse_json(F.concat(F.lit("{"), F.when(F.col("lsn") % 3 == 0, F.concat(F.lit('"deep": {"x": '), (F.col("lsn") % 10).cast("string"), F.lit("}"))).otherwise(""), F.lit("}"))).alias("extra"))


def _pred(name: str, term: dict, sql: str):
    """A predicate over the JSON properties of the log."""

    @register(name, f"WITH {LOG} SELECT lsn, key FROM log WHERE {sql}")
    def run(spark, d):
        rows = _variant(spark, d)
        return rows.filter(compile_predicate(rows, {"all": [term]})).select("lsn", "key")


K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_pred("pred_eq", {"path": "props.k", "op": "eq", "value": 50}, f"{K} = 50")
_pred("pred_ne", {"path": "props.k", "op": "ne", "value": 50}, f"{K} <> 50")
_pred("pred_range", {"path": "props.k", "op": "gte", "value": 90}, f"{K} >= 90")
_pred("pred_exists", {"path": "extra.deep.x", "op": "exists", "value": False}, "lsn % 3 <> 0")
_pred("pred_nested_path", {"path": "extra.deep.x", "op": "lt", "value": 3}, "lsn % 3 = 0 AND lsn % 10 < 3")
_pred("pred_contains_str", {"path": "kind", "op": "contains", "value": "Upsert"}, "contains(kind, 'Upsert')")
_pred("pred_starts_with", {"path": "kind", "op": "startsWith", "value": "record"}, "starts_with(kind, 'record')")


@register("pred_contains_array", f"WITH {m.SOURCES} SELECT source FROM src WHERE list_contains(refs, '9')")
def pred_contains_array(spark, d):
    rows = m.sources(spark, d)
    return rows.filter(compile_predicate(rows, {"all": [{"path": "refs", "op": "contains", "value": "9"}]})).select("source")


@register("shard_filter", f"WITH {CUSTOMERS} SELECT {C} FROM cust WHERE {SHARD.format(chr(39) + 'customer:' + chr(39) + ' || key', 8)} = 3")
def shard_filter(spark, d):
    return op.shard_filter(m.customers(spark, d), "customer", 3, 8)


@register("rls_visible_rows", f"WITH {LOG} SELECT key, value, lsn FROM folded WHERE key = '42'")
def rls_visible_rows(spark, d):
    from factloom.operators.log import fold_records

    return op.visible_rows(fold_records(m.log(spark, d)), ["user_id"], "42").select("key", "value", "lsn")


@register("valid_keys", f"WITH {CUSTOMERS} SELECT key FROM cust WHERE regexp_full_match(key, '[0-9]{{1,3}}')")
def valid_keys(spark, d):
    return op.valid_keys(m.customers(spark, d), "^[0-9]{1,3}$").select("key")


@register("index_type_order", f"WITH {LOG} SELECT lsn, row_number() OVER (ORDER BY {K}, lsn) AS position FROM log ORDER BY position LIMIT 300")
def index_type_order(spark, d):
    from pyspark.sql.window import Window

    rows = _variant(spark, d).withColumn("v", F.variant_get("props", "$.k", "variant"))
    rows = rows.orderBy(typed_sort_key(F.col("v")), "lsn").limit(300)  # a page of the index, by a top-k over the whole log
    return rows.select("lsn", F.row_number().over(Window.orderBy(typed_sort_key(F.col("v")), "lsn")).cast("long").alias("position"))


def _overlay(spark, d, live_only=False):
    return op.overlay(m.customers(spark, d), m.live_customers(spark, d), None if live_only else m.dead_customers(spark, d))


@register("overlay_merge", f"WITH {OVERLAY} {page_sql(f'SELECT {C} FROM cust WHERE key NOT IN (SELECT key FROM live) UNION ALL SELECT {C} FROM live', 'key', 100, C)}")
def overlay_merge(spark, d):
    return op.key_scan(_overlay(spark, d, True), limit=100)


@register("overlay_tombstone", f"WITH {OVERLAY} {page_sql(f'SELECT {C} FROM merged WHERE acctbal >= 5000', 'key', 100, C)}")
def overlay_tombstone(spark, d):
    return op.key_scan(_overlay(spark, d).filter("acctbal >= 5000"), limit=100)


@register("overlay_schema_order", f"WITH {OVERLAY} {page_sql(f'SELECT {C} FROM merged', 'acctbal DESC, key', 60, C)}")
def overlay_schema_order(spark, d):
    from factloom.functions.paging import order_columns, page

    return page(_overlay(spark, d), order_columns("desc(acctbal), key"), 60)


@register("overlay_index_range", f"WITH {OVERLAY} {page_sql(f'SELECT {C} FROM merged WHERE nation >= 2 AND nation <= 4', 'nation, key', 60, C)}")
def overlay_index_range(spark, d):
    return op.index_range(_overlay(spark, d), ["nation"], [2], [4], limit=60)


@register("overlay_index_exact", f"""WITH {OVERLAY} {page_sql(f"SELECT {C} FROM merged WHERE segment = 'FURNITURE'", 'key', 60, C)}""")
def overlay_index_exact(spark, d):
    return op.index_exact(_overlay(spark, d), ["segment"], ["FURNITURE"], limit=60)


@register("object_list", f"WITH {OBJECTS} {page_sql('''SELECT object_id AS key, byte_size, created_at_ms, content_type FROM obj WHERE object_id > '2' ''', 'key', 50, 'key, byte_size, created_at_ms, content_type')}")
def object_list(spark, d):
    return op.key_scan(m.objects(spark, d).withColumnRenamed("object_id", "key"), "2")


@register("user_list", f"WITH {LOG} {page_sql('''SELECT user_id AS key, max(lsn) AS lsn FROM log WHERE kind = 'userUpserted' GROUP BY user_id''', 'key', 30, 'key, lsn')}")
def user_list(spark, d):
    from factloom.operators.log import fold_latest

    return op.key_scan(fold_latest(m.log(spark, d), "userUpserted", "user_id", []).select(F.col("user_id").alias("key"), "lsn"), limit=30)


@register("connection_list", f"WITH {m.CONNECTIONS} SELECT session_id, user_id, transport, last_seen_ms FROM conn WHERE transport = 'ws' AND user_id IN ('3', '4', '5', '6', '7', '8')")
def connection_list(spark, d):
    return m.connections(spark, d).filter((F.col("transport") == "ws") & F.col("user_id").isin("3", "4", "5", "6", "7", "8")).select("session_id", "user_id", "transport", "last_seen_ms")


@register("shard_distribution", f"WITH {CUSTOMERS} SELECT {SHARD.format(chr(39) + 'customer:' + chr(39) + ' || key', 16)} AS shard, count(*) AS n FROM cust GROUP BY 1")
def shard_distribution(spark, d):
    key = record_shard_key(F.lit("customer"), F.col("key"))
    return m.customers(spark, d).groupBy(shard_index(key, 16).alias("shard")).agg(F.count("*").alias("n"))


@register("shard_routing", f"WITH {MESSAGES} SELECT id, {SHARD.format(chr(39) + 'rooms.messages:' + chr(39) + ' || parent_key', 8)} AS shard FROM msg")
def shard_routing(spark, d):
    key = record_shard_key(F.lit("rooms.messages"), F.col("key"), F.col("parent_key"))
    return m.messages(spark, d).select("id", shard_index(key, 8).alias("shard"))


@register("scope_buckets", f"WITH {CUSTOMERS} SELECT 'customer:' || lpad(lower(to_hex({SHARD.format(chr(39) + 'customer:' + chr(39) + ' || key', 256)})), 2, '0') AS scope, count(*) AS n FROM cust GROUP BY 1")
def scope_buckets(spark, d):
    return m.customers(spark, d).groupBy(scope_key(F.lit("customer"), F.col("key")).alias("scope")).agg(F.count("*").alias("n"))


@register("route_lookup", f"""WITH {CUSTOMERS}, map AS (SELECT * FROM (VALUES (0, 'node-a', 1), (1, 'node-b', 1), (2, 'node-a', 2), (3, 'node-c', 1)) AS v(shard, owner, epoch))
 SELECT key, m.shard::BIGINT AS shard, owner, epoch FROM cust JOIN map m ON {SHARD.format(chr(39) + 'customer:' + chr(39) + ' || key', 4)} = m.shard""")
def route_lookup(spark, d):
    route = spark.sql("SELECT * FROM VALUES (0L, 'node-a', 1), (1L, 'node-b', 1), (2L, 'node-a', 2), (3L, 'node-c', 1) AS v(shard, owner, epoch)")
    rows = m.customers(spark, d).withColumn("shard", shard_index(record_shard_key(F.lit("customer"), F.col("key")), 4))
    return rows.join(F.broadcast(route), "shard").select("key", "shard", "owner", "epoch")


@register("scope_split", f"""WITH {CUSTOMERS}, s AS (SELECT key, 'customer:' || CAST(nation AS VARCHAR) AS scope FROM cust),
 big AS (SELECT scope FROM s GROUP BY scope HAVING count(*) > 60)
 SELECT CASE WHEN b.scope IS NULL THEN s.scope ELSE s.scope || '/' || CAST({SHARD.format("s.scope || ':' || key", 4)} AS VARCHAR) END AS scope, count(*) AS n
 FROM s LEFT JOIN big b ON s.scope = b.scope GROUP BY 1""")
def scope_split(spark, d):
    from factloom.operators.scopes import split_scopes

    rows = m.customers(spark, d).select("key", F.concat(F.lit("customer:"), F.col("nation").cast("string")).alias("scope"))
    return split_scopes(rows, most_rows=60, children=4, rounds=1).groupBy("scope").agg(F.count("*").alias("n"))


@register("scope_residency", f"""WITH {LOG}, d AS (SELECT room AS scope, lsn, CASE kind WHEN 'messageCreated' THEN 1 WHEN 'userEventPublished' THEN -1 END AS delta FROM log WHERE kind IN ('messageCreated', 'userEventPublished'))
 SELECT scope, CAST(sum(delta) AS BIGINT) AS subscribers, max(lsn) AS last_lsn, sum(delta) <= 0 AND max(lsn) < (SELECT max(lsn) FROM log) - 100 AS idle FROM d GROUP BY scope""")
def scope_residency(spark, d):
    from factloom.operators.scopes import residency

    rows = m.log(spark, d).filter(F.col("kind").isin("messageCreated", "userEventPublished"))
    now = m.log(spark, d).agg(F.max("lsn").alias("now"))
    return residency(rows.select(F.col("room").alias("scope"), "lsn", F.when(F.col("kind") == "messageCreated", 1).otherwise(-1).alias("delta")), now, 100)


@register("latest_per_room_topk", f"WITH {MESSAGES} SELECT room, id, lsn FROM msg QUALIFY row_number() OVER (PARTITION BY room ORDER BY lsn DESC) <= 3")
def latest_per_room_topk(spark, d):
    return top_per_group(m.messages(spark, d), ["room"], [F.desc("lsn")], 3).select("room", "id", "lsn")
