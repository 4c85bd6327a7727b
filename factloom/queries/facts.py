"""Registered queries over the log: folds, traces, audit, integrity, aggregates, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import register
from factloom.operators import aggregates as agg
from factloom.operators import log as op
from factloom.operators import objects as ob
from factloom.operators.records import latest_by, overlay
from factloom.queries import model as m
from factloom.queries.model import CONNECTIONS, CUSTOMERS, LOG, MESSAGES, OBJECTS, OVERLAY, SOURCES

FACT = "lsn, kind, key, value"


@register("wal_scan_dedup", f"WITH {LOG} SELECT {FACT} FROM log")
def wal_scan_dedup(spark, d):
    log = m.log(spark, d)
    return op.scan(log.filter("lsn % 3 = 0").withColumn("value", F.lit(-1.0)), log.filter("lsn % 2 = 0"), log.filter("lsn % 2 = 1 or lsn % 3 = 0")).select("lsn", "kind", "key", "value")


@register("wal_tail", f"WITH {LOG} SELECT {FACT} FROM log WHERE lsn > (SELECT max(event_id) FROM events) - 99")
def wal_tail(spark, d):
    log = m.log(spark, d)
    last = m.table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return op.tail(log, last - 99).select("lsn", "kind", "key", "value")


@register("fold_records", f"WITH {LOG} SELECT tbl, key, lsn, value FROM folded")
def fold_records(spark, d):
    return op.fold_records(m.log(spark, d)).select("tbl", "key", "lsn", "value")


@register("fold_transactions", f"WITH {LOG}, t AS (SELECT lsn, key AS k, value FROM log WHERE kind = 'recordUpserted'), o AS (SELECT lsn, 0 AS op_index, k AS key, 'recordUpserted' AS kind, value FROM t UNION ALL SELECT lsn, 1, CAST((CAST(k AS BIGINT) + 1) % 150 AS VARCHAR), CASE WHEN lsn % 3 = 0 THEN 'recordDeleted' ELSE 'recordUpserted' END, value * 2 FROM t) SELECT key, lsn, value FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC, op_index DESC) = 1) WHERE kind = 'recordUpserted'")
def fold_transactions(spark, d):
    log = m.log(spark, d).filter("kind = 'recordUpserted'")
    first = F.struct(F.lit("accounts").alias("tbl"), F.col("key").alias("key"), F.lit(op.UPSERT).alias("kind"), F.col("value").alias("value"))
    other = F.struct(F.lit("accounts").alias("tbl"), ((F.col("key").cast("long") + 1) % 150).cast("string").alias("key"), F.when(F.col("lsn") % 3 == 0, op.DELETE).otherwise(op.UPSERT).alias("kind"), (F.col("value") * 2).alias("value"))
    return op.fold_records(op.explode_transactions(log.select("lsn", F.array(first, other).alias("ops")))).select("key", "lsn", "value")


@register("fold_messages", f"WITH {LOG} SELECT lsn, room, key, ts_ms FROM log WHERE kind = 'messageCreated'")
def fold_messages(spark, d):
    return m.log(spark, d).filter("kind = 'messageCreated'").select("lsn", "room", "key", "ts_ms")


@register("fold_users", f"WITH {LOG} SELECT user_id, max(lsn) AS lsn, arg_max(value, lsn) AS value, min(lsn) AS first_lsn FROM log WHERE kind = 'userUpserted' GROUP BY user_id")
def fold_users(spark, d):
    return op.fold_latest(m.log(spark, d), "userUpserted", "user_id", ["value"]).select("user_id", "lsn", "value", "first_lsn")


@register("user_inbox", f"WITH {LOG} SELECT lsn, user_id, value FROM log WHERE kind = 'userEventPublished' AND user_id = '7' AND lsn < 9000 ORDER BY lsn DESC LIMIT 10")
def user_inbox(spark, d):
    rows = m.log(spark, d).filter("kind = 'userEventPublished' and user_id = '7' and lsn < 9000")
    return rows.orderBy(F.desc("lsn")).limit(10).select("lsn", "user_id", "value")


@register("mutation_index", f"WITH {LOG} SELECT mutation_id, max(lsn) AS lsn, arg_max(kind, lsn) AS kind FROM log GROUP BY mutation_id")
def mutation_index(spark, d):
    return latest_by(m.log(spark, d).select("mutation_id", "lsn", "kind"), ["mutation_id"], [F.col("lsn")])


@register("pending_reminders", f"WITH {LOG} SELECT room, user_id, lsn, value FROM (SELECT * FROM log WHERE kind IN ('userUpserted', 'recordDeleted', 'userEventPublished') QUALIFY row_number() OVER (PARTITION BY room, user_id ORDER BY lsn DESC) = 1) WHERE kind = 'userUpserted'")
def pending_reminders(spark, d):
    return op.pending(m.log(spark, d), ["room", "user_id"], "userUpserted", "recordDeleted", "userEventPublished").select("room", "user_id", "lsn", "value")


@register("due_reminders", f"WITH {LOG} SELECT room, user_id, lsn, ts_ms FROM (SELECT * FROM log WHERE kind IN ('userUpserted', 'recordDeleted') QUALIFY row_number() OVER (PARTITION BY room, user_id ORDER BY lsn DESC) = 1) WHERE kind = 'userUpserted' AND ts_ms <= 1706500000000")
def due_reminders(spark, d):
    return op.pending(m.log(spark, d), ["room", "user_id"], "userUpserted", "recordDeleted").filter("ts_ms <= 1706500000000").select("room", "user_id", "lsn", "ts_ms")


@register("pending_http", f"WITH {LOG} SELECT lsn, mutation_id FROM log WHERE kind = 'userUpserted' AND mutation_id NOT IN (SELECT mutation_id FROM log WHERE kind = 'messageCreated')")
def pending_http(spark, d):
    return op.unanswered(m.log(spark, d), "mutation_id", "userUpserted", "messageCreated").select("lsn", "mutation_id")


@register("snapshot_plus_tail", f"WITH {LOG} SELECT key, lsn, value FROM folded")
def snapshot_plus_tail(spark, d):
    log = m.log(spark, d)
    return op.snapshot_plus_tail(op.fold_records(op.as_of(log, 5000)), log, 5000).select("key", "lsn", "value")


@register("replay_as_of", f"""WITH {LOG}, s AS (SELECT * FROM ops WHERE lsn <= 4000 AND tbl = 'accounts' QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1), a AS (SELECT unnest(['1', '2', '3', '4', '5', '6', 'nobody']) AS key)
 SELECT a.key, CASE kind WHEN 'recordUpserted' THEN 'exists' WHEN 'recordDeleted' THEN 'deleted' ELSE 'missing' END AS status, lsn AS source_lsn, CASE WHEN kind = 'recordUpserted' THEN value END AS value FROM a LEFT JOIN s ON a.key = s.key""")
def replay_as_of(spark, d):
    return op.replay_as_of(m.log(spark, d), "accounts", ["1", "2", "3", "4", "5", "6", "nobody"], 4000)


for _name, _parts in {"trace_record": {"key": "12"}, "trace_room": {"room": "3", "kind": "messageCreated"}, "trace_user": {"user_id": "9"}, "trace_mutation": {"mutation_id": "m35"}}.items():

    @register(_name, f"WITH {LOG} SELECT {FACT} FROM log WHERE " + " AND ".join(f"{k} = '{v}'" for k, v in _parts.items()))
    def _trace(spark, d, parts=_parts):
        return op.trace(m.log(spark, d), **parts).select("lsn", "kind", "key", "value")


@register("audit_filter", f"WITH {LOG} SELECT {FACT} FROM log WHERE kind = 'userEventPublished' AND user_id = '11'")
def audit_filter(spark, d):
    return op.audit(m.log(spark, d), user="11").select("lsn", "kind", "key", "value")


@register("live_objects", f"WITH {LOG} SELECT key AS object_id, lsn FROM folded")
def live_objects(spark, d):
    return ob.touched_since(_object_log(spark, d), 0)


@register("export_object_ids", f"WITH {LOG} SELECT key AS object_id, lsn FROM folded WHERE lsn > 8000")
def export_object_ids(spark, d):
    return ob.touched_since(_object_log(spark, d), 8000)


def _object_log(spark, d):
    kind = F.when(F.col("kind") == op.UPSERT, "objectCommitted").otherwise("objectDeleted")
    return m.log(spark, d).filter(F.col("kind").isin(op.UPSERT, op.DELETE)).select("lsn", F.col("key").alias("object_id"), kind.alias("kind"))


@register("object_refs", f"WITH {SOURCES} SELECT object_id, count(DISTINCT source) AS ref_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM refs GROUP BY object_id")
def object_refs(spark, d):
    return ob.reference_index(m.sources(spark, d))


@register("ref_counts", f"WITH {SOURCES}, {OBJECTS}, c AS (SELECT object_id, count(DISTINCT source) AS ref_count FROM refs GROUP BY 1) SELECT coalesce(o.object_id, c.object_id) AS object_id, coalesce(ref_count, 0) AS ref_count, o.object_id IS NULL AS dangling FROM obj o FULL JOIN c ON o.object_id = c.object_id")
def ref_counts(spark, d):
    refs = ob.reference_index(m.sources(spark, d)).select("object_id", "ref_count")
    have = m.objects(spark, d).select("object_id", F.lit(True).alias("there"))
    return have.join(refs, "object_id", "full_outer").select("object_id", F.coalesce("ref_count", F.lit(0)).alias("ref_count"), F.col("there").isNull().alias("dangling"))


@register("dangling_refs", f"WITH {SOURCES}, {OBJECTS} SELECT source, object_id FROM refs WHERE object_id NOT IN (SELECT object_id FROM obj)")
def dangling_refs(spark, d):
    return ob.dangling(m.sources(spark, d), m.objects(spark, d)).select("source", "object_id")


@register("gc_classify", f"WITH {SOURCES}, {OBJECTS}, n AS (SELECT max(created_at_ms) AS now FROM obj) SELECT object_id, byte_size, CASE WHEN object_id IN (SELECT object_id FROM refs) THEN 'retained' WHEN now - created_at_ms < 100000 THEN 'protected' ELSE 'deleted' END AS decision FROM obj, n")
def gc_classify(spark, d):
    objects = m.objects(spark, d)
    now = objects.agg(F.max("created_at_ms")).first()[0]
    return ob.gc_classify(objects, m.sources(spark, d).select(F.explode("refs").alias("object_id")), now, 100_000)


@register("attachments_resolved", f"""WITH {MESSAGES}, {OBJECTS}, a AS (SELECT id, unnest([0, 1, 2]) AS position, unnest([room, CAST(lsn AS VARCHAR), '0']) AS object_id FROM msg WHERE room <> '0' AND lsn <> 0)
 SELECT id, CAST(position AS BIGINT) AS position, a.object_id, byte_size, byte_size IS NULL AS missing FROM a LEFT JOIN obj o ON a.object_id = o.object_id""")
def attachments_resolved(spark, d):
    msg = m.messages(spark, d).filter("room != '0' and lsn != 0")
    return ob.resolve_attachments(msg.withColumn("attachments", F.array("room", F.col("lsn").cast("string"), F.lit("0"), "room")), m.objects(spark, d))


@register("latest_messages", f"WITH {MESSAGES} SELECT id, room, lsn FROM msg WHERE room = '5' AND lsn < 5006 ORDER BY lsn DESC LIMIT 3")
def latest_messages(spark, d):
    rows = m.messages(spark, d).filter("room = '5' and lsn < 5006")
    return rows.orderBy(F.desc("lsn")).limit(3).select("id", "room", "lsn")


@register("message_merge", f"WITH {MESSAGES} SELECT id, CASE WHEN lsn % 4 = 0 THEN 'hot' ELSE 'log' END AS origin, lsn FROM msg")
def message_merge(spark, d):
    rows = m.messages(spark, d).select(F.col("id").alias("key"), "lsn")
    hot = rows.filter("lsn % 4 = 0").withColumn("origin", F.lit("hot"))
    return overlay(rows.withColumn("origin", F.lit("log")), hot).select(F.col("key").alias("id"), "origin", "lsn")


@register("hot_window", f"WITH {MESSAGES} SELECT room, id, lsn FROM msg QUALIFY row_number() OVER (PARTITION BY room ORDER BY lsn DESC) <= 2")
def hot_window(spark, d):
    return agg.top_per_group(m.messages(spark, d), ["room"], [F.desc("lsn")], 2).select("room", "id", "lsn")


@register("prewarm_rows", f"WITH {LOG} SELECT tbl, key, lsn FROM folded QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY lsn DESC) <= 20")
def prewarm_rows(spark, d):
    return agg.top_per_group(op.fold_records(m.log(spark, d)), ["tbl"], [F.desc("lsn")], 20).select("tbl", "key", "lsn")


@register("lru_evict", f"WITH {CUSTOMERS} SELECT segment, key FROM cust QUALIFY row_number() OVER (PARTITION BY segment ORDER BY acctbal DESC, key DESC) > 100")
def lru_evict(spark, d):
    rows = m.customers(spark, d)
    kept = agg.top_per_group(rows, ["segment"], [F.desc("acctbal"), F.desc("key")], 100)
    return rows.join(kept.select("key"), "key", "left_anti").select("segment", "key")


@register("idle_evict", f"WITH {CUSTOMERS} SELECT key FROM cust WHERE 20000 - updated_at_ms > 15000 AND lsn > 0")
def idle_evict(spark, d):
    return m.customers(spark, d).filter((F.lit(20000) - F.col("updated_at_ms") > 15000) & (F.col("lsn") > 0)).select("key")


@register("lru_rooms", f"WITH {LOG}, r AS (SELECT room, max(ts_ms) AS seen_ms FROM log GROUP BY room) SELECT room, seen_ms FROM r ORDER BY seen_ms, room LIMIT 5")
def lru_rooms(spark, d):
    rows = m.log(spark, d).groupBy("room").agg(F.max("ts_ms").alias("seen_ms"))
    return rows.orderBy("seen_ms", "room").limit(5)


@register("agg_count", f"WITH {LOG} SELECT tbl, count(*) AS n FROM folded GROUP BY tbl")
def agg_count(spark, d):
    return agg.table_counts(op.fold_records(m.log(spark, d)))


@register("agg_sum", f"WITH {LOG} SELECT CAST(coalesce(sum(CAST(value AS DECIMAL(20, 2))), 0) AS DOUBLE) AS total FROM folded")
def agg_sum(spark, d):
    return agg.table_sum(op.fold_records(m.log(spark, d)), "value")


@register("agg_sum_lineitem", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) AS DOUBLE) AS total FROM lineitem")
def agg_sum_lineitem(spark, d):
    return agg.table_sum(m.table(spark, d, "lineitem"), "l_extendedprice")


@register("agg_count_updates", f"""WITH {LOG}, s AS (SELECT lsn, CAST(kind = 'recordUpserted' AS INT) AS now, coalesce(lag(CAST(kind = 'recordUpserted' AS INT)) OVER (PARTITION BY key ORDER BY lsn), 0) AS before FROM ops)
 SELECT lsn, CAST(sum(now - before) OVER (ORDER BY lsn) AS BIGINT) AS total FROM s WHERE now <> before""")
def agg_count_updates(spark, d):
    return agg.count_updates(m.log(spark, d))


@register("agg_sum_updates", f"""WITH {LOG}, v AS (SELECT lsn, key, CAST(CASE WHEN kind = 'recordUpserted' THEN value ELSE 0 END AS DECIMAL(20, 2)) AS now FROM ops), s AS (SELECT lsn, now - coalesce(lag(now) OVER (PARTITION BY key ORDER BY lsn), 0) AS delta FROM v)
 SELECT lsn, CAST(sum(delta) OVER (ORDER BY lsn) AS DOUBLE) AS total FROM s WHERE delta <> 0""")
def agg_sum_updates(spark, d):
    return agg.sum_updates(m.log(spark, d), F.col("value"))


@register("presence_counts", f"WITH {LOG} SELECT room AS channel, count(*) AS members, count(DISTINCT user_id) AS users FROM log WHERE kind = 'userUpserted' GROUP BY room")
def presence_counts(spark, d):
    return agg.presence(m.log(spark, d).filter("kind = 'userUpserted'").withColumnRenamed("room", "channel"))


_SPAN = "count(*) AS records, min(lsn) AS min_lsn, max(lsn) AS max_lsn"
for _name, _by, _kinds in (
    ("manifest_payloads", "kind", None),
    ("manifest_tables", "tbl", [op.UPSERT, op.DELETE]),
    ("manifest_rooms", "room", ["messageCreated"]),
    ("manifest_users", "user_id", ["userUpserted", "userEventPublished"]),
    ("manifest_shards", "shard", None),
):
    _where = f"WHERE kind IN ({', '.join(repr(k) for k in _kinds)})" if _kinds else ""

    @register(_name, f"WITH {LOG} SELECT {_by}, {_SPAN} FROM log {_where} GROUP BY {_by}")
    def _manifest(spark, d, by=_by, kinds=_kinds):
        return agg.manifest(m.log(spark, d), by, kinds)


@register("manifest_objects", f"WITH {OBJECTS} SELECT content_type, count(*) AS objects, CAST(sum(byte_size) AS BIGINT) AS bytes FROM obj GROUP BY content_type")
def manifest_objects(spark, d):
    return m.objects(spark, d).groupBy("content_type").agg(F.count("*").alias("objects"), F.sum("byte_size").alias("bytes"))


HOLES = f"{LOG}, holey AS (SELECT * FROM log WHERE lsn % 97 <> 0 AND lsn % 98 <> 0 UNION ALL SELECT * FROM log WHERE lsn % 500 = 1)"


def _holey(spark, d):
    log = m.log(spark, d)
    return log.filter("lsn % 97 != 0 and lsn % 98 != 0").unionByName(log.filter("lsn % 500 = 1"))


@register("wal_integrity", f"WITH {HOLES} SELECT count(*) AS record_count, count(DISTINCT lsn) AS unique_count, count(*) - count(DISTINCT lsn) AS duplicate_count, min(lsn) AS min_lsn, max(lsn) AS max_lsn, max(lsn) - min(lsn) + 1 - count(DISTINCT lsn) AS missing_count FROM holey")
def wal_integrity(spark, d):
    return op.integrity(_holey(spark, d))


@register("wal_gaps", f"WITH {HOLES}, s AS (SELECT DISTINCT lsn FROM holey), g AS (SELECT lag(lsn) OVER (ORDER BY lsn) AS after_lsn, lsn AS before_lsn FROM s) SELECT after_lsn, before_lsn, before_lsn - after_lsn - 1 AS missing FROM g WHERE before_lsn - after_lsn > 1")
def wal_gaps(spark, d):
    return op.gaps(_holey(spark, d), 1000)


@register("wal_duplicates", f"WITH {HOLES} SELECT lsn, count(*) AS copies FROM holey GROUP BY lsn HAVING count(*) > 1")
def wal_duplicates(spark, d):
    return op.duplicates(_holey(spark, d))


@register("wal_file_stats", f"WITH {LOG} SELECT file, count(*) AS records, min(lsn) AS min_lsn, max(lsn) AS max_lsn, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms FROM log GROUP BY file")
def wal_file_stats(spark, d):
    return op.file_stats(m.log(spark, d), "file")


@register("connection_totals", f"WITH {CONNECTIONS} SELECT count(*) AS sessions, count(DISTINCT user_id) AS users, count(*) FILTER (transport = 'ws') AS n_ws, count(*) FILTER (transport = 'sse') AS n_sse, count(*) FILTER (transport = 'poll') AS n_poll FROM conn")
def connection_totals(spark, d):
    return agg.connection_totals(m.connections(spark, d), ["ws", "sse", "poll"])


@register("connection_user_summary", f"""WITH {CONNECTIONS}, r AS (SELECT user_id, string_agg(DISTINCT room, ',' ORDER BY room) AS rooms FROM (SELECT user_id, unnest(rooms) AS room FROM conn) GROUP BY user_id)
 SELECT c.user_id, count(*) AS sessions, string_agg(DISTINCT transport, ',' ORDER BY transport) AS transports, any_value(r.rooms) AS rooms, max(last_seen_ms) AS last_seen_ms,
 'accounts=' || CAST(sum(n_accounts) AS VARCHAR) || ',rooms=' || CAST(sum(n_rooms) AS VARCHAR) AS counts FROM conn c JOIN r ON c.user_id = r.user_id GROUP BY c.user_id""")
def connection_user_summary(spark, d):
    return agg.connection_users(m.connections(spark, d))


@register("channel_summary", f"WITH {LOG}, ch AS (SELECT room AS channel, count(DISTINCT user_id) AS members FROM log WHERE kind = 'userUpserted' GROUP BY room), st AS (SELECT room AS channel, count(*) AS state_version FROM log WHERE kind = 'recordUpserted' AND value > 200 GROUP BY room) SELECT ch.channel, members, coalesce(state_version, 0) AS state_version FROM ch LEFT JOIN st ON ch.channel = st.channel")
def channel_summary(spark, d):
    log = m.log(spark, d).withColumnRenamed("room", "channel")
    members = log.filter("kind = 'userUpserted'").groupBy("channel").agg(F.countDistinct("user_id").alias("members"))
    state = log.filter("kind = 'recordUpserted' and value > 200").groupBy("channel").agg(F.count("*").alias("state_version"))
    return members.join(state, "channel", "left").select("channel", "members", F.coalesce("state_version", F.lit(0)).alias("state_version"))


@register("actor_kind_counts", f"WITH {LOG} SELECT kind, count(DISTINCT key) AS actors, count(*) AS pending FROM log GROUP BY kind")
def actor_kind_counts(spark, d):
    return m.log(spark, d).groupBy("kind").agg(F.countDistinct("key").alias("actors"), F.count("*").alias("pending"))


@register("room_status", f"WITH {MESSAGES} SELECT room, count(*) AS messages, min(lsn) FILTER (lsn > 0) AS first_lsn, max(lsn) FILTER (lsn > 0) AS last_lsn FROM msg GROUP BY room")
def room_status(spark, d):
    return agg.room_status(m.messages(spark, d))


@register("hot_status", f"WITH {OVERLAY} SELECT segment, count(*) AS rows, count(*) FILTER (lsn > 1000000) AS live FROM merged GROUP BY segment")
def hot_status(spark, d):
    rows = overlay(m.customers(spark, d), m.live_customers(spark, d), m.dead_customers(spark, d))
    return rows.groupBy("segment").agg(F.count("*").alias("rows"), F.count(F.when(F.col("lsn") > 1_000_000, 1)).alias("live"))


@register("projection_status", f"WITH {LOG} SELECT 'records' AS projection, (SELECT count(*) FROM folded) AS rows, (SELECT max(lsn) FROM ops) AS applied_lsn UNION ALL SELECT 'messages', count(*), max(lsn) FROM log WHERE kind = 'messageCreated'")
def projection_status(spark, d):
    log = m.log(spark, d)
    last = log.filter(F.col("kind").isin(op.UPSERT, op.DELETE)).agg(F.max("lsn").alias("applied_lsn"))
    records = op.fold_records(log).agg(F.lit("records").alias("projection"), F.count("*").alias("rows")).join(F.broadcast(last))
    messages = log.filter("kind = 'messageCreated'").agg(F.lit("messages").alias("projection"), F.count("*").alias("rows"), F.max("lsn").alias("applied_lsn"))
    return records.unionByName(messages)


@register("scope_bytes", f"WITH {LOG} SELECT room AS scope, CAST(sum(strlen(key) + strlen(props) + 64) AS BIGINT) AS bytes FROM log GROUP BY room")
def scope_bytes(spark, d):
    size = F.octet_length("key") + F.octet_length("props") + 64
    return m.log(spark, d).groupBy(F.col("room").alias("scope")).agg(F.sum(size.cast("long")).alias("bytes"))


BUNDLES = """b AS (SELECT 'b' || CAST(n AS VARCHAR) AS bundle_id, n * 1000 AS created_at_ms, n // 6 AS chain_id, n % 6 AS position,
 CASE WHEN n % 6 = 0 THEN 0 ELSE n * 100 - (CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END) END AS base_lsn, (n + 1) * 100 AS current_lsn,
 CASE WHEN n % 6 = 0 THEN [] ELSE ['b' || CAST(n - n % 6 AS VARCHAR), 'b' || CAST(n - 1 AS VARCHAR)] END AS chain, n % 13 <> 12 AS ok FROM (SELECT DISTINCT event_id // 100 AS n FROM events))"""


def bundles(spark, d):
    n = m.table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("n")).distinct()
    name = lambda x: F.concat(F.lit("b"), x.cast("string"))
    full = F.col("n") % 6 == 0
    return n.select(
        name(F.col("n")).alias("bundle_id"), (F.col("n") * 1000).alias("created_at_ms"), F.floor(F.col("n") / 6).alias("chain_id"), (F.col("n") % 6).alias("position"),
        F.when(full, F.lit(0)).otherwise(F.col("n") * 100 - F.when(F.col("n") % 11 == 0, 1).otherwise(0)).alias("base_lsn"), ((F.col("n") + 1) * 100).alias("current_lsn"),
        F.when(full, F.array().cast("array<string>")).otherwise(F.array(name(F.col("n") - F.col("n") % 6), name(F.col("n") - 1))).alias("chain"), (F.col("n") % 13 != 12).alias("ok"),
    )


@register("backup_retention", f"""WITH {BUNDLES}, r AS (SELECT *, row_number() OVER (ORDER BY created_at_ms DESC, bundle_id DESC) AS rn FROM b), o AS (SELECT *, rn <= 4 OR created_at_ms >= 90000 AS own FROM r)
 SELECT bundle_id, CASE WHEN own THEN 'keep' WHEN bundle_id IN (SELECT unnest(chain) FROM o WHERE own) THEN 'chain' ELSE 'delete' END AS decision FROM o""")
def backup_retention(spark, d):
    return ob.backup_retention(bundles(spark, d), 4, 90_000)


@register("backup_chain_verify", f"WITH {BUNDLES} SELECT chain_id, position, coalesce(CASE WHEN row_number() OVER w = 1 THEN base_lsn = 0 ELSE base_lsn = lag(current_lsn) OVER w END, false) AS continuous FROM b WINDOW w AS (PARTITION BY chain_id ORDER BY position)")
def backup_chain_verify(spark, d):
    return ob.verify_chain(bundles(spark, d))


@register("backup_latest_chain", f"""WITH RECURSIVE {BUNDLES}, nxt AS (SELECT * FROM b WHERE ok AND base_lsn > 0 AND current_lsn > base_lsn QUALIFY row_number() OVER (PARTITION BY base_lsn ORDER BY current_lsn DESC, bundle_id DESC) = 1),
 c AS (SELECT bundle_id AS root, current_lsn AS root_lsn, bundle_id, current_lsn, 0 AS position FROM b WHERE ok AND base_lsn = 0 UNION ALL SELECT root, root_lsn, nxt.bundle_id, nxt.current_lsn, c.position + 1 FROM c JOIN nxt ON nxt.base_lsn = c.current_lsn)
 SELECT position, bundle_id FROM c WHERE root = (SELECT root FROM c GROUP BY root ORDER BY max(current_lsn) DESC, min(root_lsn) LIMIT 1)""")
def backup_latest_chain(spark, d):
    return spark.createDataFrame(list(enumerate(ob.latest_chain(bundles(spark, d)))), "position int, bundle_id string")


@register("unknown_schema_versions", f"WITH {LOG} SELECT DISTINCT file AS schema_version FROM log WHERE file NOT IN (0, 1, 2, 3)")
def unknown_schema_versions(spark, d):
    known = spark.range(4).withColumnRenamed("id", "schema_version")
    return m.log(spark, d).select(F.col("file").alias("schema_version")).distinct().join(known, "schema_version", "left_anti")


@register("day_bucket_counts", f"WITH {LOG} SELECT ts_ms // 86400000 AS day, count(*) AS n FROM log GROUP BY 1")
def day_bucket_counts(spark, d):
    return m.log(spark, d).groupBy(F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.count("*").alias("n"))


@register("volatile_excluded", f"WITH {LOG} SELECT key, lsn, value FROM folded")
def volatile_excluded(spark, d):
    log = m.log(spark, d)
    volatile = log.filter("kind = 'userEventPublished'").withColumns({"lsn": F.lit(0).cast("long"), "kind": F.lit(op.UPSERT)})
    return op.fold_records(log.unionByName(volatile).filter("lsn > 0")).select("key", "lsn", "value")


@register("object_range", "SELECT CAST(doc_id AS VARCHAR) AS object_id, substr(hex(encode(coalesce(text, ''))), 21, 40) AS part FROM documents")
def object_range(spark, d):
    """Bytes 10-29 of each object's body."""
    body = m.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("object_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return body.select("object_id", F.hex(ob.body_range(F.col("content"), F.lit(10), F.lit(20))).alias("part"))
