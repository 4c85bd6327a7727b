"""Registered queries on the write path, stored logs, rebuilds, bundles and schema changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import register
from factloom.operators import commands as cm
from factloom.operators import log as folds
from factloom.plans.schema_apply import SchemaRefused, SchemaRegistry
from factloom.queries import model as m
from factloom.queries.model import CUSTOMERS, LOG, MESSAGES, OBJECTS, SOURCES
from factloom.sources import logs, store

# --- commands ---------------------------------------------------------------------------------

OUTCOMES = f"""{CUSTOMERS}, c AS (SELECT c_custkey AS position, CASE WHEN c_custkey % 5 = 0 THEN 'deleteRecord' ELSE 'upsertRecord' END AS kind, CAST((c_custkey // 3) * 4 + c_custkey % 2 AS VARCHAR) AS key,
 CASE c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN (c_custkey // 3) * 4 + c_custkey % 2 + 1 END AS expected_lsn, 'm' || CAST(c_custkey % 1100 AS VARCHAR) AS mutation_id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS name FROM customer),
 known AS (SELECT 'm' || CAST(c_custkey AS VARCHAR) AS mutation_id FROM customer WHERE c_custkey % 13 = 0),
 a AS (SELECT *, row_number() OVER (PARTITION BY mutation_id ORDER BY position) > 1 OR mutation_id IN (SELECT mutation_id FROM known) AS again FROM c),
 t AS (SELECT a.*, row_number() OVER (PARTITION BY a.key, again ORDER BY position) AS turn, coalesce(cust.lsn, 0) AS have FROM a LEFT JOIN cust ON a.key = cust.key),
 k AS (SELECT *, CASE WHEN turn > 1 THEN 'keyTwice' WHEN kind = 'upsertRecord' AND name IS NULL THEN 'invalidRecord' WHEN expected_lsn <> have THEN 'lsnConflict' END AS found FROM t),
 o AS (SELECT position, kind, key, CASE WHEN again THEN 'replay' WHEN found IS NOT NULL THEN 'refused' WHEN kind = 'deleteRecord' AND have = 0 THEN 'noop' ELSE 'applied' END AS status, CASE WHEN NOT again THEN found END AS code FROM k)"""


def _record_outcomes(spark, d):
    c = F.col("c_custkey")
    key = F.floor(c / 3) * 4 + c % 2
    rows = m.table(spark, d, "customer")
    asked = rows.select(
        c.alias("position"), F.when(c % 5 == 0, "deleteRecord").otherwise("upsertRecord").alias("kind"), key.cast("string").alias("key"),
        F.when(c % 7 == 0, F.lit(0)).when(c % 7 == 1, key + 1).alias("expected_lsn"), F.concat(F.lit("m"), (c % 1100).cast("string")).alias("mutation_id"), F.when(c % 11 != 0, F.col("c_name")).alias("name"),
    )
    known = rows.filter(c % 13 == 0).select(F.concat(F.lit("m"), c.cast("string")).alias("mutation_id"))
    return cm.record_outcomes(m.customers(spark, d), asked, known, F.col("name").isNull())


@register("record_commands", f"WITH {OUTCOMES} SELECT position, key, status, code FROM o")
def record_commands(spark, d):
    return _record_outcomes(spark, d).select("position", "key", "status", "code")


@register("record_facts", f"WITH {OUTCOMES} SELECT position, 100000 + row_number() OVER (ORDER BY position) AS lsn, CASE WHEN status = 'noop' THEN 'mutationRecorded' WHEN kind = 'upsertRecord' THEN 'recordUpserted' ELSE 'recordDeleted' END AS kind, key FROM o WHERE status IN ('applied', 'noop')")
def record_facts(spark, d):
    return cm.record_facts(_record_outcomes(spark, d), 100_000).select("position", "lsn", "kind", "key")


@register("message_commands", f"""WITH {MESSAGES}, c AS (SELECT room AS batch, lsn AS position, CASE WHEN CAST(room AS BIGINT) % 9 = 0 THEN ' ' ELSE room END AS room, body_bytes FROM msg),
 b AS (SELECT batch, count(*) AS n, max(CAST(trim(room) = '' AS INT)) AS blank, max(body_bytes) AS most FROM c GROUP BY batch)
 SELECT position, CASE WHEN n > 6 THEN 'tooManyMessages' WHEN blank = 1 THEN 'roomRequired' WHEN most > 600 THEN 'bodyTooLarge' END AS code, CASE WHEN n > 6 OR blank = 1 OR most > 600 THEN 'refused' ELSE 'applied' END AS status FROM c JOIN b ON c.batch = b.batch""")
def message_commands(spark, d):
    blank = F.when(F.col("room").cast("long") % 9 == 0, F.lit(" ")).otherwise(F.col("room"))
    rows = m.messages(spark, d).select(F.col("room").alias("batch"), F.col("lsn").alias("position"), blank.alias("room"), "body_bytes")
    return cm.message_outcomes(rows, 6, 600).select("position", "code", "status")


@register("object_commands", f"""WITH {OBJECTS}, {SOURCES}, c AS (SELECT doc_id AS position, CASE WHEN doc_id % 2 = 0 THEN 'deleteObject' ELSE 'putObject' END AS kind, CAST(doc_id * 2 AS VARCHAR) AS object_id, doc_id % 5 = 0 AS force FROM documents),
 u AS (SELECT object_id, count(DISTINCT source) AS ref_count FROM refs GROUP BY object_id)
 SELECT position, c.object_id, coalesce(ref_count, 0) AS ref_count, CASE WHEN kind = 'deleteObject' AND coalesce(ref_count, 0) > 0 AND NOT force THEN 'refused' WHEN kind = 'deleteObject' AND obj.object_id IS NULL THEN 'noop' ELSE 'applied' END AS status,
 CASE WHEN kind = 'deleteObject' AND coalesce(ref_count, 0) > 0 AND NOT force THEN 'objectReferenced' END AS code FROM c LEFT JOIN u ON c.object_id = u.object_id LEFT JOIN obj ON c.object_id = obj.object_id""")
def object_commands(spark, d):
    i = F.col("doc_id")
    asked = m.table(spark, d, "documents").select(i.alias("position"), F.when(i % 2 == 0, "deleteObject").otherwise("putObject").alias("kind"), (i * 2).cast("string").alias("object_id"), (i % 5 == 0).alias("force"))
    refs = m.sources(spark, d).select("source", F.explode("refs").alias("object_id"))
    return cm.object_outcomes(m.objects(spark, d), refs, asked).select("position", "object_id", "ref_count", "status", "code")


@register("user_commands", """WITH o AS (SELECT event_id AS position, CASE WHEN event_id % 10 = 0 THEN ' ' ELSE CAST(user_id AS VARCHAR) END AS user_id, repeat(props, event_id % 4) AS profile FROM events),
 ok AS (SELECT *, row_number() OVER (ORDER BY position) AS lsn FROM o WHERE trim(user_id) <> '' AND strlen(profile) <= 20)
 SELECT user_id, max(lsn) AS lsn, arg_max(profile, lsn) AS profile FROM ok GROUP BY user_id""")
def user_commands(spark, d):
    user = F.when(F.col("event_id") % 10 == 0, F.lit(" ")).otherwise(F.col("user_id").cast("string"))
    rows = m.table(spark, d, "events").select(F.col("event_id").alias("position"), user.alias("user_id"), F.expr("repeat(props, cast(event_id % 4 as int))").alias("profile"))
    return cm.users_after(cm.user_outcomes(rows, 20), 0)


# --- stored logs and projections --------------------------------------------------------------


def _facts(spark, d):
    return m.log(spark, d).select("lsn", "shard", "kind", "tbl", "key", "value", "ts_ms", "user_id", "room")


@register("stream_group_commit", "SELECT row_number() OVER (ORDER BY event_id) AS lsn, event_id AS position, event_type AS kind FROM events WHERE event_type IN ('purchase', 'error')")
def stream_group_commit(spark, d):
    """Commands as a stream of files: every micro-batch takes the LSNs after the head."""
    from factloom.streaming import live_tables as st

    path = m.scratch(spark)
    rows = m.table(spark, d, "events").filter("event_type in ('purchase', 'error')").select(F.col("event_id").alias("position"), F.col("event_type").alias("kind"))
    step = (rows.agg(F.max("position")).first()[0] or 0) // 3 + 1
    for k in range(3):  # one after the other, as commands arrive
        rows.filter(F.floor(F.col("position") / step) == k).coalesce(1).write.mode("append").parquet(f"{path}/commands")
    st.run_available(st.read_log_stream(spark, f"{path}/commands", rows.schema), store.group_commit(f"{path}/log"), f"{path}/checkpoint")
    return store.committed(spark, f"{path}/log").select("lsn", "position", "kind")


@register("projection_rebuild", f"WITH {LOG} SELECT tbl, key, lsn, value FROM folded")
def projection_rebuild(spark, d):
    """A projection of half the log, replaced by a validated one of all of it."""
    path = m.scratch(spark)
    log = _facts(spark, d)
    head = log.agg(F.max("lsn")).first()[0]
    store.rebuild(log.filter(F.col("lsn") <= head // 2), path)
    store.rebuild(log, path)
    return store.projection(spark, path).select("tbl", "key", "lsn", "value")


@register("wal_compaction", f"WITH {LOG} SELECT shard, count(*) FILTER (lsn <= 6000) AS archived, count(*) FILTER (lsn > 6000) AS retained FROM log GROUP BY shard")
def wal_compaction(spark, d):
    return store.compact(_facts(spark, d), m.scratch(spark), 6000)


@register("archive_retention", f"""WITH {LOG}, f AS (SELECT file, max(lsn) AS max_lsn, max(ts_ms) AS max_ts_ms FROM log GROUP BY file), b AS (SELECT max(ts_ms) - 1000000 AS bound FROM log)
 SELECT file, CASE WHEN max_lsn >= 7000 THEN 'lsn' WHEN max_ts_ms >= bound THEN 'timestamp' END AS reason, CASE WHEN max_lsn >= 7000 OR max_ts_ms >= bound THEN 'retain' ELSE 'delete' END AS action FROM f, b""")
def archive_retention(spark, d):
    log = m.log(spark, d)
    bound = log.agg(F.max("ts_ms")).first()[0] - 1_000_000
    return store.archive_retention(log, "file", 7000, bound).select("file", "reason", "action")


@register("chat_log", f"WITH {MESSAGES} SELECT room, created_at_ms // 86400000 AS day, id, lsn FROM msg")
def chat_log(spark, d):
    path = m.scratch(spark)
    logs.write_chat_log(m.messages(spark, d), path)
    return logs.read_chat_log(spark, path).select("room", "day", "id", "lsn")


@register("legacy_import", f"WITH {CUSTOMERS} SELECT key, name, nation, acctbal, lsn FROM cust")
def legacy_import(spark, d):
    """Records as JSON files below one folder a table; folders that begin with _ do not count."""
    path = m.scratch(spark)
    rows = m.customers(spark, d).select("key", "name", "nation", "acctbal", "lsn")
    rows.filter("lsn % 2 = 0").write.json(f"{path}/customer")
    rows.filter("lsn % 2 = 1").write.json(f"{path}/more/customer")
    rows.limit(9).write.json(f"{path}/_old")
    return logs.read_legacy_records(spark, path, rows.schema, one_a_file=False)


# --- bundles ------------------------------------------------------------------------------------


def _chain(spark, d, path):
    """A full bundle and two deltas of the log."""
    log = _facts(spark, d)
    head = log.agg(F.max("lsn")).first()[0]
    cuts = [0, head * 6 // 10, head * 8 // 10, head]
    for k in range(3):
        logs.export_bundle(log.filter(F.col("lsn") <= cuts[k + 1]), f"{path}/b{k}", cuts[k])
    return [f"{path}/b{k}" for k in range(3)]


@register("bundle_chain_restore", f"WITH {LOG} SELECT tbl, key, lsn, value FROM folded")
def bundle_chain_restore(spark, d):
    path = m.scratch(spark)
    store.apply_chain(spark, f"{path}/target", _chain(spark, d, path), m.SHARDS)
    return folds.fold_records(store.restored(spark, f"{path}/target")).select("tbl", "key", "lsn", "value")


@register("bundle_out_of_order", "SELECT * FROM (VALUES ('restore', 'ok'), ('skipped delta', 'refused'), ('delta', 'ok'), ('delta again', 'refused'), ('full over data', 'refused'), ('last delta', 'ok')) AS t(step, outcome)")
def bundle_out_of_order(spark, d):
    path = m.scratch(spark)
    full, one, two = _chain(spark, d, path)
    out = []
    for step, bundle in (("restore", full), ("skipped delta", two), ("delta", one), ("delta again", one), ("full over data", full), ("last delta", two)):
        try:
            store.apply_bundle(spark, f"{path}/target", bundle, m.SHARDS)
            out.append((step, "ok"))
        except store.ImportRefused:
            out.append((step, "refused"))
    return spark.createDataFrame(out, "step string, outcome string")


@register("bundle_objects", "SELECT CAST(doc_id AS VARCHAR) AS object_id, CASE WHEN doc_id % 10 = 3 THEN 'size' ELSE 'sha256' END AS issue FROM documents WHERE doc_id % 10 IN (3, 4)")
def bundle_objects(spark, d):
    """Objects of a bundle of which some bodies were damaged after the export."""
    path = m.scratch(spark)
    body = m.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("object_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("!")).cast("binary").alias("content"))
    logs.export_bundle(_facts(spark, d), path, 0, body.select("object_id", "content"))
    text = F.col("content").cast("string")
    bad = F.when(F.col("doc_id") % 10 == 3, F.concat(text, F.lit("x"))).when(F.col("doc_id") % 10 == 4, F.concat(F.expr("substring(content, 1, octet_length(content) - 1)").cast("string"), F.lit("?"))).otherwise(text)
    held = spark.read.parquet(f"{path}/objects").drop("content").join(body.select("object_id", bad.cast("binary").alias("content")), "object_id")
    return logs.object_issues(held)


# --- schema changes ------------------------------------------------------------------------------

BASE = {"room": {"kind": "string"}, "user_id": {"kind": "id", "entity": "User"}, "note": {"kind": "text", "inlineUntil": 10, "optional": True}}


def _schema(fields: dict, **table) -> dict:
    plain = {"fields": {"room": {"kind": "string"}}}
    return {"name": "app", "objects": [], "tables": {"accounts": {"fields": fields, **table}, "orders": plain}}


STEPS = [
    ("wider text", "compatible", 2),
    ("stale version", "version", 2),
    ("unknown index field", "invalid", 2),
    ("field removed", "breaking", 2),
    ("removal without a log", "noReplay", 2),
    ("removal with a log", "replay", 3),
    ("type changed", "breaking", 3),
    ("index added", "rebuild", 4),
    ("proposal", "compatible", 4),
    ("proposal accepted", "compatible", 5),
    ("proposal for an older schema", "version", 5),
]


@register("schema_apply", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {n})" for a, b, n in STEPS) + ") AS t(step, outcome, version)")
def schema_apply(spark, d):
    """What a registry makes of a series of changes; replays rebuild the projection."""
    path, log = m.scratch(spark), _facts(spark, d)
    reg = SchemaRegistry(_schema(BASE))
    wide = BASE | {"note": BASE["note"] | {"inlineUntil": 20}}
    less = {k: v for k, v in wide.items() if k != "note"}
    index = {"byRoom": {"fields": ["room"]}}
    more = less | {"tag": {"kind": "string", "optional": True}}
    again = more | {"mark": {"kind": "string", "optional": True}}
    steps = [
        lambda: reg.apply(_schema(wide), 1),
        lambda: reg.apply(_schema(wide), 1),
        lambda: reg.apply(_schema(wide, indexes={"byNone": {"fields": ["none"]}})),
        lambda: reg.apply(_schema(less)),
        lambda: reg.apply(_schema(less), allow_breaking=True),
        lambda: reg.apply(_schema(less), allow_breaking=True, log=log, root=path),
        lambda: reg.apply(_schema(less | {"room": {"kind": "int64"}}), allow_breaking=True, log=log, root=path),
        lambda: reg.apply(_schema(less, indexes=index), log=log, root=path),
        lambda: (reg.propose("p", _schema(more, indexes=index)), reg.propose("q", _schema(again, indexes=index), reg.version))[0].verdict,
        lambda: reg.accept("p"),
        lambda: reg.accept("q"),
    ]
    out = []
    for (name, _, _), step in zip(STEPS, steps):
        try:
            outcome = step()
        except SchemaRefused as why:
            outcome = why.code
        out.append((name, outcome, reg.version))
    return spark.createDataFrame(out, "step string, outcome string, version int")
