"""Registered queries on constraints, schemas, backups, behaviors and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import register
from factloom.operators import behaviors as be
from factloom.operators import constraints as co
from factloom.operators import log as folds
from factloom.plans import schema as sc
from factloom.queries import model as m
from factloom.queries.model import CUSTOMERS, LOG, MESSAGES, OVERLAY

FIELDS = {
    "name": {"kind": "text", "inlineUntil": 18},
    "nation": {"kind": "int64"},
    "segment": {"kind": "id", "entity": "Segment"},
    "note": {"kind": "string", "optional": True},
}
OLD = {"name": "shop", "objects": ["Object"], "tables": {"customer": {"fields": FIELDS, "indexes": {"bySegment": {"fields": ["segment"]}}}}}
NEW = {"name": "shop", "objects": ["Object"], "tables": {"customer": {"fields": {
    "name": {"kind": "text", "inlineUntil": 64}, "nation": {"kind": "string"}, "segment": {"kind": "id", "entity": "Segment"},
    "tags": {"kind": "list", "item": {"kind": "string"}, "optional": True}, "owner": {"kind": "id", "entity": "User"}},
    "indexes": {"bySegment": {"fields": ["segment"]}, "byOwner": {"fields": ["owner", "missing"]}}}, "visits": {"fields": {"at": {"kind": "timeMs"}}}}}


@register("schema_violations", f"""WITH {CUSTOMERS}, v AS (SELECT key, CASE WHEN lsn % 9 = 0 THEN NULL ELSE name || CASE WHEN lsn % 4 = 0 THEN 'é' ELSE '' END END AS name, CASE WHEN lsn % 5 = 0 THEN '  ' ELSE segment END AS segment, CASE WHEN lsn % 7 = 0 THEN NULL ELSE nation END AS nation FROM cust)
 SELECT key, concat_ws(',', CASE WHEN name IS NULL OR strlen(name) > 18 THEN 'name' END, CASE WHEN nation IS NULL THEN 'nation' END, CASE WHEN trim(segment) = '' THEN 'segment' END) AS invalid FROM v
 WHERE name IS NULL OR strlen(name) > 18 OR nation IS NULL OR trim(segment) = ''""")
def schema_violations(spark, d):
    rows = m.customers(spark, d).select(
        "key",
        F.when(F.col("lsn") % 9 != 0, F.concat("name", F.when(F.col("lsn") % 4 == 0, "é").otherwise(""))).alias("name"),
        F.when(F.col("lsn") % 5 == 0, "  ").otherwise(F.col("segment")).alias("segment"),
        F.when(F.col("lsn") % 7 != 0, F.col("nation")).alias("nation"),
        F.lit(None).cast("string").alias("note"),
    )
    bad = rows.withColumn("bad", sc.validate(rows, FIELDS)).filter(F.size("bad") > 0)
    return bad.select("key", F.array_join("bad", ",").alias("invalid"))


@register("unique_violations", f"""WITH {CUSTOMERS}, c AS (SELECT key, 'Customer#' || lpad(CAST((lsn * 3) % 400 AS VARCHAR), 9, '0') AS name FROM cust WHERE lsn <= 200), e AS (SELECT key, name FROM cust WHERE key NOT IN (SELECT key FROM c) AND lsn % 10 <> 0 UNION ALL SELECT * FROM c)
 SELECT name, count(DISTINCT key) AS keys, min(key) AS first_key FROM e GROUP BY name HAVING count(DISTINCT key) > 1""")
def unique_violations(spark, d):
    rows = m.customers(spark, d)
    batch = rows.filter("lsn <= 200").withColumn("name", F.concat(F.lit("Customer#"), F.lpad(((F.col("lsn") * 3) % 400).cast("string"), 9, "0")))
    return co.unique_violations(rows, batch, ["name"], rows.filter("lsn % 10 = 0"))


@register("occ_conflicts", f"WITH {OVERLAY}, q AS (SELECT key, CASE WHEN lsn % 3 = 0 THEN 0 ELSE lsn END AS expected_lsn FROM cust WHERE lsn % 2 = 0) SELECT q.key, expected_lsn, coalesce(m.lsn, 0) AS current_lsn FROM q LEFT JOIN merged m ON q.key = m.key WHERE expected_lsn <> coalesce(m.lsn, 0)")
def occ_conflicts(spark, d):
    from factloom.operators.records import overlay

    asked = m.customers(spark, d).filter("lsn % 2 = 0").select("key", F.when(F.col("lsn") % 3 == 0, 0).otherwise(F.col("lsn")).alias("expected_lsn"))
    return co.occ_conflicts(overlay(m.customers(spark, d), m.live_customers(spark, d), m.dead_customers(spark, d)), asked)


@register("pending_conflicts", f"WITH {LOG}, q AS (SELECT lsn AS queued, key, lsn - 40 AS expected_lsn FROM log WHERE kind = 'messageCreated') SELECT queued, q.key, expected_lsn, coalesce(f.lsn, 0) AS current_lsn FROM q LEFT JOIN folded f ON q.key = f.key WHERE coalesce(f.lsn, 0) > expected_lsn")
def pending_conflicts(spark, d):
    log = m.log(spark, d)
    queue = log.filter("kind = 'messageCreated'").select(F.col("lsn").alias("queued"), "key", (F.col("lsn") - 40).alias("expected_lsn"))
    now = folds.fold_records(log).select("key", F.col("lsn").alias("current_lsn"))
    return queue.join(now, "key", "left").withColumn("current_lsn", F.coalesce("current_lsn", F.lit(0))).filter("current_lsn > expected_lsn").select("queued", "key", "expected_lsn", "current_lsn")


@register("idempotent_replay", f"WITH {LOG} SELECT mutation_id, min(lsn) AS lsn, arg_min(kind, lsn) AS kind, count(*) - 1 AS replays, count(DISTINCT kind) > 1 AS conflict FROM log GROUP BY mutation_id")
def idempotent_replay(spark, d):
    return co.idempotent_replay(m.log(spark, d))


@register("identity_violations", f"WITH {MESSAGES} SELECT id, parent_key FROM (SELECT *, CASE WHEN lsn % 5 = 0 THEN sender ELSE room END AS value_parent, CASE WHEN lsn % 3 = 0 THEN NULL ELSE id END AS value_id FROM msg) WHERE value_parent <> parent_key OR (value_id IS NOT NULL AND value_id <> key)")
def identity_violations(spark, d):
    rows = m.messages(spark, d).withColumns({"value_parent": F.when(F.col("lsn") % 5 == 0, F.col("sender")).otherwise(F.col("room")), "value_id": F.when(F.col("lsn") % 3 != 0, F.col("id"))})
    return co.identity_violations(rows, [("value_parent", "parent_key"), ("value_id", "key")]).select("id", "parent_key")


@register("size_violations", "SELECT page_id, CAST(strlen(html) AS BIGINT) AS bytes FROM pages WHERE strlen(html) > 8192")
def size_violations(spark, d):
    return co.size_violations(m.table(spark, d, "pages"), "html", 8192).select("page_id", F.octet_length("html").cast("long").alias("bytes"))


@register("schema_report", "SELECT 'customer.byOwner: unknown field missing' AS issue")
def schema_report(spark, d):
    return spark.createDataFrame([(x,) for x in sc.report(NEW)], "issue string")


@register("migration_plan", """SELECT * FROM (VALUES ('customer.name', 'compatible'), ('customer.nation', 'unsafe'), ('customer.note', 'replaySafe'), ('customer.owner', 'unsafe'), ('customer.tags', 'compatible'), ('customer.tags[]', 'compatible'),
 ('visits', 'compatible'), ('visits.at', 'compatible'), ('customer#indexes', 'rebuild')) AS t(path, verdict)""")
def migration_plan(spark, d):
    return spark.createDataFrame(sc.migration_plan(OLD, NEW), "path string, verdict string")


@register("schema_history", f"WITH {LOG} SELECT version, arg_max(schema, lsn) AS schema, max(lsn) AS lsn, max(lsn) = (SELECT max(lsn) FROM log WHERE kind = 'userUpserted') AS active FROM (SELECT file AS version, 'v' || CAST(lsn AS VARCHAR) AS schema, lsn FROM log WHERE kind = 'userUpserted') GROUP BY version")
def schema_history(spark, d):
    facts = m.log(spark, d).filter("kind = 'userUpserted'").select(F.col("file").alias("version"), F.concat(F.lit("v"), F.col("lsn").cast("string")).alias("schema"), "lsn")
    return sc.recover(facts)


@register("schema_recover", f"WITH {LOG} SELECT version, schema, lsn FROM (SELECT file AS version, 'v' || CAST(lsn AS VARCHAR) AS schema, lsn FROM log WHERE kind = 'userUpserted') ORDER BY lsn DESC LIMIT 1")
def schema_recover(spark, d):
    return schema_history(spark, d).filter("active").select("version", "schema", "lsn")


@be.behavior("welcome", reads=["records:accounts"], commands=["sendMessage:room-*", "upsertRecord:accounts"])
def _welcome(context: dict) -> list[dict]:
    out = [{"kind": "upsertRecord", "target": "accounts", "value": context["value"]}]
    if context["value"] > 50:
        out.append({"kind": "sendMessage", "target": f"room-{context['room']}", "value": "welcome"})
    return out


@register("behavior_commands", f"""WITH {LOG}, s AS (SELECT * FROM log WHERE kind = 'userUpserted'), c AS (SELECT mutation_id, lsn, 0 AS op_index, 'recordUpserted' AS kind, 'accounts' AS key FROM s UNION ALL SELECT mutation_id, lsn, 1, 'messageCreated', 'room-' || room FROM s WHERE value > 50)
 SELECT mutation_id, lsn, op_index, kind, key, mutation_id || ':00' || CAST(op_index AS VARCHAR) || ':' || kind AS child_id FROM c""")
def behavior_commands(spark, d):
    rows = m.log(spark, d).filter("kind = 'userUpserted'").select("mutation_id", "lsn", F.to_json(F.struct("value", "room")).alias("context"))
    return be.invoke("welcome", rows).drop("value", "part", "durable")


@register("read_plan", f"WITH {LOG} SELECT room, (SELECT count(*) FROM folded f WHERE f.room = r.room) AS records, (SELECT count(*) FROM log l WHERE l.room = r.room AND kind = 'userEventPublished') AS events FROM (SELECT DISTINCT room FROM log) r")
def read_plan(spark, d):
    log = m.log(spark, d)
    n = lambda rows, name: rows.groupBy("room").agg(F.count("*").alias(name))
    made = log.select("room").distinct().join(n(folds.fold_records(log), "records"), "room", "left").join(n(log.filter("kind = 'userEventPublished'"), "events"), "room", "left")
    return made.select("room", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("events", F.lit(0)).alias("events"))


@register("channel_state_cas", f"""WITH RECURSIVE {LOG}, u AS (SELECT room AS channel, lsn, CASE WHEN lsn % 3 = 0 THEN 0 END AS expected, row_number() OVER (PARTITION BY room ORDER BY lsn) AS rn FROM log WHERE kind = 'recordUpserted'),
 r AS (SELECT channel, lsn, rn, true AS accepted, 1 AS version FROM u WHERE rn = 1 UNION ALL
  SELECT u.channel, u.lsn, u.rn, expected IS NULL OR expected = version, version + CAST(expected IS NULL OR expected = version AS INT) FROM r JOIN u ON u.channel = r.channel AND u.rn = r.rn + 1)
 SELECT channel, lsn, accepted, version FROM r""")
def channel_state_cas(spark, d):
    from factloom.streaming.live_tables import channel_cas

    rows = m.log(spark, d).filter("kind = 'recordUpserted'")
    return channel_cas(rows.select(F.col("room").alias("channel"), "lsn", F.when(F.col("lsn") % 3 == 0, F.lit(0)).cast("long").alias("expected"), F.col("value").cast("string").alias("value")))


@register("stream_fold", f"WITH {LOG} SELECT key, lsn, value FROM folded")
def stream_fold(spark, d):
    """The log as a stream of files, folded by micro-batches."""
    from factloom.sources import store
    from factloom.streaming import live_tables as st

    path = m.scratch(spark)
    log = m.log(spark, d).select("lsn", "kind", "tbl", "key", "value")
    log.repartitionByRange(3, "lsn").write.parquet(f"{path}/log")
    fold, done = store.fold_runs(f"{path}/state"), []

    def sink(batch, number):
        fold(batch, number)
        done.append(number)

    st.run_available(st.read_log_stream(spark, f"{path}/log", log.schema), sink, f"{path}/checkpoint")
    return store.folded_runs(spark, f"{path}/state", done[-1] + 1).select("key", "lsn", "value")


@register("stream_agg_count", f"WITH {LOG} SELECT tbl, count(*) AS n FROM folded GROUP BY tbl")
def stream_agg_count(spark, d):
    """Live keys by table, counted by keyed stream state."""
    from factloom.streaming import live_tables as st

    rows = m.log(spark, d).select("lsn", "kind", "tbl", "key", "value")
    return m.streamed(spark, rows, st.live_counts, "tbl string, lsn long, delta long").groupBy("tbl").agg(F.sum("delta").alias("n"))


@register("wal_recoverable_prefix", f"WITH {LOG} SELECT lsn, key, value FROM log WHERE shard <> 0 OR lsn <= 1000")
def wal_recoverable_prefix(spark, d):
    """A JSON log, one file a shard, of which one is torn: the facts before its first bad line."""
    from factloom.sources.logs import read_recoverable

    path = m.scratch(spark)
    rows = m.log(spark, d).select("shard", "lsn", F.when(F.col("lsn") == 1001, F.lit('{"lsn": 10')).otherwise(F.to_json(F.struct("lsn", "key", "value"))).alias("value"))
    rows.repartition("shard").sortWithinPartitions("shard", "lsn").select("shard", "value").write.partitionBy("shard").text(f"{path}/log")
    intact, _ = read_recoverable(spark, f"{path}/log")
    return intact.select("lsn", "key", "value")


@register("bundle_verify", f"WITH {LOG} SELECT 5000 AS base_lsn, count(*) FILTER (lsn > 5000) AS records, greatest(max(lsn), 5000) AS current_lsn, 0 AS issues FROM log")
def bundle_verify(spark, d):
    from factloom.sources import logs

    path = m.scratch(spark)
    made = logs.export_bundle(m.log(spark, d), f"{path}/bundle", 5000)
    found = logs.verify_bundle(spark, f"{path}/bundle")
    return spark.createDataFrame([(made["base_lsn"], made["records"], made["current_lsn"], len(found))], "base_lsn long, records long, current_lsn long, issues long")


@register("import_preflight", "SELECT * FROM (VALUES (5000, 'ok'), (4000, 'base 5000 is not the target''s 4000')) AS t(target_lsn, finding)")
def import_preflight(spark, d):
    from factloom.sources import logs

    path = m.scratch(spark)
    logs.export_bundle(m.log(spark, d), f"{path}/bundle", 5000)
    rows = [(at, x) for at in (5000, 4000) for x in (logs.import_preflight(spark, f"{path}/bundle", at, m.SHARDS) or ["ok"])]
    return spark.createDataFrame(rows, "target_lsn long, finding string")


@register("transaction_issues", f"""WITH {CUSTOMERS}, o AS (SELECT (lsn - 1) // 3 AS txn, 'customer' AS tbl, CASE WHEN lsn % 17 = 0 THEN '5' WHEN lsn % 17 = 1 THEN '5' ELSE CAST((lsn - 1) // 3 AS VARCHAR) END AS key, CASE WHEN lsn % 29 = 0 THEN 'volatile' ELSE 'strict' END AS durability FROM cust),
 g AS (SELECT txn, count(*) AS ops, count(DISTINCT {m.SHARD.format("tbl || ':' || key", 4)}) AS shards, count(DISTINCT key) AS keys, max(CAST(durability = 'volatile' AS INT)) AS v FROM o GROUP BY txn)
 SELECT txn, ops, concat_ws(',', CASE WHEN ops > 500 THEN 'tooManyOps' END, CASE WHEN shards > 1 THEN 'manyShards' END, CASE WHEN keys < ops THEN 'keyTwice' END, CASE WHEN v = 1 THEN 'volatile' END) AS issues FROM g""")
def transaction_issues(spark, d):
    from factloom.operators.writes import transaction_issues as issues

    txn = F.floor((F.col("lsn") - 1) / 3)
    key = F.when(F.col("lsn") % 17 <= 1, F.lit("5")).otherwise(txn.cast("string"))
    rows = m.customers(spark, d).select(txn.alias("txn"), F.lit("customer").alias("tbl"), key.alias("key"), F.when(F.col("lsn") % 29 == 0, "volatile").otherwise("strict").alias("durability"))
    return issues(rows, 4)


@register("batch_split", f"""WITH {LOG}, o AS (SELECT lsn // 1000 AS batch, lsn AS position, tbl, key, {m.SHARD.format("tbl || ':' || key", 4)} AS shard FROM ops), c AS (SELECT *, (row_number() OVER (PARTITION BY batch, shard ORDER BY position) - 1) // 50 AS chunk FROM o)
 SELECT batch, position, shard, chunk, 'b' || CAST(batch AS VARCHAR) || ':' || lpad(CAST(shard * 100 + chunk AS VARCHAR), 3, '0') || ':records' AS child_id FROM c""")
def batch_split(spark, d):
    from factloom.operators.writes import split_batch

    rows = m.log(spark, d).filter(F.col("kind").isin(folds.UPSERT, folds.DELETE))
    batch = F.floor(F.col("lsn") / 1000)
    rows = rows.select(batch.alias("batch"), F.col("lsn").alias("position"), "tbl", "key", F.concat(F.lit("b"), batch.cast("string")).alias("mutation_id"))
    return split_batch(rows, 4, 50).select("batch", "position", "shard", "chunk", "child_id")


@register("trace_object", f"WITH {m.SOURCES} SELECT source FROM src WHERE list_contains(refs, '12')")
def trace_object(spark, d):
    from factloom.operators.writes import deep_search

    rows = m.sources(spark, d).select("source", F.to_json(F.struct("refs")).alias("value"))
    return rows.filter(deep_search(F.col("value"), "12")).select("source")


@register("sealed_checksums", f"""WITH {LOG} SELECT lsn, CASE WHEN lsn % 2 = 0 THEN repeat('f', 64) ELSE sha256('{{"key":"' || key || '","kind":"' || kind || '","lsn":' || CAST(lsn AS VARCHAR) || ',"value":' || CAST(value AS VARCHAR) || '}}') END AS checksum FROM log""")
def sealed_checksums(spark, d):
    from factloom.operators.writes import seal

    rows = m.log(spark, d).withColumn("checksum", F.when(F.col("lsn") % 2 == 0, F.lit("f" * 64)))
    return seal(rows, ["lsn", "kind", "key", "value"]).select("lsn", "checksum")
