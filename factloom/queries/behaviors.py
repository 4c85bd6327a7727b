"""Registered queries on behaviors: read plans, contexts, all kinds of commands, continuations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import register
from factloom.operators import behaviors as be
from factloom.operators import channels as ch
from factloom.operators import log as folds
from factloom.queries import model as m
from factloom.queries.channels import MEMBERS, channel_events
from factloom.queries.model import CONNECTIONS, MESSAGES, OBJECTS

MOST = 5
ROOMS = "r AS (SELECT DISTINCT room FROM log)"


@register("read_plan_kinds", f"""WITH {MEMBERS}, {MESSAGES}, {OBJECTS}, {CONNECTIONS}, {ROOMS}, s AS (SELECT 'records' AS kind, room AS target FROM folded UNION ALL SELECT 'nestedRecords', parent_key FROM msg UNION ALL SELECT 'latestMessages', room FROM log WHERE kind = 'messageCreated'
 UNION ALL SELECT 'objects', object_id FROM obj UNION ALL SELECT 'objectBodies', object_id FROM obj UNION ALL SELECT 'realtimeChannelMembers', channel FROM members UNION ALL SELECT DISTINCT 'realtimeChannelStates', room FROM ops
 UNION ALL SELECT 'connectionSessions', unnest(list_distinct(rooms)) FROM conn UNION ALL SELECT 'auditTraces', room FROM log
 UNION ALL SELECT 'auditReplays', room FROM (SELECT * FROM ops WHERE lsn <= 5000 QUALIFY row_number() OVER (PARTITION BY tbl, key ORDER BY lsn DESC) = 1) WHERE kind = 'recordUpserted'),
 n AS (SELECT kind, target, count(*) AS n FROM s GROUP BY 1, 2)
 SELECT k.kind, room AS target, least(coalesce(n, 0), {MOST}) AS n FROM r, (SELECT unnest({list(be.READS)}) AS kind) k LEFT JOIN n ON n.kind = k.kind AND n.target = room""")
def read_plan_kinds(spark, d):
    """Each of the ten kinds read for every room, five items of each at most."""
    log, msg, body = m.log(spark, d), m.messages(spark, d), m.table(spark, d, "documents")
    row = lambda rows, target, position, item: rows.select(target.cast("string").alias("target"), position.cast("long").alias("position"), item.cast("string").alias("item"))
    c = F.col
    sessions = m.connections(spark, d).select("session_id", "last_seen_ms", F.explode(F.array_distinct("rooms")).alias("room"))
    states = log.filter(c("kind").isin(folds.UPSERT, folds.DELETE)).groupBy("room").agg(F.max("lsn").alias("lsn"), F.count("*").alias("version"))
    sources = {
        "records": row(folds.fold_records(log), c("room"), -c("lsn"), c("key")),
        "nestedRecords": row(msg, c("parent_key"), c("lsn"), c("id")),
        "latestMessages": row(log.filter("kind = 'messageCreated'"), c("room"), -c("lsn"), c("lsn")),
        "objects": row(m.objects(spark, d), c("object_id"), c("created_at_ms"), c("byte_size")),
        "objectBodies": row(body, c("doc_id"), F.lit(0), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)),
        "realtimeChannelMembers": row(ch.fold_members(channel_events(spark, d)), c("channel"), c("joined_lsn"), c("session_id")),
        "realtimeChannelStates": row(states, c("room"), c("lsn"), c("version")),
        "connectionSessions": row(sessions, c("room"), -c("last_seen_ms"), c("session_id")),
        "auditTraces": row(log, c("room"), c("lsn"), c("kind")),
        "auditReplays": row(folds.fold_records(folds.as_of(log, 5000)), c("room"), c("lsn"), c("key")),
    }
    rooms = log.select(c("room").alias("target")).distinct()
    asked = rooms.select(F.concat(F.lit("i"), "target").alias("id"), "target", F.lit(MOST).alias("limit"), F.explode(F.array(*map(F.lit, be.READS))).alias("kind"))
    return be.hydrate(asked, sources).select("kind", "target", "n")


@register("behavior_context", f"""WITH {m.LOG} SELECT mutation_id, lsn, CASE WHEN lsn % 4 = 0 THEN 'system' ELSE 'user' END AS sender, ts_ms, sha256('main|welcome|' || mutation_id || '|' || CASE WHEN lsn % 4 = 0 THEN '' ELSE user_id END || '|' || CAST(ts_ms AS VARCHAR)) AS seed FROM log WHERE kind = 'userUpserted'""")
def behavior_context(spark, d):
    rows = m.log(spark, d).filter("kind = 'userUpserted'").withColumn("user_id", F.when(F.col("lsn") % 4 != 0, F.col("user_id")))
    made = be.with_context(rows, "main", "welcome", "value", "room")
    part = lambda path: F.get_json_object("context", path)
    return made.select("mutation_id", "lsn", part("$.ctx.sender.kind").alias("sender"), part("$.ctx.timestampMs").cast("long").alias("ts_ms"), part("$.ctx.rngSeed").alias("seed"))


@be.behavior("everything", reads=["records"], commands=["*"])
def _everything(context: dict) -> list[dict]:
    """One command of each kind; the transaction has two operations."""
    ops = [be.command("upsertRecord", "a", 1), be.command("deleteRecord", "b")]
    return [be.command(kind, f"t{context['room']}", ops if kind == "recordTransaction" else 1) for kind in sorted(be.COMMANDS)]


@be.behavior("narrow", commands=["sendMessage:room-1*"])
def _narrow(context: dict) -> list[dict]:
    return [be.command("sendMessage", f"room-{context['room']}", "x")]


_KINDS = ", ".join(f"('{k}', {i}, '{be.COMMANDS[k]}', {str(k in be.DURABLE).lower()})" for i, k in enumerate(sorted(be.COMMANDS)))


@register("behavior_all_commands", f"""WITH {m.LOG}, s AS (SELECT * FROM log WHERE kind = 'userUpserted'), k AS (SELECT * FROM (VALUES {_KINDS}) AS t(command, op_index, kind, durable)),
 c AS (SELECT op_index, 0 AS part, kind, NULL AS key, durable FROM k WHERE command <> 'recordTransaction' UNION ALL SELECT op_index, 0, 'recordUpserted', 'a', true FROM k WHERE command = 'recordTransaction' UNION ALL SELECT op_index, 1, 'recordDeleted', 'b', true FROM k WHERE command = 'recordTransaction')
 SELECT s.mutation_id, s.lsn, op_index, part, c.kind, coalesce(c.key, 't' || room) AS key, durable, s.mutation_id || ':' || lpad(CAST(op_index AS VARCHAR), 3, '0') || ':' || c.kind AS child_id FROM s, c""")
def behavior_all_commands(spark, d):
    rows = m.log(spark, d).filter("kind = 'userUpserted'").select("mutation_id", "lsn", F.to_json(F.struct("room")).alias("context"))
    return be.invoke("everything", rows).drop("value")


@register("behavior_scopes", f"WITH {m.LOG} SELECT mutation_id, lsn, CASE WHEN starts_with(room, '1') THEN 'messageCreated' ELSE 'behaviorRejected' END AS kind, CASE WHEN starts_with(room, '1') THEN 'room-' || room ELSE 'sendMessage' END AS key FROM log WHERE kind = 'userUpserted'")
def behavior_scopes(spark, d):
    """Commands inside and outside of the declared scope of a prefix."""
    rows = m.log(spark, d).filter("kind = 'userUpserted'").select("mutation_id", "lsn", F.to_json(F.struct("room")).alias("context"))
    return be.invoke("narrow", rows).select("mutation_id", "lsn", "kind", "key")


@register("continuation_checks", """WITH c AS (SELECT event_id, event_type AS behavior, CASE WHEN event_id % 3 = 0 THEN event_id * 10 END AS deadline, CASE WHEN event_id % 4 > 0 THEN event_id % 40 END AS depth, CASE WHEN event_id % 5 = 0 THEN event_id % 7 END AS most, CASE WHEN event_id % 2 = 0 THEN ['view.run', 'click.run'] END AS path FROM events)
 SELECT event_id, CASE WHEN 50000 > deadline THEN 'deadline' WHEN coalesce(depth, 0) >= greatest(coalesce(most, 32), 1) THEN 'depth' WHEN coalesce(list_contains(path, behavior || '.run'), false) THEN 'cycle' END AS issue FROM c""")
def continuation_checks(spark, d):
    i = F.col("event_id")
    path = F.when(i % 2 == 0, F.array(F.lit("view.run"), F.lit("click.run")))
    issue = be.continuation_issue(F.col("event_type"), F.lit("run"), F.lit(50_000), F.when(i % 3 == 0, i * 10), F.when(i % 4 > 0, i % 40), F.when(i % 5 == 0, i % 7), path)
    return m.table(spark, d, "events").select("event_id", issue.alias("issue"))
