"""Registered queries on change feeds, live queries, channels, sessions and shards' merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.catalog import register
from factloom.functions.paging import page
from factloom.operators import live as op
from factloom.operators import log as folds
from factloom.operators.aggregates import top_per_group
from factloom.operators.records import latest_by
from factloom.queries import model as m
from factloom.queries.model import CONNECTIONS, CUSTOMERS, LOG, page_sql

FACT = "lsn, kind, key, value"


@register("sync_pull", f"""WITH {LOG} SELECT {FACT} FROM log WHERE lsn > 500 AND ((kind = 'messageCreated' AND room IN ('1', '2')) OR (kind IN ('userUpserted', 'userEventPublished') AND user_id = '5') OR (kind IN ('recordUpserted', 'recordDeleted') AND tbl = 'accounts')) ORDER BY lsn LIMIT 100""")
def sync_pull(spark, d):
    rows = folds.sync_filter(m.log(spark, d), rooms=["1", "2"], users=["5"], tables=["accounts"])
    return folds.sync_page(rows, 500, 100).select("lsn", "kind", "key", "value")


@register("sync_pull_txn_boundary", f"""WITH {LOG}, t AS (SELECT lsn // 7 AS lsn, lsn AS op, key FROM log), n AS (SELECT lsn, count(*) AS n FROM t WHERE lsn > 20 GROUP BY lsn), u AS (SELECT lsn, sum(n) OVER (ORDER BY lsn) AS upto, row_number() OVER (ORDER BY lsn) AS rn FROM n)
 SELECT t.lsn, op, key FROM t JOIN u ON t.lsn = u.lsn WHERE upto <= 50 OR rn = 1""")
def sync_pull_txn_boundary(spark, d):
    rows = m.log(spark, d).select(F.floor(F.col("lsn") / 7).alias("lsn"), F.col("lsn").alias("op"), "key")
    return folds.sync_page(rows, 20, 50)


@register("quorum_acks", f"WITH {LOG}, a AS (SELECT shard, room AS replica, max(lsn) AS acked FROM log GROUP BY 1, 2), h AS (SELECT max(lsn) AS head FROM log) SELECT shard, count(*) FILTER (acked >= head - 200) AS acks, count(*) FILTER (acked >= head - 200) >= 3 AS quorum FROM a, h GROUP BY shard")
def quorum_acks(spark, d):
    log = m.log(spark, d)
    acks = log.groupBy("shard", F.col("room").alias("replica")).agg(F.max("lsn").alias("acked"))
    head = log.agg(F.max("lsn").alias("head"))
    enough = F.count(F.when(F.col("acked") >= F.col("head") - 200, 1))
    return acks.join(F.broadcast(head)).groupBy("shard").agg(enough.alias("acks"), (enough >= 3).alias("quorum"))


def _pages(spark, d):
    log = m.log(spark, d)
    state = lambda at: folds.fold_records(folds.as_of(log, at)).filter("value >= 30")
    return log, page(state(9000), [F.col("key")], 60), page(state(9400), [F.col("key")], 60)


DIFF = f"""{LOG}, s1 AS (SELECT * FROM ops WHERE lsn <= 9000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1), s2 AS (SELECT * FROM ops WHERE lsn <= 9400 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1),
 p1 AS (SELECT key, lsn, value FROM s1 WHERE kind = 'recordUpserted' AND value >= 30 ORDER BY key LIMIT 60), p2 AS (SELECT key, lsn, value FROM s2 WHERE kind = 'recordUpserted' AND value >= 30 ORDER BY key LIMIT 60),
 del AS (SELECT key, max(lsn) AS lsn FROM ops WHERE kind = 'recordDeleted' AND lsn > 9000 AND lsn <= 9400 GROUP BY key)"""


@register("query_diff", f"""WITH {DIFF}, j AS (SELECT coalesce(p1.key, p2.key) AS key, p1.lsn AS l1, p2.lsn AS l2, p1.value AS v1, p2.value AS v2 FROM p1 FULL JOIN p2 ON p1.key = p2.key),
 c AS (SELECT *, CASE WHEN l1 IS NULL THEN 'added' WHEN l2 IS NULL THEN 'removed' WHEN l1 <> l2 OR v1 IS DISTINCT FROM v2 THEN 'updated' END AS change FROM j)
 SELECT c.key, change, change = 'removed' AND del.lsn IS NOT NULL AS deleted, coalesce(l2, CASE WHEN change = 'removed' THEN del.lsn END) AS lsn FROM c LEFT JOIN del ON c.key = del.key WHERE change IS NOT NULL""")
def query_diff(spark, d):
    log, before, after = _pages(spark, d)
    deletes = log.filter("kind = 'recordDeleted' and lsn > 9000 and lsn <= 9400").groupBy("key").agg(F.max("lsn").alias("lsn"))
    return op.query_diff(before, after, deletes)


@register("result_fingerprint", f"WITH {DIFF} SELECT sha256(coalesce(string_agg(key || chr(31) || CAST(lsn AS VARCHAR) || chr(31) || CAST(value AS VARCHAR), chr(30) ORDER BY key), '')) AS result_id, count(*) AS n FROM p2")
def result_fingerprint(spark, d):
    return op.fingerprint(_pages(spark, d)[2])


SUBS = """subs AS (SELECT CAST(c_custkey AS VARCHAR) AS sub_id, 'accounts' AS tbl, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS lower, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) || '~' END AS upper,
 CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) END AS prefix FROM customer WHERE c_custkey % 3 <> 2)"""


def _subscriptions(spark, d):
    key = F.col("c_custkey").cast("string")
    rows = m.table(spark, d, "customer").filter("c_custkey % 3 != 2")
    ranged = F.col("c_custkey") % 3 == 0
    return rows.select(key.alias("sub_id"), F.lit("accounts").alias("tbl"), F.when(ranged, key).alias("lower"), F.when(ranged, F.concat(key, F.lit("~"))).alias("upper"), F.when(~ranged, key).alias("prefix"))


ROUTED = f"WITH {LOG}, {SUBS} SELECT sub_id, lsn, ops.key FROM ops JOIN subs s ON ops.tbl = s.tbl AND (lower IS NULL OR ops.key >= lower) AND (upper IS NULL OR ops.key < upper) AND (prefix IS NULL OR starts_with(ops.key, prefix))"


@register("route_events", ROUTED)
def route_events(spark, d):
    events = m.log(spark, d).filter(F.col("kind").isin(folds.UPSERT, folds.DELETE))
    return op.route_events(events, _subscriptions(spark, d))


@register("route_events_all", ROUTED)
def route_events_all(spark, d):
    """All events to the subscriptions of all customers (two of three have one)."""
    return op.route_events(m.log(spark, d).filter(F.col("kind").isin(folds.UPSERT, folds.DELETE)), _subscriptions(spark, d))


@register("targeted_events", f"WITH {CONNECTIONS} SELECT session_id, array_to_string(list_sort(list_intersect(rooms, ['1', '2', '3'])), ',') AS matched FROM conn WHERE len(list_intersect(rooms, ['1', '2', '3'])) > 0")
def targeted_events(spark, d):
    both = F.array_sort(F.array_intersect("rooms", F.array(*map(F.lit, "123"))))
    return m.connections(spark, d).filter(F.size(both) > 0).select("session_id", F.array_join(both, ",").alias("matched"))


AFFECTED = f"""WITH {LOG}, e AS (SELECT * FROM ops), q AS (SELECT CAST(c_custkey AS VARCHAR) AS query_id, CASE WHEN c_custkey % 2 = 0 THEN 'accounts' ELSE 'rooms' END AS tbl, c_acctbal AS least FROM customer),
 p AS (SELECT CAST(c_custkey AS VARCHAR) AS query_id, CAST(c_custkey * 2 AS VARCHAR) AS key FROM customer)
 SELECT query_id FROM e JOIN q ON e.tbl = q.tbl WHERE kind = 'recordDeleted' OR value >= least UNION SELECT query_id FROM e JOIN p ON e.key = p.key"""


@register("affected_queries", AFFECTED)
def affected_queries(spark, d):
    return _affected(spark, d)


@register("affected_queries_all", AFFECTED)
def affected_queries_all(spark, d):
    """The queries and pages of all customers, over all events."""
    return _affected(spark, d)


def _affected(spark, d):
    events = m.log(spark, d).filter(F.col("kind").isin(folds.UPSERT, folds.DELETE))
    own = m.table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    queries = own.select(key.alias("query_id"), F.when(F.col("c_custkey") % 2 == 0, "accounts").otherwise("rooms").alias("tbl"), F.col("c_acctbal").alias("least"))
    return op.affected_queries(events, queries, own.select(key.alias("query_id"), (F.col("c_custkey") * 2).cast("string").alias("key")))


@register("delivery_filter", f"""WITH {LOG}, {CONNECTIONS}, s AS (SELECT DISTINCT session_id, user_id, unnest(rooms) AS room FROM conn) SELECT session_id, lsn, key FROM ops JOIN s ON s.room = ops.room WHERE (lsn % 3 <> 0 OR session_id = key || '#1') AND (lsn % 2 = 0 OR ops.user_id = s.user_id)""")
def delivery_filter(spark, d):
    """Each event to the sessions that are in its room and may see it."""
    events = m.log(spark, d).filter(F.col("kind").isin(folds.UPSERT, folds.DELETE)).withColumn("tbl", F.col("room"))
    events = events.withColumns({"targets": F.when(F.col("lsn") % 3 == 0, F.array(F.concat("key", F.lit("#1")))), "protected": F.col("lsn") % 2 == 1, "owner": F.col("user_id")})
    sessions = m.connections(spark, d).select("session_id", "user_id", F.explode(F.array_distinct("rooms")).alias("tbl"))
    return op.deliveries(events, sessions)


@register("rls_delete_prev", f"""WITH {LOG}, p AS (SELECT lsn, key, kind, lag(value) OVER (PARTITION BY key ORDER BY lsn) AS prev, lag(kind) OVER (PARTITION BY key ORDER BY lsn) AS prev_kind FROM ops) SELECT lsn, key, prev FROM p WHERE kind = 'recordDeleted' AND prev_kind = 'recordUpserted' AND prev >= 40""")
def rls_delete_prev(spark, d):
    own = Window.partitionBy("key").orderBy("lsn")
    rows = m.log(spark, d).filter(F.col("kind").isin(folds.UPSERT, folds.DELETE))
    rows = rows.withColumns({"prev": F.lag("value").over(own), "prev_kind": F.lag("kind").over(own)})
    return rows.filter("kind = 'recordDeleted' and prev_kind = 'recordUpserted' and prev >= 40").select("lsn", "key", "prev")


@register("channel_members", f"WITH {LOG} SELECT room AS channel, user_id, lsn FROM (SELECT * FROM log WHERE kind IN ('userUpserted', 'userEventPublished') QUALIFY row_number() OVER (PARTITION BY room, user_id ORDER BY lsn DESC) = 1) WHERE kind = 'userUpserted'")
def channel_members(spark, d):
    return folds.pending(m.log(spark, d), ["room", "user_id"], "userUpserted", "userEventPublished").select(F.col("room").alias("channel"), "user_id", "lsn")


@register("channel_sequence", f"WITH {LOG} SELECT room AS channel, lsn, row_number() OVER (PARTITION BY room ORDER BY lsn) AS seq FROM log WHERE kind = 'messageCreated'")
def channel_sequence(spark, d):
    own = Window.partitionBy("channel").orderBy("lsn")
    rows = m.log(spark, d).filter("kind = 'messageCreated'").select(F.col("room").alias("channel"), "lsn")
    return rows.withColumn("seq", F.row_number().over(own).cast("long"))


@register("stale_members", f"WITH {LOG}, {CONNECTIONS} SELECT DISTINCT l.room AS channel, l.user_id, l.user_id || '#' || CAST(lsn % 3 AS VARCHAR) AS session_id FROM log l WHERE kind = 'userUpserted' AND l.user_id || '#' || CAST(lsn % 3 AS VARCHAR) NOT IN (SELECT session_id FROM conn WHERE last_seen_ms > 9500000)")
def stale_members(spark, d):
    members = m.log(spark, d).filter("kind = 'userUpserted'").select(F.col("room").alias("channel"), "user_id", F.concat_ws("#", "user_id", (F.col("lsn") % 3).cast("string")).alias("session_id")).distinct()
    active = m.connections(spark, d).filter("last_seen_ms > 9500000").select("session_id")
    return members.join(active, "session_id", "left_anti").select("channel", "user_id", "session_id")


@register("cache_invalidations", f"WITH {LOG} SELECT key, max(lsn) AS generation, max(lsn) > 9999 AS reset FROM ops WHERE lsn > 9500 GROUP BY key")
def cache_invalidations(spark, d):
    rows = m.log(spark, d).filter(F.col("kind").isin(folds.UPSERT, folds.DELETE) & (F.col("lsn") > 9500))
    return rows.groupBy("key").agg(F.max("lsn").alias("generation"), (F.max("lsn") > 9999).alias("reset"))


@register("cdc_dedupe", f"WITH {LOG} SELECT DISTINCT lsn // 5 AS lsn, tbl, key FROM ops")
def cdc_dedupe(spark, d):
    rows = m.log(spark, d).filter(F.col("kind").isin(folds.UPSERT, folds.DELETE))
    return rows.select(F.floor(F.col("lsn") / 5).alias("lsn"), "tbl", "key").dropDuplicates(["lsn", "tbl", "key"])


@register("cache_trim", f"WITH {LOG} SELECT room, lsn FROM log WHERE kind = 'messageCreated' QUALIFY row_number() OVER (PARTITION BY room ORDER BY lsn DESC) <= 5")
def cache_trim(spark, d):
    return top_per_group(m.log(spark, d).filter("kind = 'messageCreated'"), ["room"], [F.desc("lsn")], 5).select("room", "lsn")


@register("cache_coverage", f"WITH {LOG} SELECT room AS scope, 'messages' AS part, count(*) AS rows, max(lsn) AS cursor FROM log WHERE kind = 'messageCreated' GROUP BY room UNION ALL SELECT tbl, 'records', count(*), max(lsn) FROM folded GROUP BY tbl")
def cache_coverage(spark, d):
    log = m.log(spark, d)
    span = [F.count("*").alias("rows"), F.max("lsn").alias("cursor")]
    messages = log.filter("kind = 'messageCreated'").groupBy(F.col("room").alias("scope"), F.lit("messages").alias("part")).agg(*span)
    return messages.unionByName(folds.fold_records(log).groupBy(F.col("tbl").alias("scope"), F.lit("records").alias("part")).agg(*span))


REPLIES = f"{LOG}, r AS (SELECT key, shard AS endpoint, max(lsn) AS lsn, arg_max(value, lsn) AS value FROM log WHERE kind = 'recordUpserted' GROUP BY key, shard)"


def _replies(spark, d):
    rows = m.log(spark, d).filter("kind = 'recordUpserted'").select("key", F.col("shard").alias("endpoint"), "lsn", "value")
    return latest_by(rows, ["key", "endpoint"], [F.col("lsn")])


@register("quorum_merge", f"WITH {REPLIES} SELECT key, max(lsn) AS lsn, arg_max(value, lsn) AS value, count(DISTINCT endpoint) AS endpoints FROM r WHERE lsn >= 5000 GROUP BY key HAVING count(DISTINCT endpoint) >= 3")
def quorum_merge(spark, d):
    return op.quorum_merge(_replies(spark, d), 3, 5000)


@register("cross_shard_list", f"WITH {REPLIES}, b AS (SELECT key, max(lsn) AS lsn, arg_max(value, lsn) AS value FROM r GROUP BY key) {page_sql('SELECT * FROM b', 'key', 40, 'key, lsn, value')}")
def cross_shard_list(spark, d):
    merged = latest_by(_replies(spark, d).drop("endpoint"), ["key"], [F.col("lsn")])
    return page(merged, [F.col("key")], 40).select("key", "lsn", "value", "has_more")


@register("cross_shard_range", f"WITH {CUSTOMERS} {page_sql('SELECT key, nation, acctbal FROM cust WHERE nation >= 2 AND nation <= 6 AND acctbal >= 0', 'nation, acctbal, key', 45, 'key, nation, acctbal')}")
def cross_shard_range(spark, d):
    from factloom.operators.records import shard_filter

    rows = m.customers(spark, d).filter("acctbal >= 0 and nation between 2 and 6")
    order = [F.col("nation"), F.col("acctbal"), F.col("key")]
    # Each shard gives a page and one row more, so that the merged page knows what follows.
    parts = [shard_filter(rows, "customer", s, 3).orderBy(*order).limit(46) for s in range(3)]
    merged = latest_by(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["key"], [F.col("lsn")])
    return page(merged, order, 45).select("key", "nation", "acctbal", "has_more")


@register("cross_shard_users", f"WITH {LOG} {page_sql('''SELECT user_id AS key, max(lsn) AS lsn, arg_max(value, lsn) AS value FROM log WHERE kind = 'userUpserted' GROUP BY user_id''', 'key', 30, 'key, lsn, value')}")
def cross_shard_users(spark, d):
    rows = m.log(spark, d).filter("kind = 'userUpserted'").select(F.col("user_id").alias("key"), "lsn", "value", "shard")
    per_shard = latest_by(rows, ["key", "shard"], [F.col("lsn")])
    return page(latest_by(per_shard.drop("shard"), ["key"], [F.col("lsn")]), [F.col("key")], 30)
