"""The given tables read as the engine's model, and the same in SQL for the oracles."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 4


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that the executors see too: below the session's checkpoint folder. Only a
    local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/query-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="factloom-query-")


def streamed(spark: SparkSession, rows: DataFrame, build, schema: str) -> DataFrame:
    """What a stream over ``rows``, as files of three ranges of LSNs, sends in update mode."""
    from factloom.streaming import live_tables as st

    path = scratch(spark)
    rows.repartitionByRange(3, "lsn").write.parquet(f"{path}/log")
    out = build(st.read_log_stream(spark, f"{path}/log", rows.schema, 3))
    st.run_available(out, lambda b, n: b.write.mode("overwrite").parquet(f"{path}/deltas/{n}"), f"{path}/checkpoint", "update")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/deltas")


def customers(spark, d) -> DataFrame:
    """Top-level record table with indexes on segment and on (nation, acctbal)."""
    t = table(spark, d, "customer")
    return t.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") + 1).alias("lsn"), (F.col("c_custkey") * 10).alias("updated_at_ms"))


CUSTOMERS = """cust AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS acctbal,
 c_mktsegment AS segment, c_custkey + 1 AS lsn, c_custkey * 10 AS updated_at_ms FROM customer)"""


def live_customers(spark, d) -> DataFrame:
    """Live overlay: every tenth customer with another balance and a later LSN."""
    return customers(spark, d).filter((F.col("lsn") - 1) % 10 == 0).withColumns({"acctbal": F.round(F.col("acctbal") + 1000, 2), "lsn": F.col("lsn") + 1_000_000})


def dead_customers(spark, d) -> DataFrame:
    return customers(spark, d).filter((F.col("lsn") - 1) % 25 == 3).select("key")


OVERLAY = CUSTOMERS + """, live AS (SELECT key, name, nation, round(acctbal + 1000, 2) AS acctbal, segment, lsn + 1000000 AS lsn, updated_at_ms FROM cust WHERE (lsn - 1) % 10 = 0),
 dead AS (SELECT key FROM cust WHERE (lsn - 1) % 25 = 3),
 merged AS (SELECT * FROM cust WHERE key NOT IN (SELECT key FROM live UNION ALL SELECT key FROM dead) UNION ALL SELECT * FROM live)"""


def log(spark, d) -> DataFrame:
    """The event log: one fact an event, in the order of its id."""
    kind = F.create_map(*map(F.lit, ["purchase", "recordUpserted", "error", "recordDeleted", "signup", "userUpserted", "view", "messageCreated", "click", "userEventPublished"]))
    t = table(spark, d, "events")
    return t.select(
        (F.col("event_id") + 1).alias("lsn"),
        (F.col("event_id") % SHARDS).alias("shard"),
        kind[F.col("event_type")].alias("kind"),
        F.when(F.col("user_id") % 4 == 3, "orders").otherwise("accounts").alias("tbl"),
        F.col("user_id").cast("string").alias("key"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.col("user_id") % 16).cast("string").alias("room"),
        "value",
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_ms"),
        "props",
        F.concat(F.lit("m"), ((F.col("event_id") * 7) % 5000).cast("string")).alias("mutation_id"),
        F.floor(F.col("event_id") / 1000).alias("file"),
    )


LOG = """log AS (SELECT event_id + 1 AS lsn, event_id % 4 AS shard,
 CASE event_type WHEN 'purchase' THEN 'recordUpserted' WHEN 'error' THEN 'recordDeleted' WHEN 'signup' THEN 'userUpserted' WHEN 'view' THEN 'messageCreated' WHEN 'click' THEN 'userEventPublished' END AS kind,
 CASE WHEN user_id % 4 = 3 THEN 'orders' ELSE 'accounts' END AS tbl, CAST(user_id AS VARCHAR) AS key, CAST(user_id AS VARCHAR) AS user_id, CAST(user_id % 16 AS VARCHAR) AS room, value,
 epoch_us(ts) // 1000 AS ts_ms, props, 'm' || CAST((event_id * 7) % 5000 AS VARCHAR) AS mutation_id, event_id // 1000 AS file FROM events),
 ops AS (SELECT * FROM log WHERE kind IN ('recordUpserted', 'recordDeleted')),
 laststate AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY tbl, key ORDER BY lsn DESC) = 1),
 folded AS (SELECT * FROM laststate WHERE kind = 'recordUpserted')"""


def messages(spark, d) -> DataFrame:
    """Nested table rooms.messages: parent is the room, nested key the turn."""
    t = table(spark, d, "conversations")
    return t.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.col("conv_id").cast("string").alias("room"),
        F.col("conv_id").cast("string").alias("parent_key"),
        F.col("turn").cast("string").alias("nested_key"),
        F.col("role").alias("sender"),
        F.octet_length("text").cast("long").alias("body_bytes"),
        (F.col("turn") * 1000 + F.col("conv_id") % 7).alias("created_at_ms"),
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("lsn"),
    )


MESSAGES = """msg AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS key,
 CAST(conv_id AS VARCHAR) AS room, CAST(conv_id AS VARCHAR) AS parent_key, CAST(turn AS VARCHAR) AS nested_key, role AS sender,
 CAST(strlen(text) AS BIGINT) AS body_bytes, turn * 1000 + conv_id % 7 AS created_at_ms, conv_id * 1000 + turn + 1 AS lsn FROM conversations)"""


def objects(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").cast("string").alias("object_id"), F.octet_length("text").cast("long").alias("byte_size"), (F.col("doc_id") * 1000).alias("created_at_ms"), F.col("lang").alias("content_type"))


OBJECTS = """obj AS (SELECT CAST(doc_id AS VARCHAR) AS object_id, CAST(strlen(text) AS BIGINT) AS byte_size, doc_id * 1000 AS created_at_ms, lang AS content_type FROM documents)"""


def sources(spark, d) -> DataFrame:
    """Rows that refer to objects: each label names its document and one that may not exist."""
    t = table(spark, d, "labels")
    return t.select(F.concat(F.lit("label:"), F.col("doc_id").cast("string")).alias("source"), F.array(F.col("doc_id").cast("string"), (F.col("doc_id") * 3).cast("string"), F.col("doc_id").cast("string")).alias("refs"))


SOURCES = """src AS (SELECT 'label:' || CAST(doc_id AS VARCHAR) AS source, [CAST(doc_id AS VARCHAR), CAST(doc_id * 3 AS VARCHAR), CAST(doc_id AS VARCHAR)] AS refs FROM labels),
 refs AS (SELECT source, unnest(refs) AS object_id FROM src)"""


def connections(spark, d) -> DataFrame:
    """Sessions: the last event of each (user, event_id % 3)."""
    t = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("#", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias("session_id"),
        "event_id", "event_type",
    )
    last = t.groupBy("session_id", "user_id").agg(F.max("event_id").alias("e"))
    return last.select(
        "session_id", "user_id",
        F.when(F.col("e") % 3 == 0, "ws").when(F.col("e") % 3 == 1, "sse").otherwise("poll").alias("transport"),
        F.array((F.col("e") % 5).cast("string"), (F.col("e") % 7).cast("string")).alias("rooms"),
        F.create_map(F.lit("accounts"), F.col("e") % 4, F.lit("rooms"), F.col("e") % 3).alias("counts"),
        (F.col("e") * 1000).alias("last_seen_ms"),
    )


CONNECTIONS = """conn AS (SELECT session_id, user_id, CASE e % 3 WHEN 0 THEN 'ws' WHEN 1 THEN 'sse' ELSE 'poll' END AS transport,
 [CAST(e % 5 AS VARCHAR), CAST(e % 7 AS VARCHAR)] AS rooms, e % 4 AS n_accounts, e % 3 AS n_rooms, e * 1000 AS last_seen_ms
 FROM (SELECT CAST(user_id AS VARCHAR) || '#' || CAST(event_id % 3 AS VARCHAR) AS session_id, CAST(user_id AS VARCHAR) AS user_id, max(event_id) AS e FROM events GROUP BY 1, 2))"""


def page_sql(inner: str, order: str, n: int, columns: str = "*") -> str:
    return f"SELECT {columns}, __n > {n} AS has_more FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS __rn, count(*) OVER () AS __n FROM ({inner})) WHERE __rn <= {n}"


SHARD = "(('0x' || substr(sha256({}), 1, 16))::UBIGINT % {})::BIGINT"
