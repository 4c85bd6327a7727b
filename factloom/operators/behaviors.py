"""Behaviors: declared Python functions over a read plan, whose commands become log rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.hashing import child_mutation_id

#: What a behavior may read.
READS = ("records", "nestedRecords", "latestMessages", "objects", "objectBodies", "realtimeChannelMembers", "realtimeChannelStates", "connectionSessions", "auditTraces", "auditReplays")
#: What a behavior may return, and the kind of row each command becomes.
DURABLE = {
    "sendMessage": "messageCreated",
    "publishUserEvent": "userEventPublished",
    "putObject": "objectCommitted",
    "deleteObject": "objectDeleted",
    "upsertRecord": "recordUpserted",
    "deleteRecord": "recordDeleted",
    "recordTransaction": "recordTransaction",
    "scheduleActorReminder": "reminderScheduled",
    "requestHostHttp": "httpRequested",
}
#: Effects on running sessions and caches: they get no LSN and no fold sees them.
VOLATILE = (
    "publishVolatile",
    "publishUserVolatile",
    "broadcastRealtimeChannel",
    "updateRealtimeChannelState",
    "updateRealtimePresence",
    "disconnectConnections",
    "activateRuntimeRecords",
    "evictRuntimeRecords",
    "activateRuntimeRoom",
    "evictRuntimeRoom",
)
COMMANDS = DURABLE | {c: c for c in VOLATILE}
MAX_DEPTH = 32
REGISTRY: dict[str, Behavior] = {}


@dataclass
class Behavior:
    name: str
    fn: Callable[[dict], list[dict]]
    reads: list[str] = field(default_factory=list)
    commands: list[str] = field(default_factory=list)

    def issues(self) -> list[str]:
        bad = [f"unknown read {r}" for r in self.reads if r.split(":")[0] not in READS]
        return bad + [f"unknown command {c}" for c in self.commands if c.split(":")[0] not in COMMANDS and c != "*"]


def behavior(name: str, reads: list[str] = (), commands: list[str] = ()):
    """Decorator: registers ``fn(context) -> commands`` with what it may read and do."""

    def add(fn):
        made = Behavior(name, fn, list(reads), list(commands))
        if found := made.issues():
            raise ValueError(f"{name}: {found}")
        REGISTRY[name] = made
        return fn

    return add


def command(kind: str, target: str = "", value=None, **more) -> dict:
    """A command as behaviors return it."""
    if kind not in COMMANDS:
        raise ValueError(f"unknown command {kind}")
    return {"kind": kind, "target": target, "value": value, **more}


def allowed(scopes: list[str], kind: str, target: str) -> bool:
    """``kind:target`` exactly, ``kind`` or ``*`` for all, a trailing ``*`` for a prefix."""
    want = f"{kind}:{target}"
    return any(s in ("*", kind, want) or (s.endswith("*") and want.startswith(s[:-1])) for s in scopes)


def hydrate(requests: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """requests (id, kind, target, limit) and a source (target, position, item) for each kind
    -> id, kind, target, n, items: the first ``limit`` items of each, in order of position.

    Each kind is one join on its target; groups are cut to their limit before anything is
    collected, so a target with any number of items costs a bounded array.
    """
    out = None
    for kind in READS:
        if kind not in sources:
            continue
        own = requests.filter(F.col("kind") == kind)
        wanted = own.groupBy("target").agg(F.max("limit").alias("most"))
        turn = F.row_number().over(Window.partitionBy("target").orderBy("position", "item"))
        held = sources[kind].join(wanted, "target").withColumn("turn", turn).filter(F.col("turn") <= F.col("most"))
        packed = held.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("turn", "item"))).alias("held"))
        items = F.transform(F.slice(F.coalesce("held", F.array().cast("array<struct<turn:int,item:string>>")), F.lit(1), F.col("limit").cast("int")), lambda x: x["item"])
        done = own.join(packed, "target", "left").select("id", "kind", "target", items.alias("items"))
        out = done if out is None else out.unionByName(done)
    return out.select("id", "kind", "target", F.size("items").cast("long").alias("n"), "items")


def with_context(invocations: DataFrame, runtime: str, behavior: str, *values: str) -> DataFrame:
    """invocations (mutation_id, lsn, user_id, ts_ms, ...) with ``context``: the named values
    and what a behavior may know of its call. Nothing in it depends on when or where it runs:
    the time is the fact's, the seed a hash of the call."""
    user = F.col("user_id").isNotNull()
    sender = F.struct(F.when(user, "user").otherwise("system").alias("kind"), F.col("user_id").alias("userId"), F.lit(behavior).alias("behavior"), F.col("mutation_id").alias("clientMutationId"))
    seed = F.sha2(F.concat_ws("|", F.lit(runtime), F.lit(behavior), F.col("mutation_id"), F.coalesce("user_id", F.lit("")), F.col("ts_ms").cast("string")), 256)
    ctx = F.struct(sender.alias("sender"), F.col("ts_ms").alias("timestampMs"), seed.alias("rngSeed"))
    return invocations.withColumn("context", F.to_json(F.struct(*values, ctx.alias("ctx"))))


def continuation_issue(behavior: Column, mutation: Column, now_ms: Column, deadline_ms: Column, call_depth: Column, max_depth: Column, path: Column) -> Column:
    """Why a continuation may not run (deadline, depth, cycle); null if it may."""
    most = F.greatest(F.coalesce(max_depth, F.lit(MAX_DEPTH)), F.lit(1))
    target = F.concat_ws(".", behavior, mutation)
    cycle = F.coalesce(F.array_contains(path, target), F.lit(False))
    return F.when(now_ms > deadline_ms, "deadline").when(F.coalesce(call_depth, F.lit(0)) >= most, "depth").when(cycle, "cycle")


def invoke(name: str, contexts: DataFrame) -> DataFrame:
    """contexts (mutation_id, lsn, context JSON) -> rows of the commands, in order.

    A transaction's operations are rows of one op_index, numbered by ``part``. Rows of volatile
    commands are not durable. A command outside the declared scopes fails the invocation: it
    gives one row of kind ``behaviorRejected``.
    """
    made = REGISTRY[name]
    fn, scopes = made.fn, made.commands

    def rows_of(commands):
        for i, c in enumerate(commands):
            if c["kind"] == "recordTransaction":
                for part, op in enumerate(c["value"]):
                    yield i, part, COMMANDS[op["kind"]], op.get("target", ""), json.dumps(op.get("value")), True
            else:
                yield i, 0, COMMANDS[c["kind"]], c.get("target", ""), json.dumps(c.get("value")), c["kind"] in DURABLE

    def inner(commands):
        for c in commands:
            yield c
            if c["kind"] == "recordTransaction":
                yield from c["value"]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                commands = fn(json.loads(row.context))
                bad = [c for c in inner(commands) if not allowed(scopes, c["kind"], c.get("target", ""))]
                if bad:
                    out.append((row.mutation_id, row.lsn, 0, 0, "behaviorRejected", bad[0]["kind"], None, False))
                else:
                    out += [(row.mutation_id, row.lsn, *x) for x in rows_of(commands)]
            yield pd.DataFrame(out, columns=["mutation_id", "lsn", "op_index", "part", "kind", "key", "value", "durable"])

    rows = contexts.mapInPandas(run, "mutation_id string, lsn long, op_index int, part int, kind string, key string, value string, durable boolean")
    return rows.withColumn("child_id", child_mutation_id(F.col("mutation_id"), F.col("op_index"), F.col("kind")))
