"""Folds over the log: one ordered table of facts, everything else a lazy query over it.

A log row has lsn, shard, kind, ts_ms and the columns of its kind. Folds are aggregates
(``max_by`` on the order of facts), so partial results combine before any shuffle and the
whole log is never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPSERT, DELETE = "recordUpserted", "recordDeleted"


def scan(*logs: DataFrame) -> DataFrame:
    """Union of log files; a fact that several hold counts once, the last file's wins."""
    rows = None
    for rank, log in enumerate(logs):
        log = log.withColumn("file_rank", F.lit(rank))
        rows = log if rows is None else rows.unionByName(log)
    rest = [c for c in rows.columns if c not in ("lsn", "file_rank")]
    return rows.groupBy("lsn").agg(F.max_by(F.struct(*rest), "file_rank").alias("r")).select("lsn", "r.*")


def tail(log: DataFrame, after_lsn: int) -> DataFrame:
    return log.filter(F.col("lsn") > after_lsn)


def as_of(log: DataFrame, lsn: int) -> DataFrame:
    return log.filter(F.col("lsn") <= lsn)


def explode_transactions(log: DataFrame) -> DataFrame:
    """Facts with ``ops`` (array of record operations) become one row an operation, in order."""
    return log.select(*(c for c in log.columns if c != "ops"), F.posexplode("ops").alias("op_index", "op")).select("*", "op.*").drop("op")


def fold_records(log: DataFrame, keys: tuple[str, ...] = ("tbl", "key"), state: bool = False) -> DataFrame:
    """Current rows: the last operation of each key, without those that are deleted.

    ``state`` keeps deleted keys, with their kind.
    """
    rows = log.filter(F.col("kind").isin(UPSERT, DELETE))
    order = [F.col("lsn")] + ([F.col("op_index")] if "op_index" in log.columns else [])
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return last if state else last.filter(F.col("kind") == UPSERT)


def fold_latest(log: DataFrame, kind: str, key: str, columns: list[str]) -> DataFrame:
    rows = log.filter(F.col("kind") == kind)
    best = rows.groupBy(key).agg(F.max_by(F.struct("lsn", *columns), "lsn").alias("r"), F.min("lsn").alias("first_lsn"))
    return best.select(key, "r.*", "first_lsn")


def snapshot_plus_tail(snapshot: DataFrame, log: DataFrame, at: int) -> DataFrame:
    """Snapshot rows (state at ``at``, deleted keys left out) under the facts after it."""
    rows = snapshot.select(*log.columns).unionByName(tail(log, at))
    return fold_records(rows)


def replay_as_of(log: DataFrame, table: str, keys: list[str], lsn: int) -> DataFrame:
    """Each asked key at ``lsn``: exists, deleted or missing, with the fact that says so."""
    spark = log.sparkSession
    asked = spark.createDataFrame([(k,) for k in keys], "key string")
    state = fold_records(as_of(log, lsn).filter((F.col("tbl") == table) & F.col("key").isin(keys)), state=True)
    status = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") == DELETE, "deleted").otherwise("exists")
    return asked.join(state, "key", "left").select("key", status.alias("status"), F.col("lsn").alias("source_lsn"), F.when(F.col("kind") == UPSERT, F.col("value")).alias("value"))


def pending(log: DataFrame, key: list[str], opened: str, *closed: str) -> DataFrame:
    """Keys whose last fact among opened and closed is opened."""
    rows = log.filter(F.col("kind").isin(opened, *closed))
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "lsn").alias("r")).select(*key, "r.*")
    return last.filter(F.col("kind") == opened)


def unanswered(log: DataFrame, key: str, asked: str, answered: str) -> DataFrame:
    return log.filter(F.col("kind") == asked).join(log.filter(F.col("kind") == answered).select(key), key, "left_anti")


def trace(log: DataFrame, **parts: str) -> DataFrame:
    """Facts that touch one entity: any mix of column = value, in log order."""
    rows = log
    for name, value in parts.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def audit(log: DataFrame, kind: str | None = None, room: str | None = None, user: str | None = None, key: str | None = None, mutation: str | None = None) -> DataFrame:
    """Audit filter. ``room`` means messages only and ``user`` published events only."""
    rows = log
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if room is not None:
        rows = rows.filter((F.col("kind") == "messageCreated") & (F.col("room") == room))
    if user is not None:
        rows = rows.filter((F.col("kind") == "userEventPublished") & (F.col("user_id") == user))
    if key is not None:
        rows = rows.filter(F.col("kind").isin(UPSERT, DELETE) & (F.col("key") == key))
    if mutation is not None:
        rows = rows.filter(F.col("mutation_id") == mutation)
    return rows


def integrity(log: DataFrame) -> DataFrame:
    """One row: counts, duplicates (errors) and gaps (warnings) of the whole log."""
    per = log.groupBy("lsn").agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"),
        F.count("*").alias("unique_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
        F.min("lsn").alias("min_lsn"),
        F.max("lsn").alias("max_lsn"),
        F.coalesce(F.max("lsn") - F.min("lsn") + 1 - F.count("*"), F.lit(0)).alias("missing_count"),
    )


def gaps(log: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Stretches of missing LSNs: after_lsn, before_lsn, missing.

    The neighbour of an LSN is found inside a range of ``width`` LSNs, and the ends of the
    ranges among themselves, so no window spans the log.
    """
    lsn = log.select("lsn").distinct().withColumn("part", F.floor(F.col("lsn") / width))
    own = Window.partitionBy("part").orderBy("lsn")
    inner = lsn.withColumn("prev", F.lag("lsn").over(own)).filter("prev is not null")
    ends = lsn.groupBy("part").agg(F.min("lsn").alias("lo"), F.max("lsn").alias("hi"))
    outer = ends.withColumn("prev", F.lag("hi").over(Window.orderBy("part"))).filter("prev is not null").select(F.col("lo").alias("lsn"), "prev")
    both = inner.select("lsn", "prev").unionByName(outer).filter(F.col("lsn") - F.col("prev") > 1)
    return both.select(F.col("prev").alias("after_lsn"), F.col("lsn").alias("before_lsn"), (F.col("lsn") - F.col("prev") - 1).alias("missing"))


def duplicates(log: DataFrame) -> DataFrame:
    return log.groupBy("lsn").agg(F.count("*").alias("copies")).filter("copies > 1")


def file_stats(log: DataFrame, file: str) -> DataFrame:
    return log.groupBy(file).agg(F.count("*").alias("records"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.min("ts_ms").alias("min_ts_ms"), F.max("ts_ms").alias("max_ts_ms"))


def sync_filter(log: DataFrame, rooms: list[str] = (), users: list[str] = (), tables: list[str] = ()) -> DataFrame:
    """Facts of the asked categories; no filter at all means everything."""
    if not (rooms or users or tables):
        return log
    keep = F.lit(False)
    if rooms:
        keep = keep | ((F.col("kind") == "messageCreated") & F.col("room").isin(*rooms))
    if users:
        keep = keep | (F.col("kind").isin("userUpserted", "userEventPublished") & F.col("user_id").isin(*users))
    if tables:
        keep = keep | (F.col("kind").isin(UPSERT, DELETE) & F.col("tbl").isin(*tables))
    return log.filter(keep)


def sync_page(rows: DataFrame, after_lsn: int, limit: int) -> DataFrame:
    """Rows of the next page, never part of a transaction; the first one comes whole.

    Only the first ``limit`` transactions can matter, so the running count is over those.
    """
    rows = tail(rows, after_lsn)
    first = rows.groupBy("lsn").agg(F.count("*").alias("n")).orderBy("lsn").limit(limit)
    order = Window.orderBy("lsn")
    sized = first.withColumns({"upto": F.sum("n").over(order), "rn": F.row_number().over(order)})
    return rows.join(F.broadcast(sized.filter((F.col("rn") == 1) | (F.col("upto") <= limit)).select("lsn")), "lsn")


def running_by_key(log: DataFrame, key: str, value: Column) -> DataFrame:
    """value and its predecessor for each fact of a key."""
    own = Window.partitionBy("tbl", key).orderBy("lsn")
    return log.withColumn("now", value).withColumn("before", F.lag("now").over(own))


def running_total(deltas: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Running sum of (lsn, delta) in log order, in two levels: sums of ranges of LSNs
    first, then inside each range; no window holds the whole log."""
    parts = deltas.withColumn("part", F.floor(F.col("lsn") / width))
    before = parts.groupBy("part").agg(F.sum("delta").alias("s"))
    before = before.withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    own = Window.partitionBy("part").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(before, "part").withColumn("total", F.col("base") + F.sum("delta").over(own)).drop("part", "base")
