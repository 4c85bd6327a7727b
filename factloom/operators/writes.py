"""Writes as plans: transactions, batches, command checks and checksums over rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.hashing import child_mutation_id, record_shard_key, shard_index

TRANSACTION_OPS, BATCH_OPS = 500, 5000


def transaction_issues(ops: DataFrame, shards: int) -> DataFrame:
    """txn, ops and the rules each transaction breaks: size, one shard, each key once, durable.

    ops: txn, tbl, key, durability.
    """
    shard = shard_index(record_shard_key(F.col("tbl"), F.col("key")), shards)
    per = ops.groupBy("txn").agg(
        F.count("*").alias("ops"),
        F.countDistinct(shard).alias("shards"),
        F.countDistinct("tbl", "key").alias("keys"),
        F.max((F.col("durability") == "volatile").cast("int")).alias("volatile"),
    )
    rules = [("tooManyOps", F.col("ops") > TRANSACTION_OPS), ("manyShards", F.col("shards") > 1), ("keyTwice", F.col("keys") < F.col("ops")), ("volatile", F.col("volatile") == 1)]
    return per.select("txn", "ops", F.array_join(F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in rules))), ",").alias("issues"))


def split_batch(ops: DataFrame, shards: int, chunk: int = TRANSACTION_OPS) -> DataFrame:
    """ops (batch, position, tbl, key, mutation_id) with shard, chunk and child mutation id.

    Rows of a batch go by shard and then in chunks of at most ``chunk`` in their order; the
    windows are over one shard of one batch, which has at most ``BATCH_OPS`` rows.
    """
    shard = shard_index(record_shard_key(F.col("tbl"), F.col("key")), shards)
    own = Window.partitionBy("batch", "shard").orderBy("position")
    rows = ops.withColumn("shard", shard).withColumn("chunk", F.floor((F.row_number().over(own) - 1) / chunk))
    return rows.withColumn("child_id", child_mutation_id(F.col("mutation_id"), F.col("shard").cast("int") * 100 + F.col("chunk").cast("int"), F.lit("records")))


def seal(log: DataFrame, columns: list[str], checksum: str = "checksum") -> DataFrame:
    """Fills missing checksums from the canonical JSON of the row."""
    made = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return log.withColumn(checksum, F.coalesce(F.col(checksum), made))


def broken_seals(log: DataFrame, columns: list[str], checksum: str = "checksum") -> DataFrame:
    fresh = seal(log.withColumn("__was", F.col(checksum)).withColumn(checksum, F.lit(None).cast("string")), columns, checksum)
    return fresh.filter(F.col("__was").isNotNull() & (F.col("__was") != F.col(checksum))).select("lsn")


def read_at(log: DataFrame, min_lsn: int | None = None) -> DataFrame:
    """The log for a read at a level: with ``min_lsn`` the snapshot must have reached it."""
    if min_lsn is not None and (log.agg(F.max("lsn")).first()[0] or 0) < min_lsn:
        raise TimeoutError(f"the snapshot has not reached LSN {min_lsn}")
    return log


def deep_search(value: Column, needle: str) -> Column:
    """Whether a JSON text holds a string value equal to ``needle`` at any depth."""
    quoted = needle.replace("\\", "\\\\").replace('"', '\\"')
    return F.to_json(F.parse_json(value)).rlike(r'(^|[:,\[])"' + "".join("\\" + c if not c.isalnum() else c for c in quoted) + r'"([,\]}]|$)')
