"""Counts, sums, presence and the summaries of manifests and connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.log import DELETE, UPSERT, running_by_key, running_total


def table_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("tbl").agg(F.count("*").alias("n"))


def table_sum(records: DataFrame, field: str) -> DataFrame:
    """Sum of a numeric field; what is missing or no number counts nothing, no rows give 0."""
    number = F.col(field) if records.schema[field].dataType.typeName() in ("double", "bigint", "long", "integer") else F.try_variant_get(field, "$", "double")
    return records.agg(F.coalesce(F.sum(number.cast("decimal(20,2)")), F.lit(0)).cast("double").alias("total"))


def count_updates(log: DataFrame) -> DataFrame:
    """lsn, total: the number of live keys after each fact that changes the set of keys."""
    rows = running_by_key(log.filter(F.col("kind").isin(UPSERT, DELETE)), "key", (F.col("kind") == UPSERT).cast("int"))
    delta = F.col("now") - F.coalesce("before", F.lit(0))
    return running_total(rows.select("lsn", delta.cast("long").alias("delta")).filter("delta != 0")).select("lsn", "total")


def sum_updates(log: DataFrame, value: Column) -> DataFrame:
    """lsn, total: the sum over live keys after each fact that changes it."""
    amount = F.when(F.col("kind") == UPSERT, F.coalesce(value, F.lit(0))).otherwise(F.lit(0)).cast("decimal(20,2)")
    rows = running_by_key(log.filter(F.col("kind").isin(UPSERT, DELETE)), "key", amount)
    delta = F.col("now") - F.coalesce("before", F.lit(0).cast("decimal(20,2)"))
    totals = running_total(rows.select("lsn", delta.alias("delta")).filter("delta != 0"))
    return totals.select("lsn", F.col("total").cast("double").alias("total"))


def presence(members: DataFrame, channel: str = "channel") -> DataFrame:
    return members.groupBy(channel).agg(F.count("*").alias("members"), F.countDistinct("user_id").alias("users"))


def manifest(log: DataFrame, by: str, kinds: list[str] | None = None) -> DataFrame:
    rows = log if kinds is None else log.filter(F.col("kind").isin(*kinds))
    return rows.groupBy(by).agg(F.count("*").alias("records"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"))


def connection_totals(connections: DataFrame, transports: list[str]) -> DataFrame:
    return connections.agg(
        F.count("*").alias("sessions"),
        F.countDistinct("user_id").alias("users"),
        *(F.count(F.when(F.col("transport") == t, 1)).alias(f"n_{t}") for t in transports),
    )


def connection_users(connections: DataFrame) -> DataFrame:
    """Per user: sessions, sorted sets of transports and rooms, summed counts by table."""
    flat = connections.groupBy("user_id").agg(
        F.count("*").alias("sessions"),
        F.array_join(F.array_sort(F.collect_set("transport")), ",").alias("transports"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("rooms")))), ",").alias("rooms"),
        F.max("last_seen_ms").alias("last_seen_ms"),
    )
    counts = connections.select("user_id", F.explode("counts").alias("tbl", "n")).groupBy("user_id", "tbl").agg(F.sum("n").alias("n"))
    maps = counts.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "tbl", F.col("n").cast("string")))), ",").alias("counts"))
    return flat.join(maps, "user_id", "left")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group (Spark cuts groups before the shuffle)."""
    own = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(own)).filter(F.col("rn") <= n)


def room_status(messages: DataFrame) -> DataFrame:
    durable = F.when(F.col("lsn") > 0, F.col("lsn"))
    return messages.groupBy("room").agg(F.count("*").alias("messages"), F.min(durable).alias("first_lsn"), F.max(durable).alias("last_lsn"))
