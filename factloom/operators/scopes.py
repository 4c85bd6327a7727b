"""Scopes: splitting what is too large, and which ones have no subscriber left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.hashing import shard_index


def split_scopes(rows: DataFrame, most_rows: int, children: int, rounds: int = 32) -> DataFrame:
    """Rows of scopes beyond ``most_rows`` move to child scopes, round by round.

    Only the list of oversize scopes decides whether another round is needed; a round is a
    count by scope and a join with that short list.
    """
    for _ in range(rounds):
        big = rows.groupBy("scope").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).select("scope", F.lit(True).alias("big"))
        child = F.concat_ws("/", "scope", shard_index(F.concat_ws(":", "scope", "key"), children).cast("string"))
        rows = rows.join(big, "scope", "left").withColumn("scope", F.when(F.col("big"), child).otherwise(F.col("scope"))).drop("big")
        if rounds > 1 and not rows.groupBy("scope").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).limit(1).count():
            break
    return rows


def residency(changes: DataFrame, now: DataFrame, linger: int) -> DataFrame:
    """changes (scope, lsn, delta) -> subscribers, last change, and whether it may go."""
    per = changes.groupBy("scope").agg(F.sum("delta").cast("long").alias("subscribers"), F.max("lsn").alias("last_lsn"))
    idle = (F.col("subscribers") <= 0) & (F.col("last_lsn") < F.col("now") - linger)
    return per.join(F.broadcast(now)).select("scope", "subscribers", "last_lsn", idle.alias("idle"))
