"""Constraints: unique indexes, optimistic concurrency, idempotency, identity, sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_violations(existing: DataFrame, candidates: DataFrame, fields: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """Index values that more than one key would hold after the batch.

    A key in the batch replaces its stored row; deleted keys free their values.
    """
    gone = candidates.select("key")
    if deleted is not None:
        gone = gone.unionByName(deleted.select("key"))
    rows = existing.join(gone, "key", "left_anti").select("key", *fields).unionByName(candidates.select("key", *fields))
    present = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in fields))
    return rows.filter(present).groupBy(*fields).agg(F.countDistinct("key").alias("keys"), F.min("key").alias("first_key")).filter("keys > 1")


def occ_conflicts(current: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose expected LSN is not the row's (0: must not exist)."""
    have = current.select("key", F.col("lsn").alias("current_lsn"))
    return requests.join(have, "key", "left").withColumn("current_lsn", F.coalesce("current_lsn", F.lit(0))).filter(F.col("expected_lsn") != F.col("current_lsn")).select("key", "expected_lsn", "current_lsn")


def idempotent_replay(log: DataFrame) -> DataFrame:
    """Each mutation id's first fact, how often it came again, and whether its kind changed."""
    return log.groupBy("mutation_id").agg(
        F.min_by(F.struct("lsn", "kind"), "lsn").alias("r"), (F.count("*") - 1).alias("replays"), F.countDistinct("kind").alias("kinds")
    ).select("mutation_id", "r.lsn", "r.kind", "replays", (F.col("kinds") > 1).alias("conflict"))


def identity_violations(records: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows where a present id inside the value is not the key it stands for."""
    wrong = reduce(lambda a, b: a | b, (F.col(inner).isNotNull() & (F.col(inner) != F.col(outer)) for inner, outer in pairs))
    return records.filter(wrong)


def size_violations(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows whose text has more bytes than the limit; 0 disables it."""
    return rows.filter(F.octet_length(column) > limit) if limit else rows.limit(0)


def violation_codes(checks: list[tuple[str, Column]]) -> Column:
    """Array of the codes whose check fails (null fails)."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks)))
