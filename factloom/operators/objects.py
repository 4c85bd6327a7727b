"""Objects: references, garbage collection, byte ranges, backup chains."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reference_index(sources: DataFrame) -> DataFrame:
    """object_id -> number and sorted list of sources (source, refs array)."""
    return sources.select("source", F.explode("refs").alias("object_id")).groupBy("object_id").agg(F.countDistinct("source").alias("ref_count"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def dangling(sources: DataFrame, objects: DataFrame) -> DataFrame:
    refs = sources.select("source", F.explode("refs").alias("object_id"))
    return refs.join(objects.select("object_id"), "object_id", "left_anti")


def resolve_attachments(messages: DataFrame, objects: DataFrame) -> DataFrame:
    """Attachments by position, repeated ids once (at their first position), with metadata."""
    ids = messages.select("id", F.posexplode(F.array_distinct("attachments")).alias("position", "object_id"))
    return ids.join(objects, "object_id", "left").select("id", F.col("position").cast("long").alias("position"), "object_id", "byte_size", F.col("byte_size").isNull().alias("missing"))


def gc_classify(objects: DataFrame, refs: DataFrame, now_ms: int, grace_ms: int, force: bool = False) -> DataFrame:
    """retained (referenced), protected (young) or deleted; a decision table only."""
    used = refs.select("object_id").distinct().withColumn("used", F.lit(True))
    young = F.lit(False) if force else (F.lit(now_ms) - F.col("created_at_ms") < grace_ms)
    decision = F.when(F.col("used"), "retained").when(young, "protected").otherwise("deleted")
    return objects.join(used, "object_id", "left").select("object_id", "byte_size", decision.alias("decision"))


def parse_range(header: str, size: int) -> tuple[int, int] | None:
    """``bytes=a-b``, ``a-`` or ``-n`` as (start, length); None if it cannot be met."""
    m = re.fullmatch(r"bytes=(\d*)-(\d*)", header.strip())
    if not m or not (m[1] or m[2]):
        return None
    if not m[1]:
        n = min(int(m[2]), size)
        return (size - n, n) if n else None
    start, end = int(m[1]), min(int(m[2]), size - 1) if m[2] else size - 1
    return (start, end - start + 1) if start <= end and start < size else None


def body_range(content: Column, start: Column, length: Column) -> Column:
    """Bytes of a binary column."""
    return F.substring(content, start + 1, length)


def touched_since(log: DataFrame, base_lsn: int) -> DataFrame:
    """Objects whose last fact is a commit; with a base, only those with a fact after it."""
    last = log.groupBy("object_id").agg(F.max_by(F.struct("kind", "lsn"), "lsn").alias("r"))
    return last.filter((F.col("r.kind") == "objectCommitted") & (F.col("r.lsn") > base_lsn)).select("object_id", F.col("r.lsn").alias("lsn"))


def backup_retention(bundles: DataFrame, keep_last: int, newer_than_ms: int) -> DataFrame:
    """keep if among the last ones, young enough, or part of a kept bundle's chain."""
    ranked = bundles.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("created_at_ms"), F.desc("bundle_id"))))
    own = (F.col("rn") <= keep_last) | (F.col("created_at_ms") >= newer_than_ms)
    kept = ranked.withColumn("own", own)
    chain = kept.filter("own").select(F.explode("chain").alias("bundle_id")).distinct().withColumn("linked", F.lit(True))
    decision = F.when(F.col("own"), "keep").when(F.col("linked"), "chain").otherwise("delete")
    return kept.join(chain, "bundle_id", "left").select("bundle_id", decision.alias("decision"))


def verify_chain(bundles: DataFrame) -> DataFrame:
    """Each bundle's base must be its predecessor's end; the first one must be full."""
    order = Window.partitionBy("chain_id").orderBy("position")
    before = F.lag("current_lsn").over(order)
    ok = F.when(F.row_number().over(order) == 1, F.col("base_lsn") == 0).otherwise(F.col("base_lsn") == before)
    return bundles.select("chain_id", "position", F.coalesce(ok, F.lit(False)).alias("continuous"))


def latest_chain(bundles: DataFrame) -> list[str]:
    """From each good full bundle the longest reach by greatest increments; the farthest wins,
    then the full bundle that ends lowest.

    Bundles are control-plane rows (one a backup). Spark picks the one increment that goes on
    from an LSN; the driver walks these, each once: increments only lead upwards, so where an
    LSN leads to is known once all above it are.
    """
    good = bundles.filter("ok and current_lsn is not null")
    last = F.max(F.struct("current_lsn", "bundle_id")).alias("r")
    onward = good.filter("base_lsn > 0 and current_lsn > base_lsn").groupBy("base_lsn").agg(last).select("base_lsn", "r.*")
    # Of full bundles that end alike, the least name.
    fulls = good.filter("base_lsn = 0").groupBy("current_lsn").agg(F.min("bundle_id").alias("bundle_id"))
    goes_on = {base: (lsn, name) for base, lsn, name in onward.collect()}
    end: dict[int, int] = {}
    for base in sorted(goes_on, reverse=True):
        lsn = goes_on[base][0]
        end[base] = end.get(lsn, lsn)
    best = min(fulls.collect(), key=lambda r: (-end.get(r["current_lsn"], r["current_lsn"]), r["current_lsn"]), default=None)
    if best is None:
        return []
    lsn, chain = best["current_lsn"], [best["bundle_id"]]
    while lsn in goes_on:
        lsn, name = goes_on[lsn]
        chain.append(name)
    return chain
