"""Stored logs and projections: group commits, runs of folded facts, rebuilds, compaction,
retention, and restore from bundles.

Everything is a folder of Parquet tables under a shared root. A table that a broken-off job
left behind is overwritten by the next try; what readers see changes by one small pointer
file at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import log as folds
from factloom.operators.commands import numbered


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_pointer(spark: SparkSession, path: str, value: str) -> None:
    """Replaces a small text file as a whole: written aside, then renamed over the old one."""
    fs, aside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(value.encode()))
    out.close()
    _, where = _fs(spark, path)
    if fs.exists(where):
        fs.delete(where, False)
    fs.rename(aside, where)


def read_pointer(spark: SparkSession, path: str) -> str | None:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


# --- group commit -----------------------------------------------------------------------


def group_commit(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: each micro-batch of commands (position, ...) becomes one run of
    facts with the LSNs that follow the head. A batch that runs again gets the same head and
    overwrites its own facts only."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        head = spark.read.parquet(f"{path}/heads/{number - 1}").first()[0] if number else 0
        facts = numbered(batch, "position", head)
        facts.write.mode("overwrite").parquet(f"{path}/facts/{number}")
        done = spark.read.schema(facts.schema).parquet(f"{path}/facts/{number}").agg(F.coalesce(F.max("lsn"), F.lit(head)).alias("head"))
        done.write.mode("overwrite").parquet(f"{path}/heads/{number}")

    return append


def committed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/facts")


# --- projection as runs -------------------------------------------------------------------


def runs_after(batches: int) -> list[tuple[int, int]]:
    """(first batch, number of batches) of the stored runs after so many batches: sizes are the
    powers of two that make up the number, largest first."""
    out, lo = [], 0
    for bit in reversed(range(batches.bit_length())):
        if batches >> bit & 1:
            out.append((lo, 1 << bit))
            lo += 1 << bit
    return out


def fold_runs(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: folds a micro-batch into a logarithmic family of folded runs.

    Batch n is folded with the runs it completes a power of two with, and nothing else is
    read or written: a row is rewritten O(log batches) times, and never the whole state for
    every batch. Deleted keys stay as tombstones, so that a late duplicate cannot revive them.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch
        before, (lo, size) = runs_after(number), runs_after(number + 1)[-1]
        for a, n in before:
            if a >= lo:
                rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/{a}-{n}"))
        folds.fold_records(rows, state=True).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{lo}-{size}")

    return apply


def folded_runs(spark: SparkSession, path: str, batches: int, state: bool = False) -> DataFrame:
    """Current rows over the runs of so many batches."""
    paths = [f"{path}/{a}-{n}" for a, n in runs_after(batches)]
    return folds.fold_records(spark.read.parquet(*paths), state=state)


# --- projection rebuild -------------------------------------------------------------------


class RebuildError(ValueError):
    pass


def rebuild_issues(log: DataFrame, rows: DataFrame) -> list[str]:
    """Differences between a staged projection and the log it was made from."""
    ops = log.filter(F.col("kind").isin(folds.UPSERT, folds.DELETE))
    last = ops.groupBy("tbl", "key").agg(F.max("lsn").alias("lsn"), F.max_by("kind", "lsn").alias("kind"))
    both = last.join(rows.select("tbl", "key", F.col("lsn").alias("r_lsn")), ["tbl", "key"], "full_outer")
    alive = F.coalesce(F.col("kind") == folds.UPSERT, F.lit(False))
    bad = both.agg(
        F.count(F.when(alive & F.col("r_lsn").isNull(), 1)).alias("missing"),
        F.count(F.when(~alive & F.col("r_lsn").isNotNull(), 1)).alias("dead"),
        F.count(F.when(alive & (F.col("r_lsn") != F.col("lsn")), 1)).alias("stale"),
        F.count("*").alias("n"),
        F.countDistinct("tbl", "key").alias("keys"),
    ).first()
    found = [f"{bad[k]} {k} rows" for k in ("missing", "dead", "stale") if bad[k]]
    return found + (["keys repeat"] if bad["n"] != bad["keys"] else [])


def rebuild(log: DataFrame, root: str, valid: Column | None = None) -> str:
    """Folds the log into a new generation, validates it and lets readers have it.

    Readers keep the old generation until the pointer moves; a rebuild that fails its
    validation raises and leaves it where it was.
    """
    spark, name = log.sparkSession, uuid.uuid4().hex
    folds.fold_records(log).write.parquet(f"{root}/{name}")
    rows = spark.read.parquet(f"{root}/{name}")
    found = rebuild_issues(log, rows)
    if valid is not None and (n := rows.filter(~F.coalesce(valid, F.lit(False))).count()):
        found.append(f"{n} rows break the schema")
    if found:
        raise RebuildError("; ".join(found))
    write_pointer(spark, f"{root}/CURRENT", name)
    return name


def projection(spark: SparkSession, root: str) -> DataFrame:
    """The generation that readers have."""
    name = read_pointer(spark, f"{root}/CURRENT")
    if name is None:
        raise FileNotFoundError(f"no projection under {root}")
    return spark.read.parquet(f"{root}/{name}")


# --- compaction and retention ---------------------------------------------------------------


def compact(log: DataFrame, root: str, snapshot_lsn: int, last: int = 0) -> DataFrame:
    """Moves facts up to the snapshot into archive files by shard; shard, archived, retained.

    Without a snapshot nothing may go, and what an earlier compaction reached moves nothing.
    """
    if snapshot_lsn <= 0:
        raise ValueError("create a snapshot before compacting")
    spark = log.sparkSession
    old = (F.col("lsn") <= snapshot_lsn) & F.lit(snapshot_lsn > last)
    name = uuid.uuid4().hex
    for part, rows in (("archive", log.filter(old)), ("tail", log.filter(~old))):
        rows.write.partitionBy("shard").parquet(f"{root}/{part}-{name}")
    n = lambda part: spark.read.schema(log.schema).parquet(f"{root}/{part}-{name}").groupBy("shard").agg(F.count("*").alias("n"))
    both = n("archive").withColumnRenamed("n", "archived").join(n("tail").withColumnRenamed("n", "retained"), "shard", "full_outer")
    return both.select("shard", F.coalesce("archived", F.lit(0)).alias("archived"), F.coalesce("retained", F.lit(0)).alias("retained"))


def archive_retention(log: DataFrame, file: str, before_lsn: int | None = None, before_ms: int | None = None) -> DataFrame:
    """Per archive file: delete if all its facts are before both bounds, else retain, and why."""
    if before_lsn is None and before_ms is None:
        raise ValueError("a bound of LSN or time is needed")
    reason = F.lit(None).cast("string")
    if before_ms is not None:
        reason = F.when(F.col("max_ts_ms") >= before_ms, "timestamp")
    if before_lsn is not None:
        reason = F.when(F.col("max_lsn") >= before_lsn, "lsn").otherwise(reason)
    stats = folds.file_stats(log, file).withColumn("reason", reason)
    return stats.withColumn("action", F.when(F.col("reason").isNull(), "delete").otherwise("retain"))


# --- restore ----------------------------------------------------------------------------------


class ImportRefused(ValueError):
    pass


def head_of(spark: SparkSession, root: str) -> int:
    """LSN that a target has applied; 0 for an empty one."""
    return int(read_pointer(spark, f"{root}/HEAD") or 0)


def apply_bundle(spark: SparkSession, root: str, bundle: str, shards: int) -> int:
    """Restores a full bundle into an empty target, or a delta whose base is the target's head.

    The bundle is verified first; the target's head moves when its facts are in.
    """
    from factloom.sources import logs

    head = head_of(spark, root)
    found = logs.import_preflight(spark, bundle, head, shards)
    if found:
        raise ImportRefused("; ".join(found))
    manifest = logs.read_manifest(spark, bundle)
    facts = spark.read.parquet(f"{bundle}/facts")
    facts.write.mode("overwrite").parquet(f"{root}/log/{head:020d}")
    write_pointer(spark, f"{root}/HEAD", str(manifest["current_lsn"]))
    return manifest["current_lsn"]


def apply_chain(spark: SparkSession, root: str, bundles: list[str], shards: int) -> int:
    """A full bundle and its deltas in order; one that does not follow stops the chain there."""
    head = head_of(spark, root)
    for bundle in bundles:
        head = apply_bundle(spark, root, bundle, shards)
    return head


def restored(spark: SparkSession, root: str) -> DataFrame:
    """The log that a target holds."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/log")
