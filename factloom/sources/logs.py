"""Log files: JSON lines and Parquet in, Parquet and bundles out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.log import fold_records

LOG_SCHEMA = T.StructType([
    T.StructField(n, t)
    for n, t in (("lsn", T.LongType()), ("shard", T.LongType()), ("kind", T.StringType()), ("tbl", T.StringType()), ("key", T.StringType()), ("value", T.DoubleType()), ("ts_ms", T.LongType()), ("mutation_id", T.StringType()))
])


def read_json_log(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_recoverable(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(facts of the intact prefix, quarantined lines) of JSON-lines log files.

    A file is cut at its first line that does not parse. Lines are placed by their byte
    offset's stand-in, the position that Spark's text reader gives within a file.
    """
    lines = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.withColumn("fact", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = parsed.filter(F.col("fact._bad").isNotNull() | F.col("fact.lsn").isNull()).groupBy("file").agg(F.min(F.struct("block", "at")).alias("cut"))
    both = parsed.join(bad, "file", "left")
    intact = F.col("cut").isNull() | (F.struct("block", "at") < F.col("cut"))
    return both.filter(intact).select("fact.*").drop("_bad"), both.filter(~intact).select("file", "value")


def append_facts(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def read_legacy_records(spark: SparkSession, root: str, schema: T.StructType, one_a_file: bool = True) -> DataFrame:
    """Records kept as JSON files below ``root``, one folder a table, at any depth.

    Folders and files whose names begin with _ do not count, nor do files that are not JSON.
    ``one_a_file``: each file is one document (perhaps over many lines), else one a line.
    """
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", str(one_a_file).lower()).json(root)


def write_chat_log(messages: DataFrame, path: str, buckets: int = 64) -> None:
    """Messages by day and bucket of rooms, by room and in order inside each file: one room is
    a few row groups of one file a day, however many rooms there are."""
    rows = messages.withColumns({"day": F.floor(F.col("created_at_ms") / 86_400_000), "bucket": F.pmod(F.xxhash64("room"), F.lit(buckets))})
    rows.repartition("day", "bucket").sortWithinPartitions("day", "bucket", "room", "lsn").write.mode("overwrite").partitionBy("day", "bucket").parquet(path)


def read_chat_log(spark: SparkSession, path: str, room: str | None = None, buckets: int = 64) -> DataFrame:
    """The chat log, or one room of it (its bucket's files only)."""
    rows = spark.read.parquet(path).withColumn("day", F.col("day").cast("long"))
    if room is not None:
        rows = rows.filter((F.col("bucket") == F.pmod(F.xxhash64(F.lit(room)), F.lit(buckets))) & (F.col("room") == room))
    return rows.drop("bucket")


def export_bundle(log: DataFrame, path: str, base_lsn: int = 0, objects: DataFrame | None = None) -> dict:
    """Facts after ``base_lsn``, objects (object_id, content) with sizes and digests, and a
    manifest of counts and range."""
    spark = log.sparkSession
    rows = log.filter(F.col("lsn") > base_lsn)
    rows.write.mode("overwrite").parquet(f"{path}/facts")
    n, lo, hi = spark.read.schema(rows.schema).parquet(f"{path}/facts").agg(F.count("*"), F.min("lsn"), F.max("lsn")).first()
    manifest = {"base_lsn": base_lsn, "records": n, "min_lsn": lo, "current_lsn": hi if hi is not None else base_lsn}
    if objects is not None:
        held = objects.select("object_id", F.length("content").cast("long").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")
        held.write.mode("overwrite").parquet(f"{path}/objects")
        manifest["objects"] = spark.read.schema(held.schema).parquet(f"{path}/objects").count()
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def object_issues(objects: DataFrame) -> DataFrame:
    """object_id, issue (size or sha256) of bodies that are not what was exported."""
    size = F.length("content") != F.col("byte_size")
    issue = F.when(F.coalesce(size, F.lit(True)), "size").when(F.sha2("content", 256) != F.col("sha256"), "sha256")
    return objects.select("object_id", issue.alias("issue")).filter("issue is not null")


def verify_bundle(spark: SparkSession, path: str) -> list[str]:
    """Differences between a bundle's manifest and its facts and objects."""
    manifest = read_manifest(spark, path)
    facts = spark.read.parquet(f"{path}/facts")
    n, lo, hi, d = facts.agg(F.count("*"), F.min("lsn"), F.max("lsn"), F.countDistinct("lsn")).first()
    found = []
    if n != manifest["records"]:
        found.append(f"records: {n}, manifest {manifest['records']}")
    if lo is not None and (lo != manifest["min_lsn"] or hi != manifest["current_lsn"]):
        found.append(f"range: {lo}-{hi}")
    if d != n:
        found.append("duplicate LSNs")
    if lo is not None and lo <= manifest["base_lsn"]:
        found.append("facts at or before the base")
    if "objects" in manifest:
        objects = spark.read.parquet(f"{path}/objects")
        if (n := objects.count()) != manifest["objects"]:
            found.append(f"objects: {n}, manifest {manifest['objects']}")
        found += [f"{r['issue']} of {r['n']} objects" for r in object_issues(objects).groupBy("issue").agg(F.count("*").alias("n")).orderBy("issue").collect()]
    return found


def import_preflight(spark: SparkSession, path: str, current_lsn: int, shards: int, valid: Column | None = None) -> list[str]:
    """Reasons why a bundle cannot be applied to a target at ``current_lsn``. ``valid``: what the
    schema asks of a folded record."""
    found = verify_bundle(spark, path)
    manifest = read_manifest(spark, path)
    if manifest["base_lsn"] != current_lsn:
        found.append(f"base {manifest['base_lsn']} is not the target's {current_lsn}")
    facts = spark.read.parquet(f"{path}/facts")
    if facts.filter((F.col("shard") < 0) | (F.col("shard") >= shards)).limit(1).count():
        found.append("shard out of range")
    if valid is not None and (n := fold_records(facts).filter(~F.coalesce(valid, F.lit(False))).count()):
        found.append(f"{n} records break the schema")
    return found


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Object bodies with their length and SHA-256, from files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")
