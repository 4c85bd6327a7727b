"""Shared plumbing of the training-data operators: tables, staging, row identity."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or what
    ``SparkContext.setCheckpointDir`` was given.

    Only a local session that names none (tests) gets a temporary folder. On a cluster no
    machine's own folder would do, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time: texts are long, so the default of 10,000
    rows a batch can be hundreds of megabytes. A bound that is already lower stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key, None) or "0").lower().removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, the tables staged inside it; what is to stay must be written by
    then (``pipeline.run`` writes each stage's result outside)."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends there: a lost executor costs no recomputation of what came before,
    and what is used several times is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, th, text): the columns an operator works on, null texts made empty.
    With ``carry`` also ``row``, a struct of all columns of ``docs`` but its text.

    ``(doc_id, th)`` identifies a row up to exact repetition (same id, same text), for
    which every operator gives the same answer; so ids may repeat or be null.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    bounded_batches(docs.sparkSession)
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")] if carry else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"), *row)


def same_row(a: DataFrame, b: DataFrame):
    """Join condition on the row identity of ``keyed`` (null ids are equal to each other)."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-rows // per_part))
