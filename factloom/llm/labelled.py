"""Bounded samples of labelled documents, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stage


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents that are not held out.

    They are taken by the hash of their id, so the choice neither follows the table's order
    nor changes between runs. Ids whose labels are null or contradict each other are left out.
    The ids are few (``most`` bounds them) and are broadcast, so no text is shuffled but the
    sample's own.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
        .filter("id is not null and y is not null")
        .filter(~held_out(F.col("id"), mod, rest))
        .groupBy("id")
        .agg(F.min("y").alias("y"), F.max("y").alias("z"))
        .filter("y = z")
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
        .select("id", "y")
    )
    ids = stage(ids, "sample-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").dropDuplicates(["id"]).select("id", "text", "y")


def learn(sample: DataFrame, fit) -> bytes | None:
    """``fit(texts, y) -> bytes`` on the whole sample in one task; None for an empty one."""
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        texts = [t or "" for t in group["text"].to_pylist()]
        return pa.table({"model": pa.array([fit(texts, group["y"].to_numpy())], pa.binary())})

    row = sample.groupBy(F.lit(0).alias("all")).applyInArrow(lambda g: run(g), "model binary").first()
    return bytes(row["model"]) if row else None
