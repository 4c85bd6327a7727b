"""op10: mixing sources to target weights by pivotal dependent rounding.

A document's size is its number of words. Sources in code-point order (null last) weigh 1,
2, 3, 1, 2, 3, ... and share the corpus' size; a target stops at ``MOST`` times its source's
size and the excess goes to the others by weight. A source with ratio r = target / size
takes every document floor(r) times, and a fraction of one more copy of each. Fractions are
rounded in pairs: mass, counted in words, moves at random from one document of a pair to the
other until one of them is whole, so the source's total stays as it is and each document
keeps its expectation. Chunks of about ``CHUNK`` documents (by hash of the row) are rounded
in parallel and leave one fraction each at most; those are combined ``FAN`` to one, level by
level, down to one a source. A source thus ends within one document of its target, and no
task holds more than a chunk, however large the source.

Random numbers come from the seed, the source and the chunk, rows are taken in order of
their values: reruns agree.

Rows: null text has size 0; null is a source of its own; ids may be null or repeat (every
row is a document); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import stage, table

WEIGHTS = (1, 2, 3)
MOST = 3
CHUNK = 1024
FAN = 64
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes (source, size) -> source, source_size, rows, target."""
    per = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "op10-sources")
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(every) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    # In order of cap a weight, sources fill up one after the other; the rest share by weight.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - before) / left)
    per = per.withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("cap") / F.col("w"))).over(whole)
    return per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level)).select("source", "source_size", "rows", "target")


def pivot(share: np.ndarray, weight: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounds fractions in turn, keeping sum(share * weight); one fraction may be left."""
    out = share.copy()
    held = -1
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b, wa, wb = out[held], out[i], weight[held], weight[i]
        up, down = min((1 - a) * wa, b * wb), min(a * wa, (1 - b) * wb)
        if draws[i] * (up + down) < down:
            whole = (1 - a) * wa <= b * wb
            out[held], out[i] = (1.0, b - (1 - a) * wa / wb) if whole else (a + b * wb / wa, 0.0)
        else:
            whole = a * wa <= (1 - b) * wb
            out[held], out[i] = (0.0, b + a * wa / wb) if whole else (a - (1 - b) * wb / wa, 1.0)
        out[[held, i]] = np.where(np.abs(out[[held, i]] - np.round(out[[held, i]])) < 1e-12, np.round(out[[held, i]]), out[[held, i]])
        held = next((k for k in (held, i) if 0 < out[k] < 1), -1)
    return out


def _round_groups(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    schema = "doc_id long, source string, size long, source_size long, target double, base long, share double, chunk long"

    def run(group: pa.Table) -> pa.Table:
        order = [("share", "ascending"), ("size", "ascending"), ("doc_id", "ascending")]
        group = group.sort_by(order)
        size, share = group["size"].to_numpy(), group["share"].to_numpy()
        name = f"{seed}/{level}/{group['source'][0].as_py()!r}/{group['chunk'][0].as_py()}"
        rng = np.random.default_rng(xxhash.xxh64_intdigest(name))
        mixed = rng.permutation(len(size))
        draws = rng.random(len(size) + 1)
        done = np.empty(len(size))
        done[mixed] = pivot(share[mixed], size[mixed].astype(float), draws)
        if last:
            left = (done > 0) & (done < 1)
            done[left] = draws[-1] < done[left]
        return group.set_column(group.schema.get_field_index("share"), "share", pa.array(done))

    return rows.groupBy("source", "chunk").applyInArrow(run, schema)


def mix_sources(docs: DataFrame, most: int = MOST, chunk: int = CHUNK, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, source, size, source_size, target, taken, copies."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "op10-sizes")
    per = stage(source_targets(rows, most), "op10-targets").withColumnRenamed("source", "name")
    rows = rows.join(per, rows["source"].eqNullSafe(per["name"]))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(ratio + 1e-12), F.lit(most))
    share = F.when(F.col("size") > 0, F.greatest(ratio - base, F.lit(0.0))).otherwise(0.0)
    number = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("rows") / chunk))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", base.alias("base"), F.when(share < 1e-12, 0.0).otherwise(share).alias("share"), number.alias("chunk"))
    open_ = (F.col("share") > 0) & (F.col("share") < 1)
    level, now, parts = 0, stage(_round_groups(rows, 0, seed, False), "op10-level"), []
    most_chunks = per.agg(F.max(F.ceil(F.col("rows") / chunk))).first()[0] or 1
    while True:
        parts.append(now.filter(~open_))
        left = now.filter(open_).withColumn("chunk", F.floor(F.col("chunk") / fan))
        level, most_chunks = level + 1, -(-most_chunks // fan)
        now = stage(_round_groups(left, level, seed, most_chunks <= 1), "op10-level")
        if most_chunks <= 1:
            break
    parts.append(now)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    copies = (F.col("base") + F.round("share")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source", "copies")
