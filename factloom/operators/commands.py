"""The write path as plans: commands are checked against current state and become log facts.

A command is accepted, a noop (recorded, so that its mutation id answers a replay), a replay
(its mutation id came before) or refused with the first code that applies. Facts get LSNs in
the order of their commands; ``numbered`` gives them without sorting the whole batch in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators.log import DELETE, UPSERT

APPLIED, NOOP, REPLAY, REFUSED = "applied", "noop", "replay", "refused"
MAX_MESSAGES = 10_000


def numbered(rows: DataFrame, position: str, after: int, width: int = 1 << 16) -> DataFrame:
    """``rows`` with lsn: after + 1, after + 2, ... in the order of ``position`` (unique).

    Ranges of positions are counted first; a window then spans one range only.
    """
    parts = rows.withColumn("__part", F.floor(F.col(position) / width))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__part").orderBy(position)
    out = parts.join(base, "__part").withColumn("lsn", (F.lit(after) + F.col("__base") + F.row_number().over(own)).cast("long"))
    return out.drop("__part", "__base")


def first_code(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that is true; null if none is."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks))


def _replays(commands: DataFrame) -> Column:
    """Whether an earlier command of the batch has the mutation id (null ids never repeat)."""
    turn = F.row_number().over(Window.partitionBy("mutation_id").orderBy("position"))
    return F.col("mutation_id").isNotNull() & (turn > 1)


def record_outcomes(current: DataFrame, commands: DataFrame, known: DataFrame, invalid: Column) -> DataFrame:
    """What becomes of record commands.

    current: key, lsn; commands: position, kind (upsertRecord or deleteRecord), key,
    expected_lsn (null: any; 0: must not exist), mutation_id and value columns; known: mutation
    ids of the log; invalid: whether an upsert's value breaks its schema. A batch takes each key
    once: later commands on it are refused.
    """
    rows = commands.withColumn("__again", _replays(commands))
    seen = known.select("mutation_id").distinct().withColumn("__known", F.lit(True))
    rows = rows.join(seen, "mutation_id", "left").withColumn("__again", F.col("__again") | F.coalesce("__known", F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("key", "__again").orderBy("position"))
    rows = rows.withColumn("__turn", turn).join(current.select("key", F.col("lsn").alias("__lsn")), "key", "left")
    have = F.coalesce("__lsn", F.lit(0))
    upsert = F.col("kind") == "upsertRecord"
    code = first_code([("keyTwice", F.col("__turn") > 1), ("invalidRecord", upsert & invalid), ("lsnConflict", F.col("expected_lsn") != have)])
    status = F.when(F.col("__again"), REPLAY).when(code.isNotNull(), REFUSED).when(~upsert & (have == 0), NOOP).otherwise(APPLIED)
    out = rows.withColumns({"status": status, "code": F.when(~F.col("__again"), code)})
    return out.drop("__again", "__known", "__turn", "__lsn")


def record_facts(outcomes: DataFrame, after: int) -> DataFrame:
    """The log rows of accepted commands; a noop's fact names its mutation and changes nothing."""
    rows = numbered(outcomes.filter(F.col("status").isin(APPLIED, NOOP)), "position", after)
    kind = F.when(F.col("status") == NOOP, "mutationRecorded").when(F.col("kind") == "upsertRecord", UPSERT).otherwise(DELETE)
    return rows.withColumn("kind", kind).drop("status", "code", "expected_lsn")


def message_outcomes(commands: DataFrame, most: int = MAX_MESSAGES, most_bytes: int = 16384) -> DataFrame:
    """commands (batch, position, room, body_bytes): a batch of too many messages is refused as
    a whole, as is a batch with a blank room or too long a body (one fact, one LSN range)."""
    per = commands.groupBy("batch").agg(
        F.count("*").alias("__n"), F.max((F.coalesce(F.trim("room"), F.lit("")) == "").cast("int")).alias("__blank"), F.max("body_bytes").alias("__most")
    )
    code = first_code([("tooManyMessages", F.col("__n") > most), ("roomRequired", F.col("__blank") == 1), ("bodyTooLarge", F.col("__most") > most_bytes)])
    rows = commands.join(per, "batch")
    return rows.withColumns({"code": code, "status": F.when(code.isNotNull(), REFUSED).otherwise(APPLIED)}).drop("__n", "__blank", "__most")


def object_outcomes(objects: DataFrame, refs: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (position, kind, object_id, force): a delete of what is referenced is refused
    unless forced; of what is absent, a noop."""
    have = objects.select("object_id", F.lit(True).alias("__have"))
    used = refs.groupBy("object_id").agg(F.countDistinct("source").alias("ref_count"))
    rows = commands.join(have, "object_id", "left").join(used, "object_id", "left").withColumn("ref_count", F.coalesce("ref_count", F.lit(0)))
    delete = F.col("kind") == "deleteObject"
    refused = delete & (F.col("ref_count") > 0) & ~F.coalesce("force", F.lit(False))
    status = F.when(refused, REFUSED).when(delete & F.col("__have").isNull(), NOOP).otherwise(APPLIED)
    return rows.withColumns({"status": status, "code": F.when(refused, "objectReferenced")}).drop("__have")


def user_outcomes(commands: DataFrame, most_bytes: int = 4096) -> DataFrame:
    """commands (position, user_id, profile): ids must not be blank, profiles not too long."""
    code = first_code([("userRequired", F.coalesce(F.trim("user_id"), F.lit("")) == ""), ("profileTooLarge", F.octet_length("profile") > most_bytes)])
    return commands.withColumns({"code": code, "status": F.when(code.isNotNull(), REFUSED).otherwise(APPLIED)})


def users_after(outcomes: DataFrame, after: int) -> DataFrame:
    """Profiles after the batch: the last accepted upsert of each user."""
    rows = numbered(outcomes.filter(F.col("status") == APPLIED), "position", after)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("lsn", "profile"), "lsn").alias("r")).select("user_id", "r.*")
