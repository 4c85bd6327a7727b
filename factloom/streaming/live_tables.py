"""The log as a stream: running folds, counts, channel state and catch-up.

``foreachBatch`` sinks (``sources.store``) call the batch folds, so both ways share one
definition; counts and sums keep keyed state and emit changes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from factloom.operators import log as folds


def read_log_stream(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def live_deltas(stream: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """(first key, lsn, delta): by how much each fact changes the sum of its group, in update
    mode.

    Keyed state holds what each key adds now; only a change of that reaches the sum, so a fact
    that comes again, or late, changes nothing.
    """

    def changes(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lsn, now = state.get if state.exists else (0, 0.0)
        before = now
        for rows in batches:
            rows = rows[rows.lsn > lsn]
            if len(rows):
                last = rows.loc[rows.lsn.idxmax()]
                lsn, now = int(last.lsn), float(last.amount)
        state.update((lsn, now))
        if now != before:
            yield pd.DataFrame({keys[0]: [key[0]], "lsn": [lsn], "delta": [now - before]})

    rows = stream.select(*keys, "lsn", F.coalesce(amount.cast("double"), F.lit(0.0)).alias("amount"))
    return rows.groupBy(*keys).applyInPandasWithState(changes, f"{keys[0]} string, lsn long, delta double", "lsn long, amount double", "update", GroupStateTimeout.NoTimeout)


def _records(stream: DataFrame) -> DataFrame:
    return stream.filter(F.col("kind").isin(folds.UPSERT, folds.DELETE))


def live_counts(stream: DataFrame) -> DataFrame:
    """(tbl, lsn, delta): changes of the number of live keys of each table."""
    out = live_deltas(_records(stream), ["tbl", "key"], F.col("kind") == folds.UPSERT)
    return out.select("tbl", "lsn", F.col("delta").cast("long").alias("delta"))


def live_sums(stream: DataFrame, value: str) -> DataFrame:
    """(tbl, lsn, delta): changes of the sum over live rows of each table."""
    return live_deltas(_records(stream), ["tbl", "key"], F.when(F.col("kind") == folds.UPSERT, F.col(value)))


def live_presence(stream: DataFrame) -> DataFrame:
    """stream (lsn, there, channel, user_id) -> (channel, lsn, delta): changes of its members."""
    return live_deltas(stream, ["channel", "user_id"], F.col("there"))


def compare_and_set(rows: pd.DataFrame, version: int = 0, value: str | None = None) -> tuple[list[tuple], int, str | None]:
    """Applies updates in log order: one whose expected version is wrong is a conflict."""
    out = []
    for lsn, expected, new in rows.sort_values("lsn")[["lsn", "expected", "value"]].itertuples(index=False):
        ok = pd.isna(expected) or int(expected) == version
        if ok:
            version, value = version + 1, new
        out.append((int(lsn), bool(ok), version))
    return out, version, value


def channel_cas(updates: DataFrame) -> DataFrame:
    """Batch form: channel, lsn, accepted, version after each update. Sequential per channel,
    whose updates of the batch are held at once; long histories go through the streaming form,
    which keeps a version and a value only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done, _, _ = compare_and_set(pdf)
        return pd.DataFrame({"channel": pdf.channel.iloc[0], "lsn": [x[0] for x in done], "accepted": [x[1] for x in done], "version": [x[2] for x in done]})

    return updates.groupBy("channel").applyInPandas(run, "channel string, lsn long, accepted boolean, version long")


class ChannelState(StatefulProcessor):
    """Streaming form: the channel's version and value are the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", "version long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        version, value = self.held.get() if self.held.exists() else (0, None)
        done, version, value = compare_and_set(pd.concat(list(rows)), version, value)
        self.held.update((version, value))
        yield pd.DataFrame({"channel": key[0], "lsn": [x[0] for x in done], "accepted": [x[1] for x in done], "version": [x[2] for x in done]})

    def close(self) -> None:
        pass


def channel_cas_stream(updates: DataFrame) -> DataFrame:
    """Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    return updates.groupBy("channel").transformWithStateInPandas(ChannelState(), outputStructType="channel string, lsn long, accepted boolean, version long", outputMode="update", timeMode="None")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a query over what is there now and waits for it."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def catch_up(history: DataFrame, live: DataFrame, after_lsn: int) -> DataFrame:
    """Facts after a cursor from history and from a live batch, each once (live wins)."""
    return folds.scan(folds.tail(history, after_lsn), folds.tail(live, after_lsn))
