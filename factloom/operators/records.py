"""Record queries: scans, index lookups, list planners and the overlay of live over stored rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.hashing import record_shard_key, shard_index
from factloom.functions.paging import after, between, decode_cursor, order_columns, page, parse_order
from factloom.functions.predicates import compile_predicate


def point_get(records: DataFrame, key: str) -> DataFrame:
    return records.filter(F.col("key") == key).limit(1)


def key_scan(records: DataFrame, after_key: str | None = None, limit: int | None = None) -> DataFrame:
    rows = records if after_key is None else records.filter(F.col("key") > after_key)
    return page(rows, [F.col("key")], limit)


def prefix_scan(records: DataFrame, prefix: str, after_key: str | None = None, limit: int | None = None) -> DataFrame:
    return key_scan(records.filter(F.col("key").startswith(prefix)), after_key, limit)


def key_range(records: DataFrame, lower: str | None, upper: str | None) -> DataFrame:
    """Half open: lower <= key < upper."""
    rows = records if lower is None else records.filter(F.col("key") >= lower)
    return rows if upper is None else rows.filter(F.col("key") < upper)


def partition_scan(records: DataFrame, parent: str, after_key: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of one parent in nested-key order."""
    rows = records.filter(F.col("parent_key") == parent)
    rows = rows if after_key is None else rows.filter(F.col("nested_key") > after_key)
    return page(rows, [F.col("nested_key")], limit)


def ordered_partition_scan(records: DataFrame, parent: str, order: str, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of one parent in the table's declared order, after an opaque cursor."""
    rows = records.filter(F.col("parent_key") == parent)
    terms = parse_order(order)
    if cursor is not None:
        rows = rows.filter(after([F.col(c) for c, _ in terms], decode_cursor(cursor), [d for _, d in terms]))
    return page(rows, order_columns(order), limit)


def recent(records: DataFrame, limit: int | None = None) -> DataFrame:
    return page(records, [F.col("lsn").desc(), F.col("updated_at_ms").desc(), F.col("key")], limit)


def index_exact(records: DataFrame, fields: list[str], values: list[Any], after_key: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows equal on the fields (fewer values than fields: on the leading ones), in key order."""
    rows = records
    for f, v in zip(fields, values):
        rows = rows.filter(F.col(f) == F.lit(v))
    return key_scan(rows, after_key, limit)


def index_range(records: DataFrame, fields: list[str], lower: list[Any] | None, upper: list[Any] | None, cursor: list[Any] | None = None, limit: int | None = None) -> DataFrame:
    """Rows between two tuples, both included, in (fields, key) order, after (values, key)."""
    columns = [F.col(f) for f in fields]
    rows = records.filter(between(columns, lower, upper))
    for f in fields:
        rows = rows.filter(F.col(f).isNotNull())
    if len(fields) == 1:  # the plain form reaches the Parquet scan
        rows = rows if lower is None else rows.filter(columns[0] >= lower[0])
        rows = rows if upper is None else rows.filter(columns[0] <= upper[0])
    if cursor is not None:
        rows = rows.filter(after([*columns, F.col("key")], cursor))
    return page(rows, [*columns, F.col("key")], limit)


def shard_filter(records: DataFrame, table: str, shard: int, shards: int) -> DataFrame:
    parent = F.col("parent_key") if "parent_key" in records.columns else None
    return records.filter(shard_index(record_shard_key(F.lit(table), F.col("key"), parent), shards) == shard)


def list_records(records: DataFrame, request: dict) -> DataFrame:
    """List planner: parent, order, predicate, shard, cursor and limit of one request."""
    rows = records.filter(compile_predicate(records, request.get("predicate")))
    if "shard" in request:
        rows = shard_filter(rows, request["table"], request["shard"], request["shards"])
    if request.get("order") == "recent":
        return recent(rows, request.get("limit"))
    if request.get("parent") is not None:
        if request.get("order") == "schema":
            return ordered_partition_scan(rows, request["parent"], request["schema_order"], request.get("after_cursor"), request.get("limit"))
        return partition_scan(rows, request["parent"], request.get("after_key"), request.get("limit"))
    return key_scan(rows, request.get("after_key"), request.get("limit"))


def index_records(records: DataFrame, request: dict) -> DataFrame:
    """Index planner: exact unless bounds or a cursor make it a range."""
    rows = records.filter(compile_predicate(records, request.get("predicate")))
    if "shard" in request:
        rows = shard_filter(rows, request["table"], request["shard"], request["shards"])
    fields = request["fields"]
    if any(request.get(k) is not None for k in ("lower", "upper", "after_cursor")):
        return index_range(rows, fields, request.get("lower"), request.get("upper"), request.get("after_cursor"), request.get("limit"))
    return index_exact(rows, fields, request["values"], request.get("after_key"), request.get("limit"))


def overlay(stored: DataFrame, live: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Live rows over stored rows by key; deleted keys hide both stored rows.

    An anti join and a union; what a live row hides stays hidden even if a later filter
    drops the live row.
    """
    shadow = live.select("key")
    if tombstones is not None:
        shadow = shadow.unionByName(tombstones.select("key"))
    return stored.join(shadow, "key", "left_anti").unionByName(live)


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``; an aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*")


def visible_rows(records: DataFrame, fields: list[str], user: str | None) -> DataFrame:
    """Row visibility: every listed field names the user; nobody sees protected rows unnamed."""
    rows = records if user is not None else records.limit(0)
    for f in fields if user is not None else []:
        rows = rows.filter(F.col(f) == user)
    return rows


def valid_keys(records: DataFrame, pattern: str = r"^[A-Za-z0-9_:.#-]{1,128}$") -> DataFrame:
    return records.filter(F.col("key").rlike(pattern))
