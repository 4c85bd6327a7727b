"""Shard and scope numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 256


def shard_index(key: Column, shards: int) -> Column:
    """First 8 bytes of SHA-256, big endian, modulo ``shards``.

    Taken in two halves of 32 bits, so that the arithmetic stays in longs.
    """
    digest = F.sha2(key, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return ((high % shards) * ((1 << 32) % shards) + low % shards) % shards


def record_shard_key(table: Column, key: Column, parent: Column | None = None) -> Column:
    """``table:key``; rows of a nested table stay with their parent: ``table:parent``."""
    own = F.concat_ws(":", table, key)
    return own if parent is None else F.when(parent.isNull(), own).otherwise(F.concat_ws(":", table, parent))


def scope_key(table: Column, key: Column, parent: Column | None = None, buckets: int = BUCKETS) -> Column:
    """Parent scope for nested rows, else one of ``buckets`` hexadecimal buckets."""
    bucket = F.lower(F.lpad(F.hex(shard_index(F.concat_ws(":", table, key), buckets)), 2, "0"))
    own = F.concat_ws(":", table, bucket)
    return own if parent is None else F.when(parent.isNull(), own).otherwise(F.concat_ws(":", table, parent))


def child_mutation_id(mutation: Column, index: Column, kind: Column) -> Column:
    return F.format_string("%s:%03d:%s", mutation, index, kind)
