"""Limits, keyset pages and opaque cursors."""

from __future__ import annotations

import base64
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT, MOST = 50, 500


def normalize_limit(limit: int | None) -> int:
    return max(1, min(MOST, DEFAULT if limit is None else limit))


def encode_cursor(values: list[Any]) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


def decode_cursor(cursor: str) -> list[Any]:
    return json.loads(base64.urlsafe_b64decode(cursor.encode()))


def page(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows in ``order`` with ``has_more``: whether another one follows.

    One row more than asked for is taken (a top-k, no full sort); the window is over those.
    """
    n = normalize_limit(limit)
    top = df.orderBy(*order).limit(n + 1)
    ranked = top.withColumns({"__rn": F.row_number().over(Window.orderBy(*order)), "__n": F.count(F.lit(1)).over(Window.partitionBy())})
    return ranked.filter(F.col("__rn") <= n).withColumn("has_more", F.col("__n") > n).drop("__rn", "__n")


def after(columns: list[Column], values: list[Any], descending: list[bool] | None = None) -> Column:
    """Rows after a cursor position in lexicographic order, column by column."""
    down = descending or [False] * len(columns)
    out, same = F.lit(False), F.lit(True)
    for c, v, d in zip(columns, values, down):
        out = out | (same & ((c < F.lit(v)) if d else (c > F.lit(v))))
        same = same & (c == F.lit(v))
    return out


def between(columns: list[Column], lower: list[Any] | None, upper: list[Any] | None) -> Column:
    """Tuple range, both ends included."""
    out = F.lit(True)
    if lower is not None:
        out = out & (after(columns, lower) | _equal(columns, lower))
    if upper is not None:
        out = out & ~after(columns, upper)
    return out


def _equal(columns: list[Column], values: list[Any]) -> Column:
    out = F.lit(True)
    for c, v in zip(columns, values):
        out = out & (c == F.lit(v))
    return out


def parse_order(terms: str) -> list[tuple[str, bool]]:
    """``desc(a), b`` -> [("a", True), ("b", False)]."""
    out = []
    for t in (x.strip() for x in terms.split(",")):
        out.append((t[5:-1].strip(), True) if t.startswith("desc(") and t.endswith(")") else (t, False))
    return out


def order_columns(terms: str) -> list[Column]:
    return [F.col(c).desc() if d else F.col(c).asc() for c, d in parse_order(terms)]


def typed_sort_key(v: Column) -> Column:
    """Order of mixed JSON values in an index: null < bool < number < string < the rest."""
    kind = F.schema_of_variant(v)
    rank = (
        F.when(v.isNull() | F.is_variant_null(v), 0)
        .when(kind == "BOOLEAN", 1)
        .when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), 2)
        .when(kind == "STRING", 3)
        .otherwise(4)
    )
    number = F.when(rank == 1, F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(rank == 2, F.try_variant_get(v, "$", "double"))
    text = F.when(rank == 3, F.try_variant_get(v, "$", "string")).when(rank == 4, F.to_json(v))
    return F.struct(rank.alias("rank"), F.coalesce(number, F.lit(0.0)).alias("number"), F.coalesce(text, F.lit("")).alias("text"))
