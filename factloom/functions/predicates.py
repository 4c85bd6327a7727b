"""Record predicates: a conjunction of terms compiled to one Column.

A term is ``{"path": "a.b", "op": ..., "value": ...}``. On typed columns null means missing and
terms are plain comparisons, which reach the Parquet scan. On VARIANT columns the strict
JSON rules hold: missing is not null, ``eq`` and ``ne`` compare types too (1 is not 1.0 and
not "1"), ranges compare numbers with numbers or strings with strings only, and ``ne`` needs
the field to be there.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TERMS = 32
MAX_PATH = 256
COMPONENT = re.compile(r"[A-Za-z0-9_-]{1,64}\Z")
RANGES = {"lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
OPS = {"eq", "ne", "contains", "startsWith", "exists", *RANGES}


class PredicateError(ValueError):
    pass


def parse_predicate(raw: str | dict | None) -> list[dict]:
    """Terms of a predicate given as JSON text or object; blank means none."""
    if raw is None or (isinstance(raw, str) and not raw.strip()):
        return []
    made = json.loads(raw) if isinstance(raw, str) else raw
    terms = made.get("all") if isinstance(made, dict) else None
    if not isinstance(terms, list):
        raise PredicateError("a predicate is {'all': [terms]}")
    if len(terms) > MAX_TERMS:
        raise PredicateError(f"at most {MAX_TERMS} terms")
    for t in terms:
        path = t.get("path", "")
        if not path or len(path) > MAX_PATH or not all(COMPONENT.match(c) for c in path.split(".")):
            raise PredicateError(f"bad path {path!r}")
        if t.get("op") not in OPS:
            raise PredicateError(f"unknown operator {t.get('op')!r}")
    return terms


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def variant_equals(v: Column, value: Any) -> Column:
    """Type-strict equality of a VARIANT with a JSON value."""
    kind = F.schema_of_variant(v)
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, int):
        return (kind == "BIGINT") & (F.try_variant_get(v, "$", "bigint") == value)
    if isinstance(value, float):
        return (kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (F.try_variant_get(v, "$", "double") == value)
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == value)
    return F.to_json(v) == json.dumps(value, separators=(",", ":"), sort_keys=True)


def _variant_term(root: Column, path: list[str], op: str, value: Any) -> Column:
    v = F.variant_get(root, "$" + "".join(f"['{c}']" for c in path), "variant")
    kind = F.schema_of_variant(v)
    if op == "exists":
        return v.isNull() if value is False else v.isNotNull()
    if op == "eq":
        return variant_equals(v, value)
    if op == "ne":
        return v.isNotNull() & ~F.coalesce(variant_equals(v, value), F.lit(False))
    if op in RANGES:
        if _is_number(value):
            number = (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")
            return number & getattr(F.try_variant_get(v, "$", "double"), RANGES[op])(float(value))
        if isinstance(value, str):
            return (kind == "STRING") & getattr(F.try_variant_get(v, "$", "string"), RANGES[op])(value)
        return F.lit(False)
    text = F.try_variant_get(v, "$", "string")
    if op == "startsWith":
        return (kind == "STRING") & text.startswith(value) if isinstance(value, str) else F.lit(False)
    member = F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.coalesce(variant_equals(e, value), F.lit(False)))
    inside = kind.startswith("ARRAY") & member
    return inside | ((kind == "STRING") & text.contains(value)) if isinstance(value, str) else inside


def _typed_term(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    if op == "exists":
        return c.isNull() if value is False else c.isNotNull()
    number, string = isinstance(kind, T.NumericType), isinstance(kind, T.StringType)
    fits = (number and _is_number(value)) or (string and isinstance(value, str)) or (isinstance(kind, T.BooleanType) and isinstance(value, bool))
    if op == "eq":
        return c == F.lit(value) if fits else (c.isNull() & F.lit(False))
    if op == "ne":
        return c != F.lit(value) if fits else c.isNotNull()
    if op in RANGES:
        return getattr(c, RANGES[op])(F.lit(value)) if fits and not isinstance(value, bool) else F.lit(False)
    if op == "startsWith":
        return c.startswith(value) if string and isinstance(value, str) else F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.array_contains(c, value) if value is not None else F.lit(False)
    return c.contains(value) if string and isinstance(value, str) else F.lit(False)


def compile_term(df: DataFrame, term: dict) -> Column:
    path = term["path"].split(".")
    kind: T.DataType = df.schema
    for k, name in enumerate(path):
        if isinstance(kind, T.VariantType):
            return _variant_term(F.col(".".join(f"`{c}`" for c in path[:k])), path[k:], term["op"], term.get("value"))
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            # Paths go through objects only: what is not there is missing.
            return F.lit(term["op"] == "exists" and term.get("value") is False)
        kind = kind[name].dataType
    c = F.col(".".join(f"`{x}`" for x in path))
    if isinstance(kind, T.VariantType):
        return _variant_term(c, [], term["op"], term.get("value"))
    return _typed_term(c, kind, term["op"], term.get("value"))


def compile_predicate(df: DataFrame, raw: str | dict | None) -> Column:
    terms = parse_predicate(raw)
    return reduce(lambda a, b: a & b, (compile_term(df, t) for t in terms), F.lit(True))


def parse_index_value(text: str) -> Any:
    """Query text as a JSON scalar if it is one, else as the string it is."""
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return text if isinstance(value, (list, dict)) else value
