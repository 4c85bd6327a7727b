"""Declared schemas: compile to Spark types, validate rows, report, and plan migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECT_REF = T.StructType([T.StructField(n, T.LongType() if n == "byteSize" else T.StringType()) for n in ("id", "path", "contentType", "byteSize", "sha256")])
SCALARS = {"string": T.StringType(), "text": T.StringType(), "id": T.StringType(), "int64": T.LongType(), "timeMs": T.LongType(), "boolean": T.BooleanType(), "json": T.VariantType(), "objectRef": OBJECT_REF}


def data_type(field: dict) -> T.DataType:
    kind = field["kind"]
    if kind == "list":
        return T.ArrayType(data_type(field["item"]), containsNull=False)
    if kind == "object":
        return struct_type(field["fields"])
    return SCALARS[kind]


def struct_type(fields: dict[str, dict]) -> T.StructType:
    return T.StructType([T.StructField(n, data_type(f), f.get("optional", False)) for n, f in fields.items()])


def check(field: dict, c: Column) -> Column:
    """Whether a typed value is valid (null: missing, valid only where optional)."""
    kind = field["kind"]
    ok = F.lit(True)
    if kind == "text":
        ok = F.octet_length(c) <= field["inlineUntil"]
    elif kind == "id":
        ok = F.trim(c) != ""
    elif kind == "objectRef":
        ok = (F.trim(c["id"]) != "") & (F.trim(c["path"]) != "") & (F.trim(c["contentType"]) != "") & (F.trim(c["sha256"]) != "") & (c["byteSize"] >= 0)
    elif kind == "list":
        ok = F.forall(c, lambda e: F.coalesce(check(field["item"], e), F.lit(False)))
    elif kind == "object":
        for n, f in field["fields"].items():
            ok = ok & check(f, c[n])
    missing = F.lit(bool(field.get("optional", False)))
    return F.when(c.isNull(), missing).otherwise(F.coalesce(ok, F.lit(False)))


def validate(rows: DataFrame, fields: dict[str, dict]) -> Column:
    """Array of the names of the invalid fields."""
    return F.array_compact(F.array(*(F.when(~check(f, F.col(n)), F.lit(n)) for n, f in fields.items())))


def report(schema: dict) -> list[str]:
    """What is wrong with a schema in itself."""
    out = []
    if not schema.get("name", "").strip():
        out.append("name is blank")
    for t, table in schema.get("tables", {}).items():
        if not table.get("fields"):
            out.append(f"{t}: no fields")
        for n, f in table.get("fields", {}).items():
            out += [f"{t}.{n}: {x}" for x in _field_issues(f, schema)]
        for i, index in table.get("indexes", {}).items():
            for n in index["fields"]:
                if n not in table.get("fields", {}):
                    out.append(f"{t}.{i}: unknown field {n}")
                elif table["fields"][n]["kind"] in ("list", "object", "json", "objectRef"):
                    out.append(f"{t}.{i}: field {n} is no scalar")
        if len(table.get("visibility", [])) > 8:
            out.append(f"{t}: more than 8 visibility rules")
        out += [f"{t}: visibility names unknown field {n}" for n in table.get("visibility", []) if n not in table.get("fields", {})]
    return out


def _field_issues(f: dict, schema: dict) -> list[str]:
    kind = f.get("kind")
    if kind not in (*SCALARS, "list", "object"):
        return [f"unknown kind {kind}"]
    if kind == "text" and f.get("inlineUntil", 0) <= 0:
        return ["inlineUntil must be positive"]
    if kind == "id" and not f.get("entity", "").strip():
        return ["entity is blank"]
    if kind == "objectRef" and f.get("object") not in schema.get("objects", []):
        return [f"unknown object {f.get('object')}"]
    if kind == "list":
        return _field_issues(f["item"], schema)
    return [x for n, g in f.get("fields", {}).items() for x in (f"{n}: {y}" for y in _field_issues(g, schema))]


def flatten(schema: dict) -> list[tuple[str, str, bool]]:
    """(path, type, optional) of all tables and fields."""
    out = []

    def walk(path: str, f: dict) -> None:
        kind = f["kind"]
        shape = kind + (f":{f['inlineUntil']}" if kind == "text" else f":{f.get('entity', f.get('object', ''))}" if kind in ("id", "objectRef") else "")
        out.append((path, shape, f.get("optional", False)))
        if kind == "list":
            walk(path + "[]", f["item"])
        for n, g in f.get("fields", {}).items() if kind == "object" else ():
            walk(f"{path}.{n}", g)

    for t, table in schema.get("tables", {}).items():
        out.append((t, "table", False))
        for n, f in table["fields"].items():
            walk(f"{t}.{n}", f)
    return out


def migration_plan(old: dict, new: dict) -> list[tuple[str, str]]:
    """(path, verdict): compatible, replaySafe (removals), unsafe (changed or newly required
    fields) or rebuild (indexes or storage)."""
    a = {p: (t, o) for p, t, o in flatten(old)}
    b = {p: (t, o) for p, t, o in flatten(new)}
    out = []
    for p in sorted(a.keys() | b.keys()):
        if p not in b:
            out.append((p, "replaySafe"))
        elif p not in a:
            table = p.split(".")[0]
            fresh = table not in a or b[p][1] or b[p][0] == "table" or any(q in b and q not in a for q in (p[:-2] if p.endswith("[]") else p.rsplit(".", 1)[0],))
            out.append((p, "compatible" if fresh else "unsafe"))
        elif a[p][0] != b[p][0]:
            wider = a[p][0].startswith("text:") and b[p][0].startswith("text:") and int(a[p][0][5:]) <= int(b[p][0][5:])
            out.append((p, "compatible" if wider else "unsafe"))
        elif a[p][1] != b[p][1]:
            out.append((p, "compatible" if b[p][1] else "unsafe"))
    for t in sorted(old.get("tables", {}).keys() & new.get("tables", {}).keys()):
        for what in ("indexes", "storage"):
            if old["tables"][t].get(what) != new["tables"][t].get(what):
                out.append((f"{t}#{what}", "rebuild"))
    return out


def recover(log: DataFrame) -> DataFrame:
    """Schema history from the log: the last schema of each version, and which is active."""
    last = log.groupBy("version").agg(F.max_by(F.struct("schema", "lsn"), "lsn").alias("r"))
    top = last.agg(F.max("r.lsn").alias("top"))
    return last.join(F.broadcast(top)).select("version", "r.lsn", "r.schema", (F.col("r.lsn") == F.col("top")).alias("active"))
