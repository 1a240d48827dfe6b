"""V1: schemas as files, compiled to columns. Each rule becomes one boolean expression over typed columns, arrays and maps included, so a table is checked in one pass without Python.

Understood: type, required, properties, items (arrays), values (maps), enum, minimum, maximum, minLength, pattern, absent (fields that must not be there), and cases: further rules for
rows whose named field has one of the values. A rule's name is the path of its field and what is wrong: missing, type, unknown, too_small, too_large, empty, form, present.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, MapType, NumericType, StringType, StructType

FOLDER = Path(__file__).resolve().parent.parent / "schemas"
KINDS = {"string": StringType, "integer": IntegralType, "number": NumericType, "boolean": BooleanType, "array": ArrayType, "object": (StructType, MapType)}


def schema_of(name: str) -> dict:
    return json.loads((FOLDER / f"{name}.json").read_text(encoding="utf-8"))


def names() -> list[str]:
    return sorted(p.stem for p in FOLDER.glob("*.json"))


def _fields(kind: DataType) -> dict[str, DataType]:
    return {f.name: f.dataType for f in kind.fields} if isinstance(kind, StructType) else {}


def rules(schema: dict, value: Column, kind: DataType, path: str = "") -> Iterator[tuple[str, Callable[[Column], Column]]]:
    """(rule, test): test(value) is true where a value that is not null breaks the rule."""
    if "type" in schema and not isinstance(kind, KINDS[schema["type"]]) and not (schema["type"] == "integer" and isinstance(kind, FractionalType) and not schema.get("strict")):
        yield f"{path}_type", lambda v: v.isNotNull()
        return
    for word, broken in _scalar(schema).items():
        yield f"{path}_{word}", broken
    under = lambda name: f"{path}.{name}" if path else name
    known = _fields(kind)
    for name in schema.get("required", ()):
        yield f"{under(name)}_missing", (lambda v, n=name: v[n].isNull()) if name in known else (lambda v: v.isNotNull())
    for name in schema.get("absent", ()):
        if name in known:
            yield f"{under(name)}_present", lambda v, n=name: v[n].isNotNull()
    for name, inner in schema.get("properties", {}).items():
        if name in known:
            for rule, test in rules(inner, value, known[name], under(name)):
                yield rule, lambda v, n=name, t=test: v[n].isNotNull() & t(v[n])
    if "items" in schema and isinstance(kind, ArrayType):
        for rule, test in rules(schema["items"], value, kind.elementType, f"{path}[]"):
            yield rule, lambda v, t=test: F.exists(v, lambda x: x.isNotNull() & F.coalesce(t(x), F.lit(False)))
    if "values" in schema and isinstance(kind, MapType):
        for rule, test in rules(schema["values"], value, kind.valueType, f"{path}[]"):
            yield rule, lambda v, t=test: F.exists(F.map_values(v), lambda x: x.isNotNull() & F.coalesce(t(x), F.lit(False)))
    for case in schema.get("cases", ()):
        [(name, values)] = case["if"].items()
        if name in known and values:
            for rule, test in rules(case["then"], value, kind, path):
                yield rule, lambda v, n=name, x=values, t=test: v[n].isin(*x) & t(v)


def _scalar(schema: dict) -> dict[str, Callable[[Column], Column]]:
    out: dict[str, Callable[[Column], Column]] = {}
    if "enum" in schema:
        out["unknown"] = lambda v: ~v.isin(*schema["enum"])
    if "minimum" in schema:
        out["too_small"] = lambda v: v < schema["minimum"]
    if "maximum" in schema:
        out["too_large"] = lambda v: v > schema["maximum"]
    if "minLength" in schema:
        out["empty"] = lambda v: F.length(v) < schema["minLength"]
    if "pattern" in schema:
        out["form"] = lambda v: ~v.rlike(schema["pattern"])
    return out


def broken_rules(table: DataFrame, schema: dict | str, *keep: str) -> DataFrame:
    """A row for each record and rule that it breaks: the columns of `keep`, rule. Rules of one name, as of two cases, are one."""
    schema = schema_of(schema) if isinstance(schema, str) else schema
    row = F.struct(*table.columns)
    by_name: dict[str, list[Column]] = {}
    for rule, test in rules(schema, row, table.schema):
        by_name.setdefault(rule, []).append(F.coalesce(test(F.col("_row")), F.lit(False)))
    found = F.array_compact(F.array(*(F.when(reduce(or_, tests), F.lit(rule)) for rule, tests in by_name.items())))
    return table.select(*keep, row.alias("_row")).select(*keep, found.alias("_found")).select(*keep, F.explode("_found").alias("rule"))
