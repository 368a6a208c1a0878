"""Dot paths into JSON records as columns: presence, type and value are three things.

Records are JSON text; a variant is parsed from it as a read-only index.  Only objects are entered, a present null is
a value, and array positions are not path segments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions import js


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def at(record: Column, path: str | None) -> Column:
    """The variant at a path; SQL NULL if it is missing, a variant null if it is null."""
    parts = js.path_parts(path)
    return F.try_variant_get(record, "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts), "variant") if parts else record


def present(v: Column) -> Column:
    return v.isNotNull()


def kind(v: Column) -> Column:
    """string, number, boolean, null, array or object; SQL NULL if the value is missing."""
    k = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(k == "STRING", "string")
        .when(k == "BOOLEAN", "boolean")
        .when(k == "VOID", "null")
        .when(k.startswith("ARRAY"), "array")
        .when(k.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def string(v: Column) -> Column:
    """The string, or NULL if the value is none."""
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def number(v: Column) -> Column:
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def items(v: Column) -> Column:
    return F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))


def equals(v: Column, value: object) -> Column:
    """Equality with a scalar, without conversion; false for missing values."""
    if value is None:
        same = kind(v) == "null"
    elif isinstance(value, bool):
        same = (kind(v) == "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    elif isinstance(value, (int, float)):
        same = number(v) == F.lit(float(value))
    elif isinstance(value, str):
        same = string(v) == F.lit(value)
    else:
        same = F.lit(False)
    return F.coalesce(same, F.lit(False))
