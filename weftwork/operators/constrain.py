"""Typed constraints: a declared schema that checks a value and projects it.

``compile`` checks the declaration once on the driver.  ``check`` applies it to one value (in Arrow batches and in retry
loops) and returns the projected value; ``columns`` does the same over a variant column with built-in expressions for
declarations without open objects, as (JSON projection, error kind); numbers are printed as the record's parser reads them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions import js, paths, text

TYPES = ("string", "number", "boolean", "literal", "enum", "array", "object")


class ConstrainDeclarationError(ValueError):
    pass


class ConstrainMismatch(ValueError):
    def __init__(self, path: str, reason: str) -> None:
        super().__init__(f"{path or '<root>'}: {reason}")
        self.path, self.reason = path, reason


def compile(node: dict, path: str = "constrain") -> dict:  # noqa: A001
    """The declaration, checked.  Raises ConstrainDeclarationError that names the bad node."""
    if not isinstance(node, dict) or node.get("type") not in TYPES:
        raise ConstrainDeclarationError(f"Invalid constrain declaration at {path}: unknown type")
    kind = node["type"]
    if kind == "string" and "pattern" in node:
        try:
            js.java_pattern(node["pattern"])
        except js.PatternError as e:
            raise ConstrainDeclarationError(f"Invalid constrain declaration at {path}.pattern: {e}") from e
    if kind == "enum" and not node.get("values"):
        raise ConstrainDeclarationError(f"Invalid constrain declaration at {path}.values: must not be empty")
    if kind == "array":
        compile(node.get("items"), f"{path}.items")
    for k, v in (node.get("shape") or {}).items() if kind == "object" else ():
        compile(v, f"{path}.shape.{k}")
    return node


def check(node: dict, value: Any, path: str = "") -> Any:
    """The value as the declaration projects it (undeclared keys of closed objects go).  Raises ConstrainMismatch."""
    if value is js.MISSING:
        if node.get("optional"):
            return value
        raise ConstrainMismatch(path, "is required")
    if value is None and node.get("nullable"):
        return None
    kind, number = node["type"], isinstance(value, (int, float)) and not isinstance(value, bool)

    def need(ok: bool, reason: str) -> None:
        if not ok:
            raise ConstrainMismatch(path, reason)

    if kind == "string":
        need(isinstance(value, str), "must be a string")
        need(js.utf16_length(value) >= node.get("minLength", 0), "is too short")
        need("maxLength" not in node or js.utf16_length(value) <= node["maxLength"], "is too long")
        need("pattern" not in node or js.search(node["pattern"], "", value), "does not match the pattern")
    elif kind == "number":
        need(number and value == value and abs(value) != float("inf"), "must be a finite number")
        need(not node.get("int") or float(value).is_integer(), "must be an integer")
        need("min" not in node or value >= node["min"], "is below the minimum")
        need("max" not in node or value <= node["max"], "is above the maximum")
    elif kind == "boolean":
        need(isinstance(value, bool), "must be a boolean")
    elif kind in ("literal", "enum"):
        need(any(js.same(value, v) for v in ([node["value"]] if kind == "literal" else node["values"])), "is not an allowed value")
    elif kind == "array":
        need(isinstance(value, list), "must be an array")
        need(len(value) >= node.get("minItems", 0), "has too few items")
        need("maxItems" not in node or len(value) <= node["maxItems"], "has too many items")
        return [check(node["items"], x, f"{path}[{i}]") for i, x in enumerate(value)]
    else:
        need(isinstance(value, dict), "must be an object")
        shape, out = node.get("shape") or {}, {}
        for k, inner in shape.items():
            got = check(inner, value.get(k, js.MISSING), f"{path}.{k}" if path else k)
            if got is not js.MISSING:
                out[k] = got
        extra = {k: v for k, v in value.items() if k not in shape}
        need(node.get("additionalProperties") is not False or not extra, f"has unknown keys: {', '.join(extra)}")
        return out | extra if node.get("additionalProperties") else out
    return value


def holds(node: dict, v: Column) -> Column:
    """Whether a variant satisfies the declaration: built-in expressions only."""
    kind = node["type"]
    if kind == "string":
        s = paths.string(v)
        ok = s.isNotNull()
        if node.get("minLength"):
            ok &= text.utf16_length(s) >= node["minLength"]
        if "maxLength" in node:
            ok &= text.utf16_length(s) <= node["maxLength"]
        if "pattern" in node:
            ok &= text.matches(s, node["pattern"])
    elif kind == "number":
        n = paths.number(v)
        ok = n.isNotNull()
        if node.get("int"):
            ok &= n == F.floor(n)
        if "min" in node:
            ok &= n >= float(node["min"])
        if "max" in node:
            ok &= n <= float(node["max"])
    elif kind == "boolean":
        ok = paths.kind(v) == "boolean"
    elif kind in ("literal", "enum"):
        ok = F.lit(False)
        for value in [node["value"]] if kind == "literal" else node["values"]:
            ok |= paths.equals(v, value)
    elif kind == "array":
        a = paths.items(v)
        ok = a.isNotNull() & (F.size(a) >= node.get("minItems", 0))
        if "maxItems" in node:
            ok &= F.size(a) <= node["maxItems"]
        ok &= F.forall(a, lambda x: holds(node["items"], x))
    else:
        ok = paths.kind(v) == "object"
        for k, inner in (node.get("shape") or {}).items():
            ok &= holds(inner, F.try_variant_get(v, "$['" + k.replace("'", "\\'") + "']", "variant"))
        if node.get("additionalProperties") is False:
            keys = F.json_object_keys(F.to_json(v))
            ok &= F.size(F.array_except(keys, F.array(*map(F.lit, node.get("shape") or {})).cast("array<string>"))) == 0
    ok = F.coalesce(ok, F.lit(False))
    if node.get("nullable"):
        ok = F.coalesce(paths.kind(v) == "null", F.lit(False)) | ok
    if node.get("optional"):
        ok = v.isNull() | ok
    return ok


def _projected(node: dict, v: Column) -> Column:
    kind = node["type"]
    if kind == "object":
        if node.get("additionalProperties"):
            raise ConstrainDeclarationError("Open objects have no column form")
        fields = []
        for k, inner in (node.get("shape") or {}).items():
            at = F.try_variant_get(v, "$['" + k.replace("'", "\\'") + "']", "variant")
            fields.append(F.when(at.isNotNull(), F.concat(F.lit(js.to_json(k) + ":"), _projected(inner, at))))
        out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif kind == "array":
        out = F.concat(F.lit("["), F.array_join(F.transform(paths.items(v), lambda x: _projected(node["items"], x)), ","), F.lit("]"))
    else:
        out = F.to_json(v)
    return F.when(paths.kind(v) == "null", "null").otherwise(out)


def columns(node: dict, v: Column) -> tuple[Column, Column]:
    """(the JSON text that ``check`` would give, or NULL; error kind, or NULL) of a variant."""
    ok = holds(node, v)
    return F.when(ok, _projected(node, v)), F.when(~ok, "constrain_mismatch")
