"""Validation rules over one value, in Python: used where a rule's result decides the next model call.

``weftwork.operators.validators`` compiles the same rules to a column; tests hold the two together.
"""

from __future__ import annotations

from typing import Any

from weftwork.functions import js

STRING_KINDS = ("contains", "not_contains", "regex", "not_regex", "min_length", "max_length")
EQUAL_KINDS = ("equals", "not_equals")
CHANGE_KINDS = ("must_change_from", "not_equal_to")
SIMILARITY_KINDS = ("max_similarity_to", "min_similarity_to")
ARRAY_KINDS = ("array_min_length", "array_max_length")
COMPARISONS = tuple(f"{k}_{to}" for k in (*CHANGE_KINDS, *SIMILARITY_KINDS) for to in ("path", "ref"))
KINDS = (*STRING_KINDS, *EQUAL_KINDS, *COMPARISONS, *ARRAY_KINDS)
CLOSE = 0.05


def other_of(rule: dict) -> tuple[str, str]:
    """("path" or "ref", what the rule compares with)."""
    to = "path" if rule["kind"].endswith("_path") else "ref"
    return to, rule.get("otherPath" if to == "path" else "ref", "")


def message(rule: dict, shown: str = "") -> str:
    """What a failed rule says; shown: the measured length or score."""
    kind, v = rule["kind"], rule.get("value")
    if kind in COMPARISONS:
        to, other = other_of(rule)
        if kind.startswith("must_change"):
            return f"Value must differ from {'value at path' if to == 'path' else 'ref'} '{other}' after scoped comparison"
        if kind.startswith("not_equal_to"):
            return f"Value must not equal {'value at path' if to == 'path' else 'ref'} '{other}' after scoped comparison"
        how = "exceeds maximum" if kind.startswith("max") else "is below minimum"
        return f"Similarity {shown} {how} {js.number_text(rule['threshold'])} when compared to {to} '{other}'"
    return {
        "contains": f"Value does not contain required substring '{v}'",
        "not_contains": f"Value contains forbidden substring '{v}'",
        "regex": f"Value does not match regex '{rule.get('pattern')}'",
        "not_regex": f"Value matches forbidden regex '{rule.get('pattern')}'",
        "min_length": f"Value length {shown} is less than minimum {v}",
        "max_length": f"Value length {shown} exceeds maximum {v}",
        "equals": "Value is not equal to expected value",
        "not_equals": "Value must not equal forbidden value",
        "array_min_length": f"Array length {shown} is less than minimum {v}",
        "array_max_length": f"Array length {shown} exceeds maximum {v}",
    }[kind]


def wrong_type(rule: dict) -> str:
    kind = rule["kind"]
    if kind in ARRAY_KINDS:
        return f"Validator '{kind}' requires an array target"
    if kind in COMPARISONS:
        return f"Validator '{kind}' requires string values at path '{rule.get('path') or '<root>'}' and comparison {other_of(rule)[0]}"
    return f"Validator '{kind}' requires a string target"


def issue(rule: dict, kind: str, text: str, hint: bool = True, **more: Any) -> dict:
    out = {"kind": kind, "path": rule.get("path"), "message": text, "hint": rule.get("hint") if hint else None, "ruleName": rule.get("name")}
    return {k: v for k, v in (out | more).items() if v is not None}


def check(rule: dict, value: Any, refs: dict[str, Any] | None = None, skip_inapplicable: bool = False) -> list[dict]:
    """Issues of one rule, none or one."""
    kind = rule["kind"]
    when = rule.get("when")
    if when:
        try:
            got = js.get_path(value, when.get("path"))
        except js.PathError as e:
            return [] if skip_inapplicable else [issue(rule, "path_missing", str(e))]
        if js.same(got, when["equals"]) if "equals" in when else not js.same(got, when["notEquals"]):
            pass
        else:
            return []
    try:
        target = js.get_path(value, rule.get("path"))
    except js.PathError as e:
        return [] if skip_inapplicable else [issue(rule, "path_missing", str(e))]
    if kind in ARRAY_KINDS:
        if not isinstance(target, list):
            return [issue(rule, "invalid_target_type", wrong_type(rule))]
        ok = len(target) >= rule["value"] if kind == "array_min_length" else len(target) <= rule["value"]
        return [] if ok else [issue(rule, kind, message(rule, str(len(target))))]
    if kind in EQUAL_KINDS:
        return [] if js.same(target, rule["value"]) == (kind == "equals") else [issue(rule, kind, message(rule))]
    if kind in STRING_KINDS:
        return _check_string(rule, target)
    return _check_comparison(rule, value, target, refs or {}, skip_inapplicable)


def _check_string(rule: dict, target: Any) -> list[dict]:
    kind = rule["kind"]
    if not isinstance(target, str):
        return [issue(rule, "invalid_target_type", wrong_type(rule))]
    shown = ""
    if kind.endswith("contains"):
        ok = (rule["value"] in target) == (kind == "contains")
    elif kind.endswith("regex"):
        try:
            ok = js.search(rule["pattern"], rule.get("flags", ""), target) == (kind == "regex")
        except js.PatternError as e:
            return [issue(rule, "invalid_regex_pattern", f"Invalid regex pattern '{rule['pattern']}': {e}")]
    else:
        n = js.utf16_length(target)
        ok, shown = (n >= rule["value"] if kind == "min_length" else n <= rule["value"]), str(n)
    return [] if ok else [issue(rule, kind, message(rule, shown))]


def _check_comparison(rule: dict, value: Any, target: Any, refs: dict[str, Any], skip: bool) -> list[dict]:
    kind = rule["kind"]
    to, other = other_of(rule)
    try:
        against = js.get_path(value, other) if to == "path" else _ref(refs, other)
    except js.PathError as e:
        return [] if skip else [issue(rule, f"{to}_missing", str(e), hint=False)]
    if not isinstance(target, str) or not isinstance(against, str):
        return [issue(rule, "invalid_target_type", wrong_type(rule))]
    try:
        left, right = (js.scoped(x, rule.get("scope")) for x in (target, against))
    except js.ScopeError as e:
        return [issue(rule, e.kind, str(e))]
    if kind.startswith(CHANGE_KINDS):
        return [] if js.normalize(left) != js.normalize(right) else [issue(rule, kind, message(rule))]
    mode = (rule.get("similarity") or {}).get("mode", "fast")
    score, limit = js.similarity(left, right, mode), rule["threshold"]
    if score <= limit if kind.startswith("max") else score >= limit:
        return []
    distance = abs(score - limit)
    return [issue(rule, kind, message(rule, js.fixed3(score)), similarityScore=score, similarityThreshold=limit, similarityDistance=distance, similarityStatus="close" if distance <= CLOSE else "far", similarityMode=mode)]


def _ref(refs: dict[str, Any], name: str) -> Any:
    parts = js.path_parts(name)
    if not parts:
        raise js.PathError("Validator reference must not be empty")
    root = refs.get(parts[0], js.MISSING)
    if root is js.MISSING:
        raise js.PathError(f"Reference '{parts[0]}' is not available in this validation context")
    return js.get_path(root, ".".join(parts[1:]))


def validate(value: Any, rules: list[dict] | None, refs: dict[str, Any] | None = None, skip_inapplicable: bool = False) -> list[dict]:
    """The issues of all rules, in order."""
    return [i for r in rules or () for i in check(r, value, refs, skip_inapplicable)]
