"""Scalar semantics of the workflow language outside Spark: JSON text, numbers, patterns, text similarity.

Workflows define strings as UTF-16, one number type (double), Unicode blanks in ``\\s`` and trimming, and patterns of
the ECMAScript dialect.  These helpers keep to that on the driver and inside Arrow batches; ``weftwork.functions.text``
and ``weftwork.operators.validators`` say the same as Spark columns.
"""

from __future__ import annotations

import json
import math
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from typing import Any

import regex

#: ECMAScript white space and line ends, as the inside of a character class.
BLANKS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BLANK_SET = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: The words that content recall passes over.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "before", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of",
    "on", "or", "that", "the", "their", "there", "this", "to", "use", "when", "with", "you", "your",
)


class Missing:
    """The absent value, which is not null."""

    def __repr__(self) -> str:
        return "MISSING"

    def __bool__(self) -> bool:
        return False

    def __reduce__(self) -> str:
        return "MISSING"  # one object, on the executors too


MISSING = Missing()


class PatternError(ValueError):
    """A pattern or flag that cannot be compiled."""


def trim(text: str) -> str:
    return text.strip(_BLANK_SET)


def utf16_length(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def fixed3(x: float) -> str:
    """Three decimals of the exact binary value, ties away from zero."""
    return str(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_UP))


def number_text(x: float) -> str:
    """The shortest decimal form, with exponents only from 1e21 and below 1e-6."""
    if isinstance(x, int):
        x = float(x) if abs(x) > 1 << 53 else x
        if isinstance(x, int):
            return str(x)
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exp = Decimal(repr(x)).normalize().as_tuple()
    s, point = "".join(map(str, digits)), len(digits) + exp
    if -6 < point <= 21:
        s = s + "0" * (point - len(s)) if point >= len(s) else f"{s[:point]}.{s[point:]}" if point > 0 else "0." + "0" * -point + s
    else:
        s = s[0] + ("." + s[1:] if len(s) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + s if sign else s


def to_json(value: Any, indent: int = 0, level: int = 0) -> str:
    """JSON text of a value; keys keep their order."""
    if value is None or value is True or value is False:
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    pad, end = ("\n" + " " * indent * (level + 1), "\n" + " " * indent * level) if indent else ("", "")
    if isinstance(value, dict):
        parts = [to_json(k) + (": " if indent else ":") + to_json(v, indent, level + 1) for k, v in value.items() if v is not MISSING]
        return "{" + pad + ("," + pad).join(parts) + end + "}" if parts else "{}"
    parts = [to_json(None if v is MISSING else v, indent, level + 1) for v in value]
    return "[" + pad + ("," + pad).join(parts) + end + "]" if parts else "[]"


def _refuse(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


def parse_json(text: str) -> Any:
    """Strict JSON: no NaN, no Infinity, nothing after the value; the last of equal keys counts."""
    return json.loads(text.strip("\t\n\r "), parse_constant=_refuse)


def same(a: Any, b: Any) -> bool:
    """Equality without conversion; two containers are never equal."""
    if isinstance(a, (dict, list)) or isinstance(b, (dict, list)):
        return False
    if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None or a is MISSING or b is MISSING:
        return a is b
    if isinstance(a, str) != isinstance(b, str):
        return False
    return a == b


# --- patterns ----------------------------------------------------------------------------------------------------


@lru_cache(4096)
def java_pattern(pattern: str, flags: str = "") -> str:
    """An ECMAScript pattern as one that Java's and Python's engines read alike.  Raises PatternError."""
    if any(f not in "dgimsuvy" for f in flags) or len(set(flags)) < len(flags) or {"u", "v"} <= set(flags):
        raise PatternError(f"invalid flags {flags!r}")
    out, i, inside = [], 0, False
    dot = r"[\s\S]" if "s" in flags else r"[^\n\r\u2028\u2029]"
    classes = {"d": "0-9", "w": "A-Za-z0-9_", "s": BLANKS}
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            i += 2
            if n in "dws":
                out.append(classes[n] if inside else f"[{classes[n]}]")
            elif n in "DW":
                out.append("\\" + n)
            elif n == "S":
                out.append(r"\S" if inside else f"[^{BLANKS}]")
            elif n == "v":
                out.append(r"\x0B")
            elif n == "0":
                out.append(r"\x00")
            elif n == "/" or n == "-" and not inside:
                out.append(n)
            elif n == "u" and i < len(pattern) and pattern[i] == "{":
                end = pattern.find("}", i)
                out.append(_code_point(int(pattern[i + 1 : end], 16)))
                i = end + 1
            else:
                out.append("\\" + n)
            continue
        if inside:
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
            inside = c != "]"
        elif c == "[":
            if pattern.startswith("[^]", i):
                out.append(r"[\s\S]")
                i += 2
            elif pattern.startswith("[]", i):
                out.append("(?!)")
                i += 1
            else:
                inside = True
                out.append(c)
                if pattern.startswith("^", i + 1):
                    out.append("^")
                    i += 1
        elif c == ".":
            out.append(dot)
        elif c == "$":
            out.append(r"(?=[\n\r\u2028\u2029]|\z)" if "m" in flags else r"\z")
        elif c == "^":
            out.append(r"(?<![^\n\r\u2028\u2029])" if "m" in flags else r"\A")
        else:
            out.append(c)
        i += 1
    text = ("(?iu)" if "i" in flags else "") + "".join(out)
    compiled(text)
    return text


def _code_point(n: int) -> str:
    return f"\\u{n:04X}" if n < 0x10000 else regex.escape(chr(n))


@lru_cache(4096)
def compiled(java: str) -> regex.Pattern:
    try:
        return regex.compile(java.replace(r"\z", r"\Z"), regex.V0)
    except (regex.error, ValueError) as e:
        raise PatternError(str(e)) from e


def search(pattern: str, flags: str, text: str) -> bool:
    return compiled(java_pattern(pattern, flags)).search(text) is not None


# --- scoped text -------------------------------------------------------------------------------------------------

_SPACES = regex.compile(f"[{BLANKS}]+")
_NO_WORD = regex.compile(rf"[^\p{{L}}\p{{N}}{BLANKS}]+")


def collapse(text: str) -> str:
    return trim(_SPACES.sub(" ", text))


def normalize(text: str) -> str:
    return collapse(_NO_WORD.sub(" ", text.lower()))


def tokens(normal: str) -> list[str]:
    return [t for t in normal.split(" ") if t]


class ScopeError(ValueError):
    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


def scoped(text: str, scope: dict | None) -> str:
    """The part of a text that a scope leaves."""
    if not scope:
        return text
    try:
        if include := scope.get("includePattern"):
            found = [m[0] for m in compiled(java_pattern(include["pattern"], include.get("flags", ""))).finditer(text) if m[0]]
            if not found:
                raise ScopeError("scope_no_match", "Scope includePattern did not match any content")
            text = " ".join(found)
        for exclude in scope.get("excludePatterns") or ():
            text = compiled(java_pattern(exclude["pattern"], exclude.get("flags", ""))).sub(" ", text)
    except PatternError as e:
        raise ScopeError("invalid_scope_pattern", f"Invalid scope pattern: {e}") from e
    text = collapse(text)
    if not text:
        raise ScopeError("scope_empty", "Scoped comparison content is empty after applying scope patterns")
    return text


# --- similarity --------------------------------------------------------------------------------------------------


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, a bit for each token of ``b``: a row of the table is one addition."""
    at: dict[str, int] = {}
    for i, t in enumerate(b):
        at[t] = at.get(t, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        u = row & at.get(t, 0)
        row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def _overlap(a: set, b: set) -> tuple[int, int]:
    return len(a & b), len(a) + len(b)


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    return 1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / len(x | y)


def fast_similarity(left: str, right: str) -> float:
    left, right = normalize(left), normalize(right)
    if left == right:
        return 1.0
    a, b = tokens(left), tokens(right)
    longest = max(len(a), len(b))
    return max(jaccard(a, b), lcs_length(a, b) / longest if longest else 1.0)


def dice(a: set, b: set) -> float:
    both, total = _overlap(a, b)
    return 1.0 if not a and not b else 0.0 if not a or not b else 2 * both / total


def bigrams(t: list[str]) -> set:
    return set(zip(t, t[1:], strict=False))


def trigrams(normal: str) -> set:
    raw = normal.encode("utf-16-le")
    return {raw[i : i + 6] for i in range(0, len(raw) - 5, 2)}


def content_recall(a: list[str], b: list[str], fast: float) -> float:
    x, y = set(a) - set(STOP_WORDS), set(b) - set(STOP_WORDS)
    if not x and not y:
        return fast
    return min(len(x & y) / len(x), len(x & y) / len(y)) if x and y else 0.0


def detailed_similarity(left: str, right: str) -> float:
    fast = fast_similarity(left, right)
    if fast == 1:
        return 1.0
    left, right = normalize(left), normalize(right)
    a, b = tokens(left), tokens(right)
    mixed = 0.35 * fast + 0.25 * dice(bigrams(a), bigrams(b)) + 0.2 * dice(trigrams(left), trigrams(right)) + 0.2 * content_recall(a, b, fast)
    return min(1.0, max(0.0, mixed))


def similarity(left: str, right: str, mode: str = "fast") -> float:
    return detailed_similarity(left, right) if mode == "detailed" else fast_similarity(left, right)


# --- paths -------------------------------------------------------------------------------------------------------


class PathError(KeyError):
    def __str__(self) -> str:
        return str(self.args[0])


def path_parts(path: str | None) -> list[str]:
    return [p for p in map(trim, (path or "").split(".")) if p]


def get_path(value: Any, path: str | None) -> Any:
    """The value at a dot path; only objects are entered, and present nulls are values."""
    for part in path_parts(path):
        if not isinstance(value, dict):
            raise PathError(f"Path '{path}' is not traversable at '{part}'")
        if part not in value:
            raise PathError(f"Path '{path}' does not exist")
        value = value[part]
    return value


def set_path(value: Any, path: str | None, new: Any, create: bool) -> Any:
    """A copy with ``new`` at the path.  create: make objects on the way; else the path must be there."""
    parts = path_parts(path)
    if not parts:
        return new
    if not create:
        get_path(value, path)
    out = dict(value) if isinstance(value, dict) else None
    at = out
    for i, part in enumerate(parts):
        if not isinstance(at, dict):
            raise PathError(f"Path '{path}' is not traversable at '{part}'")
        if i == len(parts) - 1:
            at[part] = new
        else:
            inner = at.get(part, {} if create else MISSING)
            at[part] = dict(inner) if isinstance(inner, dict) else inner
            at = at[part]
    return out
