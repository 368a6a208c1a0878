"""Validation rules as columns: each rule compiles to an array of issues, so a rule set is one projection, no shuffle.

Patterns and scopes are compiled on the driver while the plan is made; a bad one gives its issue on every row that
reaches it instead of failing the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import js, paths, text
from weftwork.operators import rules as R

ISSUE = "struct<kind:string,path:string,message:string,hint:string,ruleName:string,similarityScore:double,similarityThreshold:double,similarityDistance:double,similarityStatus:string,similarityMode:string>"
NONE = f"array<{ISSUE}>"


def _no_issue() -> Column:
    return F.array().cast(NONE)


def _issue(rule: dict, kind: str | Column, message: str | Column, hint: bool = True, score: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    null = F.lit(None)
    limit = F.lit(float(rule["threshold"])) if score is not None else null
    distance = F.abs(score - limit) if score is not None else null
    status = F.when(distance <= R.CLOSE, "close").otherwise("far") if score is not None else null
    mode = F.lit((rule.get("similarity") or {}).get("mode", "fast")) if score is not None else null
    row = F.struct(lit(kind).alias("kind"), lit(rule.get("path")).alias("path"), lit(message).alias("message"), lit(rule.get("hint") if hint else None).alias("hint"), lit(rule.get("name")).alias("ruleName"), (null if score is None else score).alias("a"), limit.alias("b"), distance.alias("c"), status.alias("d"), mode.alias("e"))
    return F.array(row.cast(ISSUE))


def _missing(rule: dict, path: str | None, skip: bool, kind: str = "path_missing", hint: bool = True, what: str | None = None) -> Column:
    return _no_issue() if skip else _issue(rule, kind, what or f"Path '{path}' does not exist", hint)


def compile_rule(rule: dict, value: Column, refs: dict[str, Column] | None = None, skip_inapplicable: bool = False, score: Column | None = None) -> Column:
    """ARRAY of issues of one rule over a variant column.  refs: variant columns; NULL is not available.  score: a column
    that has the rule's similarity already."""
    target = paths.at(value, rule.get("path"))
    kind = rule["kind"]
    if kind in R.ARRAY_KINDS:
        own = paths.items(target)
        n = F.size(own)
        bad = n < rule["value"] if kind == "array_min_length" else n > rule["value"]
        say = F.concat(F.lit("Array length "), n.cast("string"), F.lit(f" {'is less than minimum' if kind == 'array_min_length' else 'exceeds maximum'} {rule['value']}"))
        out = F.when(own.isNull(), _issue(rule, "invalid_target_type", R.wrong_type(rule))).when(bad, _issue(rule, kind, say)).otherwise(_no_issue())
    elif kind in R.EQUAL_KINDS:
        same = paths.equals(target, rule["value"])
        out = F.when(same if kind == "equals" else ~same, _no_issue()).otherwise(_issue(rule, kind, R.message(rule)))
    elif kind in R.STRING_KINDS:
        own = paths.string(target)
        out = F.when(own.isNull(), _issue(rule, "invalid_target_type", R.wrong_type(rule))).otherwise(_string(rule, own))
    else:
        out = _comparison(rule, value, target, refs or {}, skip_inapplicable, score)
    if rule.get("path"):
        out = F.when(paths.present(target), out).otherwise(_missing(rule, rule["path"], skip_inapplicable))
    if when := rule.get("when"):
        at = paths.at(value, when.get("path"))
        holds = paths.equals(at, when["equals"]) if "equals" in when else ~paths.equals(at, when["notEquals"])
        out = F.when(at.isNull(), _missing(rule, when.get("path"), skip_inapplicable)).when(holds, out).otherwise(_no_issue())
    return out


def _string(rule: dict, own: Column) -> Column:
    kind = rule["kind"]
    say: str | Column
    if kind.endswith("contains"):
        bad, say = F.contains(own, F.lit(rule["value"])), R.message(rule)
        bad = ~bad if kind == "contains" else bad
    elif kind.endswith("regex"):
        try:
            bad = text.matches(own, rule["pattern"], rule.get("flags", ""))
        except js.PatternError as e:
            return _issue(rule, "invalid_regex_pattern", f"Invalid regex pattern '{rule['pattern']}': {e}")
        bad, say = (~bad if kind == "regex" else bad), R.message(rule)
    else:
        n = text.utf16_length(own)
        bad = n < rule["value"] if kind == "min_length" else n > rule["value"]
        say = F.concat(F.lit("Value length "), n.cast("string"), F.lit(f" {'is less than minimum' if kind == 'min_length' else 'exceeds maximum'} {rule['value']}"))
    return F.when(bad, _issue(rule, kind, say)).otherwise(_no_issue())


def _comparison(rule: dict, value: Column, target: Column, refs: dict[str, Column], skip: bool, score: Column | None = None) -> Column:
    kind = rule["kind"]
    to, other = R.other_of(rule)
    if to == "path":
        against, absent = paths.at(value, other), _missing(rule, other, skip, hint=False)
    else:
        parts = js.path_parts(other)
        if not parts:
            return _missing(rule, other, skip, "ref_missing", False, "Validator reference must not be empty")
        root = refs.get(parts[0])
        gone = _missing(rule, other, skip, "ref_missing", False, f"Reference '{parts[0]}' is not available in this validation context")
        if root is None:
            return gone
        against = paths.at(root, ".".join(parts[1:]))
        absent = F.when(root.isNull(), gone).otherwise(_missing(rule, ".".join(parts[1:]), skip, "ref_missing", False))
    left, right = paths.string(target), paths.string(against)
    try:
        (a, wrong_a), (b, wrong_b) = text.scoped(left, rule.get("scope")), text.scoped(right, rule.get("scope"))
    except js.PatternError as e:
        fixed = _issue(rule, "invalid_scope_pattern", f"Invalid scope pattern: {e}")
        return F.when(against.isNull(), absent).when(left.isNull() | right.isNull(), _issue(rule, "invalid_target_type", R.wrong_type(rule))).otherwise(fixed)
    wrong = F.coalesce(wrong_a, wrong_b)
    told = F.when(wrong == "scope_no_match", "Scope includePattern did not match any content").otherwise("Scoped comparison content is empty after applying scope patterns")
    if kind.startswith(R.CHANGE_KINDS):
        result = F.when(text.normalize(a) == text.normalize(b), _issue(rule, kind, R.message(rule))).otherwise(_no_issue())
    else:
        score = score if score is not None else text.similarity(a, b, (rule.get("similarity") or {}).get("mode", "fast"))
        bad = score > rule["threshold"] if kind.startswith("max") else score < rule["threshold"]
        how, (to, other) = ("exceeds maximum" if kind.startswith("max") else "is below minimum"), R.other_of(rule)
        say = F.concat(F.lit("Similarity "), F.round(score.cast("decimal(38,20)"), 3).cast("decimal(10,3)").cast("string"), F.lit(f" {how} {js.number_text(rule['threshold'])} when compared to {to} '{other}'"))
        result = F.when(bad, _issue(rule, kind, say, score=score)).otherwise(_no_issue())
    return (
        F.when(against.isNull(), absent)
        .when(left.isNull() | right.isNull(), _issue(rule, "invalid_target_type", R.wrong_type(rule)))
        .when(wrong.isNotNull(), _issue(rule, wrong, told))
        .otherwise(result)
    )


def issues(rules: list[dict], value: Column, refs: dict[str, Column] | None = None, skip_inapplicable: bool = False) -> Column:
    """The issues of all rules, in order; an empty array if the value passes."""
    if not rules:
        return _no_issue()
    return F.flatten(F.array(*[compile_rule(r, value, refs, skip_inapplicable) for r in rules]))


def with_issues(df: DataFrame, rules: list[dict], value: str, refs: dict[str, str] | None = None, to: str = "issues", skip_inapplicable: bool = False) -> DataFrame:
    """``df`` with the issues of all rules over the variant column ``value``.  Similarity scores become columns first, step
    by step (normal text, tokens, score), so that each is computed once a row however often an issue mentions it."""
    columns = {k: F.col(v) for k, v in (refs or {}).items()}
    scores: dict[int, str] = {}
    for i, rule in enumerate(rules):
        if not rule["kind"].startswith(R.SIMILARITY_KINDS):
            continue
        kind, other = R.other_of(rule)
        parts = js.path_parts(other)
        if kind == "ref" and (not parts or parts[0] not in columns):
            continue
        against = paths.at(F.col(value), other) if kind == "path" else paths.at(columns[parts[0]], ".".join(parts[1:]))
        try:
            sides = [text.normalize(text.scoped(paths.string(x), rule.get("scope"))[0]) for x in (paths.at(F.col(value), rule.get("path")), against)]
        except js.PatternError:
            continue
        a, b, scores[i] = f"_left_{i}", f"_right_{i}", f"_score_{i}"
        df = df.withColumns({a: sides[0], b: sides[1]})
        if (rule.get("similarity") or {}).get("mode", "fast") == "detailed":
            df = text.with_detailed_similarity(df, a, b, scores[i])
        else:
            df = df.withColumns({f"{a}t": text.tokens(F.col(a)), f"{b}t": text.tokens(F.col(b))})
            df = df.withColumns({f"{a}j": text.jaccard(F.col(f"{a}t"), F.col(f"{b}t")), f"{a}l": text.lcs_length(f"{a}t", f"{b}t")})
            longest = F.greatest(F.size(f"{a}t"), F.size(f"{b}t"))
            fast = F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(F.col(f"{a}j"), F.when(longest == 0, 1.0).otherwise(F.col(f"{a}l") / longest)))
            df = df.withColumn(scores[i], fast).drop(f"{a}t", f"{b}t", f"{a}j", f"{a}l")
        df = df.drop(a, b)
    each = [compile_rule(r, F.col(value), columns, skip_inapplicable, F.col(scores[i]) if i in scores else None) for i, r in enumerate(rules)]
    return df.withColumn(to, F.flatten(F.array(*each)) if each else _no_issue()).drop(*scores.values())
