"""Queries for every operator of the workflow engine, with SQL that gives the same rows."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.functions import js, model_json, paths, text
from weftwork.functions.template import TextTemplate
from weftwork.operators import constrain, remap, rewrite, validators
from weftwork.plans import dag, prompts
from weftwork.plans.engine import StageEngine, StageError
from weftwork.plans.model import ModelError, ModelOptions, StubClient
from weftwork.plans.runtime import WorkflowRunner
from weftwork.sources import records as rec
from weftwork.sources.scratch import scratch_path
from weftwork.streaming.record_stream import run_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _tok(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


# --- text --------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len({_tok(_norm('text'))})::BIGINT AS n_tokens, len(list_distinct({_tok(_norm('text'))}))::BIGINT AS n_distinct FROM documents")
def tokenize_text(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", text.tokens(text.normalize(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(r"SELECT doc_id, length(text)::BIGINT AS units, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def utf16_and_collapse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.utf16_length(F.col("text")).cast("long").alias("units"), F.md5(text.collapse(F.col("text")).cast("binary")).alias("digest"))


def same_role_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, a, b): each turn's text and the last before it of the same role, normalised."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    pairs = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null and text is not null")
    return pairs.select("conv_id", "turn", text.normalize(F.col("text")).alias("a"), text.normalize(F.col("before")).alias("b"))


_PAIRS = f"""WITH RECURSIVE w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations),
p AS (SELECT conv_id, turn, {_norm('text')} AS a, {_norm('before')} AS b FROM w WHERE before IS NOT NULL AND text IS NOT NULL),
t AS (SELECT *, {_tok('a')} AS ta, {_tok('b')} AS tb FROM p)"""
_SETS = "len(list_intersect(list_distinct({0}), list_distinct({1})))"


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / (len(list_distinct({a})) + len(list_distinct({b})) - {both}) END"


def _dice(a: str, b: str) -> str:
    both = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE (2 * {both})::DOUBLE / (len(list_distinct({a})) + len(list_distinct({b}))) END"


_LCS = """,
r AS (SELECT conv_id, turn, ta, tb, 0 AS i, list_transform(range(0, len(tb) + 1), lambda x: 0) AS row FROM t
  UNION ALL
  SELECT conv_id, turn, ta, tb, i + 1, list_concat([0], list_transform(range(1, len(tb) + 1), lambda j: list_max(q[1:j])))
  FROM (SELECT *, list_transform(range(1, len(tb) + 1), lambda j: CASE WHEN ta[i + 1] = tb[j] THEN row[j] + 1 ELSE row[j + 1] END) AS q FROM r WHERE i < len(ta))),
l AS (SELECT conv_id, turn, row[len(tb) + 1] AS lcs FROM r WHERE i = len(ta)),"""
_FAST = f"""
f AS (SELECT t.*, lcs, CASE WHEN greatest(len(ta), len(tb)) = 0 THEN 1.0::DOUBLE ELSE lcs::DOUBLE / greatest(len(ta), len(tb)) END AS overlap, {_jac('ta', 'tb')} AS jac FROM t JOIN l USING (conv_id, turn)),
g AS (SELECT *, CASE WHEN a = b THEN 1.0::DOUBLE ELSE greatest(jac, overlap) END AS fast FROM f)"""
_BI = "list_transform(range(1, len({0})), lambda i: {0}[i] || '|' || {0}[i + 1])"
_TRI = "list_transform(range(1, length({0})::BIGINT - 1), lambda i: substr({0}, i, 3))"
_STOPS = "[" + ", ".join(f"'{w}'" for w in js.STOP_WORDS) + "]"
_CONTENT = f"list_filter(list_distinct({{0}}), lambda x: NOT list_contains({_STOPS}, x))"


@query(_PAIRS + f" SELECT conv_id, turn, {_jac('ta', 'tb')} AS jaccard FROM t")
def jaccard_prev_same_role(spark, sf):
    return same_role_pairs(spark, sf).select("conv_id", "turn", text.jaccard(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("jaccard"))


@query(_PAIRS + _LCS + _FAST + " SELECT conv_id, turn, lcs::BIGINT AS lcs, overlap FROM g")
def lcs_overlap(spark, sf):
    t = same_role_pairs(spark, sf).select("conv_id", "turn", text.tokens(F.col("a")).alias("a"), text.tokens(F.col("b")).alias("b"))
    return t.select("conv_id", "turn", text.lcs_length("a", "b").cast("long").alias("lcs"), text.overlap(F.col("a"), F.col("b")).alias("overlap"))


@query(_PAIRS + _LCS + _FAST + " SELECT conv_id, turn, fast FROM g")
def similarity_fast(spark, sf):
    return same_role_pairs(spark, sf).select("conv_id", "turn", text.fast_similarity(F.col("a"), F.col("b")).alias("fast"))


@query(_PAIRS + f" SELECT conv_id, turn, {_dice('x', 'y')} AS dice FROM (SELECT *, {_BI.format('ta')} AS x, {_BI.format('tb')} AS y FROM t)")
def bigram_dice(spark, sf):
    return same_role_pairs(spark, sf).select("conv_id", "turn", text.dice(text.bigrams(text.tokens(F.col("a"))), text.bigrams(text.tokens(F.col("b")))).alias("dice"))


@query(_PAIRS + f" SELECT conv_id, turn, {_dice('x', 'y')} AS dice FROM (SELECT *, {_TRI.format('a')} AS x, {_TRI.format('b')} AS y FROM t)")
def trigram_dice(spark, sf):
    return same_role_pairs(spark, sf).select("conv_id", "turn", text.dice(text.trigrams(F.col("a")), text.trigrams(F.col("b"))).alias("dice"))


@query(_PAIRS + f""" SELECT conv_id, turn, {_dice('x', 'y')} AS dice FROM (SELECT *, {_TRI.format('a2')} AS x, {_TRI.format('b2')} AS y
  FROM (SELECT *, replace(a, 'e', chr(57344) || chr(57345)) AS a2, replace(b, 'e', chr(57344) || chr(57345)) AS b2 FROM t))""")
def trigram_dice_utf16(spark, sf):
    """Each e as a script letter beyond the basic plane, which is two units; the SQL has two private characters in its place."""
    a, b = (F.replace(F.col(c), F.lit("e"), F.lit("\U0001D452")) for c in "ab")
    return same_role_pairs(spark, sf).select("conv_id", "turn", text.dice(text.trigrams(a), text.trigrams(b)).alias("dice"))


_RECALL = "CASE WHEN len(x) = 0 AND len(y) = 0 THEN fast WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE least(len(list_intersect(x, y))::DOUBLE / len(x), len(list_intersect(x, y))::DOUBLE / len(y)) END"


@query(_PAIRS + _LCS + _FAST + f" SELECT conv_id, turn, {_RECALL} AS recall FROM (SELECT *, {_CONTENT.format('ta')} AS x, {_CONTENT.format('tb')} AS y FROM g)")
def content_recall(spark, sf):
    p = same_role_pairs(spark, sf).withColumn("fast", text.fast_similarity(F.col("a"), F.col("b")))
    return p.select("conv_id", "turn", text.content_recall(text.tokens(F.col("a")), text.tokens(F.col("b")), F.col("fast")).alias("recall"))


@query(
    _PAIRS + _LCS + _FAST + f""", h AS (SELECT *, {_CONTENT.format('ta')} AS x, {_CONTENT.format('tb')} AS y, {_BI.format('ta')} AS ba, {_BI.format('tb')} AS bb, {_TRI.format('a')} AS ca, {_TRI.format('b')} AS cb FROM g)
    SELECT conv_id, turn, CASE WHEN fast = 1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE,
      0.35::DOUBLE * fast + 0.25::DOUBLE * ({_dice('ba', 'bb')}) + 0.2::DOUBLE * ({_dice('ca', 'cb')}) + 0.2::DOUBLE * ({_RECALL}))) END AS detailed FROM h"""
)
def similarity_detailed(spark, sf):
    return text.with_detailed_similarity(same_role_pairs(spark, sf), "a", "b", "detailed").select("conv_id", "turn", "detailed")


_TAGS = {"includePattern": {"pattern": "<p>[^<]*</p>"}}
_NO_TAGS = {"excludePatterns": [{"pattern": "<script[^>]*>[^<]*</script>", "flags": "i"}, {"pattern": "<[^>]*>"}]}
_KIND = "CASE WHEN c = '' THEN 'scope_empty' END"


@query(r"""WITH s AS (SELECT page_id, regexp_extract_all(html, '<p>[^<]*</p>') AS m FROM pages)
SELECT page_id, CASE WHEN len(m) = 0 THEN 'scope_no_match' END AS issue, md5(trim(regexp_replace(array_to_string(m, ' '), '\s+', ' ', 'g'))) AS digest FROM s""")
def scope_include(spark, sf):
    c, wrong = text.scoped(F.col("html"), _TAGS)
    return table(spark, sf, "pages").select("page_id", wrong.alias("issue"), F.md5(c.cast("binary")).alias("digest"))


@query(r"""WITH s AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[^>]*>[^<]*</script>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM pages)
SELECT page_id, CASE WHEN c = '' THEN 'scope_empty' END AS issue, md5(c) AS digest FROM s""")
def scope_exclude(spark, sf):
    c, wrong = text.scoped(F.col("html"), _NO_TAGS)
    return table(spark, sf, "pages").select("page_id", wrong.alias("issue"), F.md5(c.cast("binary")).alias("digest"))


# --- validators --------------------------------------------------------------------------------------------------


def judged(df: DataFrame, keys: list[str], record: Column, rules: list[dict], refs: dict[str, Column] | None = None, skip: bool = False) -> DataFrame:
    """keys, n_issues and the first issue's kind of ``rules`` over a record column."""
    v = df.select(*keys, paths.parse(record).alias("v"), *[paths.parse(c).alias(f"ref_{k}") for k, c in (refs or {}).items()])
    out = validators.with_issues(v, rules, "v", {k: f"ref_{k}" for k in refs or {}}, "i", skip)
    return out.select(*keys, F.size("i").cast("long").alias("n_issues"), F.get("i", F.lit(0))["kind"].alias("first_kind"))


def _verdict(kind: str, bad: str, keys: str, source: str, prefix: str = "") -> str:
    return f"{prefix} SELECT {keys}, ({bad})::INT::BIGINT AS n_issues, CASE WHEN {bad} THEN '{kind}' END AS first_kind FROM {source}"


def _on_documents(rule: dict, bad: str) -> None:
    name = f"val_{rule['kind']}"

    @query(_verdict(rule["kind"], bad, "doc_id", "documents"), name)
    def run(spark, sf):
        return judged(table(spark, sf, "documents"), ["doc_id"], F.to_json(F.struct("text", "lang")), [rule])


_on_documents({"kind": "contains", "path": "text", "value": "the"}, "NOT contains(text, 'the')")
_on_documents({"kind": "not_contains", "path": "text", "value": "###"}, "contains(text, '###')")
_on_documents({"kind": "regex", "path": "text", "pattern": r"^[A-Z].*\.$", "flags": "s"}, r"NOT regexp_matches(text, '(?s)\A[A-Z].*\.\z')")
_on_documents({"kind": "not_regex", "path": "text", "pattern": r"\d{3}-\d{4}"}, "regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
_on_documents({"kind": "min_length", "path": "text", "value": 500}, "length(text) < 500")
_on_documents({"kind": "max_length", "path": "text", "value": 4000}, "length(text) > 4000")
_on_documents({"kind": "equals", "path": "lang", "value": "en"}, "lang IS DISTINCT FROM 'en'")
_on_documents({"kind": "not_equals", "path": "lang", "value": "en"}, "lang IS NOT DISTINCT FROM 'en'")

_TURN = "WITH p AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations)"


def _on_turns(rule: dict, bad: str) -> None:
    @query(_verdict(rule["kind"], bad, "conv_id, turn", "p", _TURN), f"val_{rule['kind']}")
    def run(spark, sf):
        w = Window.partitionBy("conv_id").orderBy("turn")
        df = table(spark, sf, "conversations").withColumn("before", F.coalesce(F.lag("text").over(w), F.lit("")))
        record, other = F.to_json(F.struct("text", "before")), F.to_json(F.struct(F.col("before").alias("text")))
        return judged(df, ["conv_id", "turn"], record, [rule], {"previous_turn": other} if rule["kind"].endswith("_ref") else None)


_SAME = f"{_norm('text')} = {_norm('before')}"
for _kind in ("must_change_from", "not_equal_to"):
    _on_turns({"kind": f"{_kind}_path", "path": "text", "otherPath": "before"}, _SAME)
    _on_turns({"kind": f"{_kind}_ref", "path": "text", "ref": "previous_turn.text"}, _SAME)

_SIM = _PAIRS.replace("WITH RECURSIVE w AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations)", "WITH RECURSIVE w AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations)") + _LCS + _FAST
for _kind, _limit, _bad in (("max", 0.25, "fast > 0.25"), ("min", 0.12, "fast < 0.12")):
    for _to in ("path", "ref"):
        _rule = {"kind": f"{_kind}_similarity_to_{_to}", "path": "text", "threshold": _limit, **({"otherPath": "before"} if _to == "path" else {"ref": "previous_turn.text"})}
        _on_turns(_rule, _bad)
        SQL[f"val_{_rule['kind']}"] = f"{_SIM} SELECT conv_id, turn, ({_bad})::INT::BIGINT AS n_issues, CASE WHEN {_bad} THEN '{_rule['kind']}' END AS first_kind FROM g"


def _on_arrays(kind: str, value: int, bad: str) -> None:
    @query(f"SELECT conv_id, ({bad})::INT::BIGINT AS n_issues, CASE WHEN {bad} THEN '{kind}' END AS first_kind FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)", f"val_{kind}")
    def run(spark, sf):
        return judged(rec.turns_table(table(spark, sf, "conversations")), ["conv_id"], F.to_json(F.struct("turns")), [{"kind": kind, "path": "turns", "value": value}])


_on_arrays("array_min_length", 5, "n < 5")
_on_arrays("array_max_length", 6, "n > 6")


def _events(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    return table(spark, sf, "events"), F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), F.coalesce("props", F.lit("null")), F.lit("}"))


@query("""SELECT event_id, (event_type = 'click' AND (props->>'k')::INT <> 7)::INT::BIGINT AS n_issues, CASE WHEN event_type = 'click' AND (props->>'k')::INT <> 7 THEN 'equals' END AS first_kind FROM events""")
def val_when_gate(spark, sf):
    df, record = _events(spark, sf)
    return judged(df, ["event_id"], record, [{"kind": "equals", "path": "props.k", "value": 7, "when": {"path": "type", "equals": "click"}}])


@query("SELECT event_id, 1::BIGINT AS n_issues, 'path_missing' AS first_kind FROM events")
def val_path_missing(spark, sf):
    df, record = _events(spark, sf)
    return judged(df, ["event_id"], record, [{"kind": "contains", "path": "props.none", "value": "x"}])


@query("SELECT event_id, 0::BIGINT AS n_issues, NULL::VARCHAR AS first_kind FROM events")
def val_skip_inapplicable(spark, sf):
    df, record = _events(spark, sf)
    return judged(df, ["event_id"], record, [{"kind": "contains", "path": "props.none", "value": "x"}], skip=True)


@query("SELECT event_id, 2::BIGINT AS n_issues, 'invalid_target_type' AS first_kind FROM events")
def val_type_mismatch(spark, sf):
    df, record = _events(spark, sf)
    return judged(df, ["event_id"], record, [{"kind": "min_length", "path": "props.k", "value": 1}, {"kind": "regex", "path": "type", "pattern": "("}])


@query("SELECT conv_id, turn, 1::BIGINT AS n_issues, 'ref_missing' AS first_kind FROM conversations")
def val_ref_missing(spark, sf):
    rule = {"kind": "not_equal_to_ref", "path": "text", "ref": "previous_turn.text"}
    return judged(table(spark, sf, "conversations"), ["conv_id", "turn"], F.to_json(F.struct("text")), [rule])


_MIXED_KINDS = """CASE event_id % 5 WHEN 0 THEN [CASE WHEN NOT contains(event_type, 'i') THEN 'contains' END, 'invalid_regex_pattern', 'invalid_scope_pattern', CASE WHEN event_id % 2 = 1 THEN 'ref_missing' WHEN event_type = 'view' THEN 'not_equal_to_ref' END]
  WHEN 2 THEN ['path_missing', 'path_missing', 'path_missing', 'path_missing'] WHEN 4 THEN [NULL, 'invalid_regex_pattern', 'invalid_scope_pattern', CASE WHEN event_id % 2 = 1 THEN 'ref_missing' END]
  ELSE ['invalid_target_type', 'invalid_target_type', 'invalid_target_type', CASE WHEN event_id % 2 = 1 THEN 'ref_missing' ELSE 'invalid_target_type' END] END"""


@query(f"SELECT event_id, array_to_string(list_filter({_MIXED_KINDS}, lambda x: x IS NOT NULL), ',') AS kinds FROM events")
def val_issue_kinds(spark, sf):
    """Four rules over records whose field is a string, a number, missing or null, half of them with a reference."""
    k = F.get_json_object("props", "$.k")
    shapes = [F.concat(F.lit('{"t": "'), "event_type", F.lit('"}')), F.concat(F.lit('{"t": '), k, F.lit("}")), F.concat(F.lit('{"n": '), k, F.lit("}")), F.lit('{"t": null}'), F.lit('{"t": "click"}')]
    df = table(spark, sf, "events").withColumn("other", F.when(F.col("event_id") % 2 == 0, '{"t": "view"}'))
    v = df.select("event_id", paths.parse(F.element_at(F.array(*shapes), (F.col("event_id") % 5 + 1).cast("int"))).alias("v"), paths.parse(F.col("other")).alias("o"))
    rules = [{"kind": "contains", "path": "t", "value": "i"}, {"kind": "regex", "path": "t", "pattern": "("},
             {"kind": "not_equal_to_path", "path": "t", "otherPath": "t", "scope": {"includePattern": {"pattern": "("}}}, {"kind": "not_equal_to_ref", "path": "t", "ref": "other.t"}]
    out = validators.with_issues(v, rules, "v", {"other": "o"}, "i")
    return out.select("event_id", F.array_join(F.transform("i", lambda x: x["kind"]), ",").alias("kinds"))


_WORD = "regexp_extract({}, '^[A-Za-z0-9_]+')"


@query(
    _TURN.replace("SELECT conv_id, turn, text", "SELECT conv_id, turn, role, text") + f""", f AS (SELECT *, {_WORD.format('text')} AS x, {_WORD.format('before')} AS y FROM p)
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN role <> 'user' AND length(text) < 60 THEN 'min_length:say more:long' END,
      CASE WHEN x = '' OR y = '' THEN 'scope_no_match::' WHEN {_norm('x')} = {_norm('y')} THEN 'not_equal_to_path::' END], lambda i: i IS NOT NULL), ',') AS issues FROM f"""
)
def val_when_scope_hint(spark, sf):
    """A rule for all but one role, with hint and name, and a comparison of first words."""
    df = table(spark, sf, "conversations").withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    rules = [{"kind": "min_length", "path": "text", "value": 60, "hint": "say more", "name": "long", "when": {"path": "role", "notEquals": "user"}},
             {"kind": "not_equal_to_path", "path": "text", "otherPath": "before", "scope": {"includePattern": {"pattern": "^\\w+"}}}]
    v = df.select("conv_id", "turn", paths.parse(F.to_json(F.struct("role", "text", "before"))).alias("v"))
    out = validators.with_issues(v, rules, "v", {}, "i")
    said = F.transform("i", lambda x: F.concat(x["kind"], F.lit(":"), F.coalesce(x["hint"], F.lit("")), F.lit(":"), F.coalesce(x["ruleName"], F.lit(""))))
    return out.select("conv_id", "turn", F.array_join(said, ",").alias("issues"))


@query(f"""SELECT conv_id, turn, coalesce(detailed > 0.2, FALSE)::INT::BIGINT AS n_issues, CASE WHEN detailed > 0.2 THEN 'max_similarity_to_ref' END AS first_kind
FROM conversations LEFT JOIN ({SQL['similarity_detailed']}) USING (conv_id, turn)""")
def val_detailed_similarity(spark, sf):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    df = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w))
    other = F.when(F.col("before").isNotNull(), F.to_json(F.struct(F.col("before").alias("text"))))
    rule = {"kind": "max_similarity_to_ref", "path": "text", "ref": "r.text", "threshold": 0.2, "similarity": {"mode": "detailed"}}
    return judged(df, ["conv_id", "turn"], F.to_json(F.struct("text")), [rule], {"r": other}, skip=True)


_FLAGSHIP = [{"kind": "min_length", "path": "text", "value": 40}, {"kind": "not_regex", "path": "text", "pattern": "###|\\$\\$\\$"}, {"kind": "max_similarity_to_ref", "path": "text", "ref": "previous_same_role_turn.text", "threshold": 0.3}]


@query(
    f"""{_PAIRS}{_LCS}{_FAST}, j AS (SELECT c.conv_id, c.turn, length(c.text) < 40 AS x, regexp_matches(c.text, '###|[$][$][$]') AS y, coalesce(fast > 0.3, FALSE) AS z FROM conversations c LEFT JOIN g USING (conv_id, turn))
    SELECT conv_id, turn, (x::INT + y::INT + z::INT)::BIGINT AS n_issues, CASE WHEN x THEN 'min_length' WHEN y THEN 'not_regex' WHEN z THEN 'max_similarity_to_ref' END AS first_kind FROM j"""
)
def validate_turns(spark, sf):
    """The first query: records of turns, three rules, one of them against the last turn of the same role."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    df = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w))
    other = F.when(F.col("before").isNotNull(), F.to_json(F.struct(F.col("before").alias("text"))))
    return judged(df, ["conv_id", "turn"], F.to_json(F.struct("text")), _FLAGSHIP, {"previous_same_role_turn": other}, skip=True)


@query("""WITH w AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, md5(a) AS previous_turn, md5(b) AS previous_same_role_turn FROM w""")
def turn_refs(spark, sf):
    a, b = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id", "role").orderBy("turn")
    digest = lambda w: F.md5(F.lag("text").over(w).cast("binary"))
    return table(spark, sf, "conversations").select("conv_id", "turn", digest(a).alias("previous_turn"), digest(b).alias("previous_same_role_turn"))


# --- records -----------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 300 OFFSET 120)")
def slice_offset_limit(spark, sf):
    return rec.slice_records(rec.ordered(table(spark, sf, "documents").select("doc_id"), "doc_id"), 120, 300).select(F.col("_ord").alias("ord"), "doc_id")


@query("SELECT event_id, (props->>'k')::BIGINT AS k, TRUE AS there, 'number' AS kind, FALSE AS missing_there FROM events")
def path_get_props(spark, sf):
    df, record = _events(spark, sf)
    v = df.select("event_id", paths.parse(record).alias("v"))
    k = paths.at(F.col("v"), "props.k")
    return v.select("event_id", paths.number(k).cast("long").alias("k"), paths.present(k).alias("there"), paths.kind(k).alias("kind"), paths.present(paths.at(F.col("v"), "props.k.z")).alias("missing_there"))


def _prefixed(spark: SparkSession, sf: str) -> DataFrame:
    turns = rec.turns_table(table(spark, sf, "conversations"))
    said = F.transform("turns", lambda t: F.concat(F.lit("  "), t["role"], F.lit(": "), t["text"], F.lit(" ")))
    return turns.select("conv_id", F.to_json(F.struct("conv_id", said.alias("said"))).alias("_json"))


_PREFIXES = {"kind": "prefixed_string_array", "sourcePath": "said", "prefixes": {"user": "user:", "assistant": "assistant:", "system": "system:"}}


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS idx, role, md5(trim(text)) AS digest FROM conversations")
def remap_prefixed(spark, sf):
    v = _prefixed(spark, sf).select("conv_id", remap.turns_of(paths.parse(F.col("_json")), _PREFIXES)[0].alias("t"))
    return v.select("conv_id", F.posexplode("t").alias("idx", "x")).select("conv_id", F.col("idx").cast("long").alias("idx"), "x.role", F.md5(F.col("x.content").cast("binary")).alias("digest"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS idx, role, md5(trim(text)) AS digest FROM conversations")
def remap_prefixed_records(spark, sf):
    """The same through records: turns are written into the JSON and read from there."""
    source = rec.ordered(_prefixed(spark, sf), "conv_id").select("_ord", "_json")
    done = remap.remap(source, _PREFIXES)
    row = F.from_json("_json", "conv_id long, conversations array<struct<from:string,value:string>>")
    return done.select(row.alias("r")).select("r.conv_id", F.posexplode("r.conversations").alias("idx", "x")).select("conv_id", F.col("idx").cast("long").alias("idx"), F.col("x.from").alias("role"), F.md5(F.col("x.value").cast("binary")).alias("digest"))


@query("""WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'system') AS sys, arg_min(text, turn) FILTER (role = 'user') AS usr, arg_min(text, turn) FILTER (role = 'assistant') AS asst FROM conversations GROUP BY conv_id),
k AS (SELECT * FROM f WHERE usr IS NOT NULL AND asst IS NOT NULL)
SELECT conv_id, CASE WHEN sys IS NOT NULL THEN 3 ELSE 2 END::BIGINT AS n, CASE WHEN sys IS NOT NULL THEN 'system' ELSE 'user' END AS first_role, md5(coalesce(sys, usr)) AS digest FROM k""")
def remap_alpaca(spark, sf):
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(first("system").alias("s"), first("user").alias("u"), first("assistant").alias("a")).where("u is not null and a is not null")
    r = g.select("conv_id", F.to_json(F.struct(F.coalesce("s", "u").alias("instruction"), F.when(F.col("s").isNotNull(), F.col("u")).alias("input"), F.col("a").alias("output"))).alias("j"))
    turns, error = remap.turns_of(paths.parse(F.col("j")), {"kind": "alpaca"})
    out = r.select("conv_id", turns.alias("t"), error.alias("e")).where("e is null")
    return out.select("conv_id", F.size("t").cast("long").alias("n"), F.col("t")[0]["role"].alias("first_role"), F.md5(F.col("t")[0]["content"].cast("binary")).alias("digest"))


_EVENT = {"type": "object", "additionalProperties": False, "shape": {"type": {"type": "enum", "values": ["click", "view"]}, "props": {"type": "object", "shape": {"k": {"type": "number", "int": True, "min": 10, "max": 90}}}}}


@query("SELECT event_id, (event_type IN ('click', 'view') AND (props->>'k')::INT BETWEEN 10 AND 90) AS ok FROM events")
def constrain_events(spark, sf):
    df, record = _events(spark, sf)
    return df.select("event_id", paths.parse(record).alias("v")).select("event_id", constrain.holds(constrain.compile(_EVENT), F.col("v")).alias("ok"))


@query("""SELECT event_id, '{"k":' || (props->>'k') || '}' AS kept FROM events""")
def constrain_strip(spark, sf):
    """Undeclared keys go, through the same check that model output takes."""
    node = constrain.compile({"type": "object", "shape": {"k": {"type": "number"}}})
    df = rec.ordered(table(spark, sf, "events").select("event_id", F.concat(F.lit('{"x": [1, {"y": null}], '), F.substring("props", 2, 1 << 30)).alias("_json")), "event_id")
    done = rec.arrow_map(df, lambda x: js.to_json(constrain.check(node, js.parse_json(x))), "kept")
    return df.select("_ord", "event_id").join(done, "_ord").select("event_id", "kept")


_KINDS = {"type": "object", "shape": {
    "a": {"type": "number", "nullable": True, "min": 20}, "flag": {"type": "boolean", "optional": True}, "lit": {"type": "literal", "value": "on", "optional": True},
    "list": {"type": "array", "optional": True, "maxItems": 3, "items": {"type": "object", "shape": {"n": {"type": "number"}}}},
}}


@query("""SELECT event_id, kept, CASE WHEN kept IS NULL THEN 'constrain_mismatch' END AS error FROM (SELECT event_id, CASE event_id % 6
  WHEN 0 THEN CASE WHEN k >= 20 THEN '{"a":' || k || '}' END WHEN 1 THEN CASE WHEN k >= 20 THEN '{"a":' || k || ',"flag":true}' END
  WHEN 2 THEN '{"a":null,"list":[{"n":' || k || '},{"n":5}]}' WHEN 4 THEN CASE WHEN k >= 20 THEN '{"a":' || k || ',"lit":"on"}' END END AS kept
  FROM (SELECT event_id, (props->>'k')::INT AS k FROM events))""")
def constrain_kinds(spark, sf):
    """Optional, nullable, boolean, literal, array and nested fields; undeclared keys go, at any depth."""
    k = F.get_json_object("props", "$.k")
    ends = ["}", ', "flag": true, "x": 1}', None, ', "list": [{"n": 1}, {"n": 2}, {"n": 3}, {"n": 4}]}', ', "lit": "on"}', ', "lit": "off", "flag": "yes"}']
    shapes = [F.concat(F.lit('{"a": '), k, F.lit(e)) if e else F.concat(F.lit('{"a": null, "list": [{"m": 0, "n": '), k, F.lit('}, {"n": 5}]}')) for e in ends]
    v = table(spark, sf, "events").select("event_id", paths.parse(F.element_at(F.array(*shapes), (F.col("event_id") % 6 + 1).cast("int"))).alias("v"))
    kept, error = constrain.columns(constrain.compile(_KINDS), F.col("v"))
    return v.select("event_id", kept.alias("kept"), error.alias("error"))


@query("""SELECT event_id, '{"k":' || (props->>'k') || '}' AS value FROM events""")
def modeljson_parse(spark, sf):
    """Props in five kinds of noise."""
    p = F.col("props")
    k = F.get_json_object("props", "$.k")
    noise = [F.concat(F.lit("```json\n"), p, F.lit("\n```")), F.concat(F.lit("Sure: "), p, F.lit(" as asked {")), F.concat(F.lit("{k: "), k, F.lit(",}")), F.concat(F.lit("{'k': "), k, F.lit(" /* n */}")), p]
    raw = F.element_at(F.array(*noise), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", model_json.parsed(raw).alias("value"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"k":' || (props->>'k') || ',"s":"x]y"}' WHEN 1 THEN props->>'k' WHEN 2 THEN '{"content":"ab' || (props->>'k') || '"}'
  WHEN 3 THEN '{"content":"one\\ntwo' || (props->>'k') || '"}' WHEN 4 THEN '{"a":[1,' || (props->>'k') || ']}' END AS value FROM events""")
def modeljson_noise(spark, sf):
    """Prose around bare keys, a fenced number, joined literals, a raw line break, a bracket too few, and no value at all."""
    k = F.get_json_object("props", "$.k")
    noise = [F.concat(F.lit("Sure: {k: "), k, F.lit(', "s": "x]y"} ok')), F.concat(F.lit("```"), k, F.lit("```")), F.concat(F.lit('{"content": "a" +\n "b'), k, F.lit('"}')),
             F.concat(F.lit('{"content": "one\ntwo'), k, F.lit('"}')), F.concat(F.lit("{a: [1, "), k, F.lit("}")), F.concat(F.lit("none: "), k)]
    raw = F.element_at(F.array(*noise), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", model_json.parsed(raw).alias("value"))


@query("SELECT conv_id, turn, replace(replace(replace('To {role}: {text} ({turn})', '{role}', role), '{text}', text), '{turn}', turn::VARCHAR) AS said FROM conversations")
def text_template(spark, sf):
    t = TextTemplate("To {role}: {text} ({turn})")
    return table(spark, sf, "conversations").select("conv_id", "turn", t.column({"role": F.col("role"), "text": F.col("text"), "turn": F.col("turn")}).alias("said"))


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def jsonl_roundtrip(spark, sf):
    """Conversations written as JSON lines by the sink and read again by the scan."""
    r = rec.ordered(rec.turns_table(table(spark, sf, "conversations")), "conv_id").select("_ord", F.to_json(F.struct("conv_id", "turns")).alias("_json"))
    folder = scratch_path(spark, "lines")
    rec.write_jsonl(r, folder)
    stored = rec.read_jsonl(spark, folder)
    row = F.from_json("_json", "conv_id long, turns array<struct<role:string,text:string>>")
    first = table(spark, sf, "conversations").withColumn("idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).select("conv_id", "idx", "turn")
    out = stored.select(row.alias("r")).select("r.conv_id", F.posexplode("r.turns").alias("idx", "x"))
    return out.join(first, ["conv_id", "idx"]).select("conv_id", "turn", "x.role", F.md5(F.col("x.text").cast("binary")).alias("digest"))


@query("SELECT (n_nationkey - 2)::BIGINT AS ord, n_nationkey::BIGINT AS key, n_name AS name FROM nation WHERE n_nationkey BETWEEN 2 AND 21")
def json_array_scan(spark, sf):
    """Nations as one JSON array file, read from offset 2 on, 20 records."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("j"))))
    path = scratch_path(spark, "array") + ".json"
    table(spark, sf, "nation").agg(F.concat(F.lit("[\n"), F.array_join(F.transform(rows, lambda r: r["j"]), ",\n"), F.lit("\n]")).alias("value")).write.text(path)
    got = rec.load_records(spark, {"path": path, "offset": 2, "limit": 20})
    return got.select(F.col("_ord").alias("ord"), F.from_json("_json", "key long, name string").alias("r")).select("ord", "r.key", "r.name")


# --- rewrites and stages -----------------------------------------------------------------------------------------

_REWRITE = {"instructions": "Say it louder", "transform": {"kind": "conversation_rewrite", "conversationsPath": "turns", "roleField": "role", "contentField": "text", "targetRoles": ["assistant"]}}


def _stub(prompt: str) -> str:
    """The target turn of a rewrite prompt, with a mark."""
    at = prompt.index("Current Target Turn:\n") + 21
    return js.parse_json(prompt[at : prompt.index("\n\nRewrite Task:")])["text"] + " (louder)"


def _record_table(spark: SparkSession, sf: str) -> DataFrame:
    r = rec.ordered(rec.turns_table(table(spark, sf, "conversations")), "conv_id")
    return r.select("_ord", "conv_id", F.to_json(F.struct("turns")).alias("_json"))


def _turn_digests(df: DataFrame) -> DataFrame:
    t = df.select("conv_id", F.posexplode(F.from_json("_json", "turns array<struct<role:string,text:string>>")["turns"]).alias("idx", "x"))
    return t.select("conv_id", F.col("idx").cast("long").alias("idx"), F.md5(F.trim(F.col("x.text")).cast("binary")).alias("digest"))


_IDX = "(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS idx"


@query(f"SELECT conv_id, {_IDX}, md5(trim(CASE WHEN role = 'assistant' THEN text || ' (louder)' ELSE text END)) AS digest FROM conversations")
def rewrite_stub(spark, sf):
    """A record_transform stage over all conversations, with a deterministic model."""
    source = _record_table(spark, sf)
    engine = StageEngine(spark, StubClient(_stub))
    out = engine.run([{"id": "r", "mode": "record_transform", **_REWRITE}], records=source.select("_ord", "_json"))
    return _turn_digests(source.select("_ord", "conv_id").join(out.outputs["r"], "_ord"))


@query(f"""WITH w AS (SELECT conv_id, {_IDX}, text, role, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, idx, CASE WHEN role = 'assistant' AND n = 1 THEN 'first' WHEN role = 'assistant' THEN md5(text) ELSE md5(text) END AS digest FROM w""")
def rewrite_fold(spark, sf):
    """The fold as an expression: a rewrite that equals the last done turn of its role is refused."""
    turns = rec.turns_table(table(spark, sf, "conversations"))
    folded = rewrite.fold_turns(F.col("turns"), "role", "text", ["assistant"], lambda c: F.lit("first"), lambda new, turn, done: F.size(F.filter(done, lambda t: t["text"] == new)) == 0)
    out = turns.select("conv_id", F.posexplode(folded).alias("idx", "x"))
    return out.select("conv_id", F.col("idx").cast("long").alias("idx"), F.when(F.col("x.text") == "first", "first").otherwise(F.md5(F.col("x.text").cast("binary"))).alias("digest"))


@query(f"""SELECT conv_id, {_IDX}, md5(trim(CASE WHEN role <> 'assistant' OR length(text) >= 400 THEN text ELSE 'second ' || length(text) END)) AS digest FROM conversations""")
def rewrite_retry_stub(spark, sf):
    """Each first attempt breaks a rule; the second, told why, passes only for turns below 400 characters."""
    rule = {"kind": "regex", "path": "text", "pattern": "^second \\d{1,3}$"}
    stage = {"id": "r", "mode": "record_transform", **_REWRITE, "retry": {"enabled": True, "maxAttempts": 2}, "validate": {"onFailure": "warn", "rules": [rule]}}

    def stub(prompt: str) -> str:
        n = len(_stub(prompt).removesuffix(" (louder)"))
        return f"second {n}" if "Previous Attempt Failed:" in prompt and n < 400 else "first"

    source = _record_table(spark, sf)
    out = StageEngine(spark, StubClient(stub)).run([stage], records=source.select("_ord", "_json"))
    return _turn_digests(source.select("_ord", "conv_id").join(out.outputs["r"], "_ord"))


def _own_folder(spark: SparkSession, name: str) -> str:
    """A folder that the stream's files and workflow documents, which are opened as plain files, can be in."""
    path = scratch_path(spark, name).removeprefix("file:")
    path = "/" + path.lstrip("/") if path.startswith("/") else path
    if "://" in path:
        raise ValueError("spark.checkpoint.dir must be a mounted folder here")
    os.makedirs(path)
    return path


@query(f"SELECT conv_id, {_IDX}, md5(trim(CASE WHEN role = 'assistant' THEN text || ' (louder)' ELSE text END)) AS digest FROM conversations")
def stream_resume(spark, sf):
    """Record batches with a checkpoint: the model fails from the middle record on, and a second run goes on from there."""
    rows = rec.ordered(rec.turns_table(table(spark, sf, "conversations")), "conv_id")
    marked = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit("#"), F.col("_ord").cast("string"), F.lit("#"), t["text"]).alias("text")))
    folder, half = _own_folder(spark, "stream"), rows.count() // 2
    rows.select("_ord", F.to_json(F.struct("conv_id", marked.alias("turns"))).alias("_json")).repartition(1).sortWithinPartitions("_ord").select("_json").write.text(f"file://{folder}/in")
    source = glob.glob(f"{folder}/in/part-*.txt")[0]
    document = {"input": {"path": source, "format": "jsonl", "readMode": "stream"}, "stages": [{"id": "r", "mode": "record_transform", **_REWRITE}]}

    def failing(prompt: str) -> str:
        out = _stub(prompt)
        if int(out.split("#")[1]) >= half:
            raise ModelError("HTTP 500")
        return out

    to = {"options": ModelOptions(), "output": f"{folder}/out", "checkpoint": f"{folder}/at.json", "every": max(1, half // 2 + 1)}
    try:
        run_stream(spark, document, "flow", StubClient(failing), **to)
        raise AssertionError("the failing model was not asked")
    except StageError:
        run_stream(spark, document, "flow", StubClient(_stub), **to, resume=True)
    t = spark.read.text(f"file://{folder}/out").select(F.from_json("value", "conv_id long, turns array<struct<role:string,text:string>>").alias("r"))
    t = t.select("r.conv_id", F.posexplode("r.turns").alias("idx", "x"))
    return t.select("conv_id", F.col("idx").cast("long").alias("idx"), F.md5(F.trim(F.regexp_replace("x.text", "^#[0-9]+#", "")).cast("binary")).alias("digest"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, upper(n_name) AS name, n_regionkey::BIGINT AS region FROM nation")
def delegate_stub(spark, sf):
    """A workflow file that hands a list to another file's workflow, and takes the output of its last stage."""
    rows = [{"name": r.n_name, "region": r.n_regionkey} for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]  # the first stage's one answer

    def stub(prompt: str) -> str:
        mark = "Current Iter Item (JSON):\n"
        if mark in prompt:
            item = js.parse_json(prompt[prompt.index(mark) + len(mark) : prompt.index("\n\nOutput Contract:")])
            return js.to_json({"name": item["name"].upper(), "region": item["region"]})
        return js.to_json({"items": rows}) if "Seed" in prompt else js.to_json(rows)

    folder = _own_folder(spark, "flows")
    child = {"model": "m", "stages": [{"id": "take", "instructions": "Take"}, {"id": "each", "mode": "iter", "instructions": "Shout"}]}
    block = {"workflowPath": "child.yaml", "inputFromPath": "outputsByStage.seed.items"}
    parent = {"model": "m", "stages": [{"id": "seed", "instructions": "Seed"}, {"id": "d", "instructions": "Hand over", "mode": "workflow_delegate", "delegate": block}]}
    for name, document in (("child", child), ("parent", parent)):
        with open(f"{folder}/{name}.yaml", "w", encoding="utf-8") as f:
            f.write(js.to_json(document))
    out = WorkflowRunner(spark, StubClient(stub)).run(f"{folder}/parent.yaml", artifacts=False)[0].outputs["d"]
    got = out if isinstance(out, DataFrame) else rec.records_of(spark, out)
    return got.select(F.col("_ord").alias("ord"), F.from_json("_json", "name string, region long").alias("r")).select("ord", "r.name", "r.region")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, upper(n_name) AS name, n_regionkey::BIGINT AS region FROM nation")
def iter_stub(spark, sf):
    """batch, then iter over its array with a constraint, then both seen by a gate."""
    rows = [{"name": r.n_name, "region": r.n_regionkey} for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]  # the batch stage's one answer

    def stub(prompt: str) -> str:
        mark = "Current Iter Item (JSON):\n"
        if mark not in prompt:
            return "Here you are:\n```json\n" + js.to_json(rows) + "\n```"
        item = js.parse_json(prompt[prompt.index(mark) + len(mark) : prompt.index("\n\nOutput Contract:")])
        return js.to_json({"name": item["name"].upper(), "region": item["region"], "extra": 1})

    shape = {"type": "object", "shape": {"name": {"type": "string", "minLength": 1}, "region": {"type": "number", "int": True}}}
    stages = [{"id": "all", "instructions": "List"}, {"id": "each", "mode": "iter", "instructions": "Shout", "constrain": shape, "validate": {"rules": [{"kind": "regex", "path": "name", "pattern": "^[A-Z_ 0-9]+$"}]}}]
    out = StageEngine(spark, StubClient(stub)).run(stages)
    return out.outputs["each"].select(F.col("_ord").alias("ord"), F.from_json("_json", "name string, region long").alias("r")).select("ord", "r.name", "r.region")


@query("SELECT * FROM (VALUES ('a', 0::BIGINT, 'executed'), ('b', 1, 'executed'), ('c', 2, 'skipped'), ('d', 3, 'blocked'), ('e', 4, 'executed')) v(stage, place, status)")
def dag_status(spark, sf):
    stages = [{"id": "a", "instructions": "x"}, {"id": "b", "instructions": "x", "dependsOn": ["a"]}, {"id": "c", "instructions": "x", "dependsOn": ["a"], "when": {"path": "outputsByStage.a.go", "equals": True}}, {"id": "d", "instructions": "x", "dependsOn": ["c"]}, {"id": "e", "instructions": "x", "dependsOn": ["b", "a"]}]
    out = StageEngine(spark, StubClient(lambda p: '{"go": false}')).run(stages)
    order = [n.key for n in dag.resolve(stages)]
    return spark.createDataFrame([(k, i, out.statuses[k]) for i, k in enumerate(order)], "stage string, place long, status string")


@query("""SELECT conv_id, turn, 'Prior Conversation Turns:' AS first_line, count(*) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n_before FROM conversations""")
def prompt_sections(spark, sf):
    """Rewrite prompts for each turn; what they hold is read back from their text."""
    rows = rec.ordered(rec.turns_table(table(spark, sf, "conversations")), "conv_id").select("_ord", "conv_id", F.to_json("turns").alias("_json"))

    def each(x: str) -> str:
        turns, out = js.parse_json(x), []
        for i, t in enumerate(turns):
            p = prompts.rewrite_prompt(_REWRITE, turns[:i], t)
            head = "Prior Conversation Turns:\n"
            out.append({"first": p.split("\n")[0], "n": len(js.parse_json(p[len(head) : p.index("\n\nCurrent Target Turn:")]))})
        return js.to_json(out)

    done = rows.select("_ord", "conv_id").join(rec.arrow_map(rows, each, "p"), "_ord")
    got = done.select("conv_id", F.posexplode(F.from_json("p", "array<struct<first:string,n:long>>")).alias("idx", "x"))
    first = table(spark, sf, "conversations").withColumn("idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).select("conv_id", "idx", "turn")
    return got.join(first, ["conv_id", "idx"]).select("conv_id", "turn", F.col("x.first").alias("first_line"), F.col("x.n").alias("n_before"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
