"""Validators, constraints, remaps, sources: behaviour tables; columns and Python hold each other."""

import json

import pytest
from pyspark.sql import functions as F

from weftwork.functions import js, paths
from weftwork.operators import constrain, remap, rules, validators
from weftwork.plans.config import PipelineValidationError, parse_workflow
from weftwork.sources import records as rec

VALUE = {"original": "Hello there friend", "rewritten": "hello there, friend!", "other": "Completely different words", "content": "short", "items": [1, 2], "n": 5, "flag": True, "nothing": None, "tag": "<f>same text</f> <think>zzz</think>"}
SAME = {"includePattern": {"pattern": "<f>[^<]*</f>"}}
RULES = [
    {"kind": "contains", "path": "content", "value": "x"}, {"kind": "not_contains", "path": "content", "value": "or"}, {"kind": "regex", "path": "content", "pattern": "^s.*t$"}, {"kind": "regex", "path": "content", "pattern": "("},
    {"kind": "not_regex", "path": "content", "pattern": "SHORT", "flags": "i", "hint": "h", "name": "nm"}, {"kind": "min_length", "path": "content", "value": 6}, {"kind": "max_length", "path": "content", "value": 4}, {"kind": "min_length", "path": "n", "value": 1},
    {"kind": "equals", "path": "n", "value": 5}, {"kind": "equals", "path": "n", "value": "5"}, {"kind": "not_equals", "path": "flag", "value": True}, {"kind": "equals", "path": "nothing", "value": None}, {"kind": "not_equals", "path": "items", "value": 1},
    {"kind": "must_change_from_path", "path": "rewritten", "otherPath": "original"}, {"kind": "not_equal_to_path", "path": "rewritten", "otherPath": "other"}, {"kind": "not_equal_to_path", "path": "rewritten", "otherPath": "none"},
    {"kind": "must_change_from_ref", "path": "rewritten", "ref": "before.text"}, {"kind": "not_equal_to_ref", "path": "rewritten", "ref": "absent.text"}, {"kind": "not_equal_to_ref", "path": "rewritten", "ref": "before.zz"}, {"kind": "not_equal_to_ref", "path": "n", "ref": "before.text"},
    {"kind": "max_similarity_to_path", "path": "rewritten", "otherPath": "original", "threshold": 0.98}, {"kind": "min_similarity_to_path", "path": "rewritten", "otherPath": "other", "threshold": 0.5, "similarity": {"mode": "detailed"}},
    {"kind": "max_similarity_to_ref", "path": "other", "ref": "before.text", "threshold": 0.0}, {"kind": "min_similarity_to_ref", "path": "other", "ref": "before.text", "threshold": 0.9},
    {"kind": "array_min_length", "path": "items", "value": 3}, {"kind": "array_max_length", "path": "items", "value": 1}, {"kind": "array_max_length", "path": "n", "value": 1}, {"kind": "contains", "value": "x"}, {"kind": "contains", "path": "gone.x", "value": "x"},
    {"kind": "contains", "path": "content", "value": "x", "when": {"path": "n", "equals": 6}}, {"kind": "contains", "path": "content", "value": "x", "when": {"path": "n", "notEquals": 6}}, {"kind": "contains", "path": "content", "value": "x", "when": {"path": "zz", "equals": 6}},
    {"kind": "not_equal_to_path", "path": "tag", "otherPath": "tag", "scope": SAME}, {"kind": "not_equal_to_path", "path": "tag", "otherPath": "content", "scope": SAME}, {"kind": "not_equal_to_path", "path": "tag", "otherPath": "tag", "scope": {"excludePatterns": [{"pattern": "[^]*"}]}}, {"kind": "not_equal_to_path", "path": "tag", "otherPath": "tag", "scope": {"excludePatterns": [{"pattern": "("}]}},
]
REFS = {"before": {"text": "Hello there friend!"}}


@pytest.mark.parametrize("skip", [False, True])
def test_rules_and_columns_agree(spark, skip):
    df = spark.createDataFrame([(json.dumps(VALUE), json.dumps(REFS["before"]))], "j string, b string").select(paths.parse(F.col("j")).alias("v"), paths.parse(F.col("b")).alias("b"))
    got = df.select(*[validators.compile_rule(r, F.col("v"), {"before": F.col("b")}, skip).alias(f"c{i}") for i, r in enumerate(RULES)]).first()
    for rule, column in zip(RULES, got, strict=True):
        want = rules.check(rule, VALUE, REFS, skip)
        assert [i["kind"] for i in want] == [c.kind for c in column], rule
        for a, b in zip(want, column, strict=True):
            for k in ("path", "hint", "ruleName", "similarityThreshold", "similarityStatus", "similarityMode"):
                assert a.get(k) == b[k], (rule, k)
            if "similarityScore" in a:
                assert a["similarityScore"] == pytest.approx(b.similarityScore) and a["similarityDistance"] == pytest.approx(b.similarityDistance)
            if a["kind"] not in ("path_missing", "ref_missing"):
                assert a["message"] == b.message, rule
    both = df.select(validators.issues(RULES, F.col("v"), {"before": F.col("b")}, skip).alias("i")).first().i
    assert [i["kind"] for i in rules.validate(VALUE, RULES, REFS, skip)] == [i.kind for i in both]
    staged = validators.with_issues(df, RULES, "v", {"before": "b"}, "i", skip).first().i
    assert [(i.kind, i.message, i.similarityStatus) for i in staged] == [(i.kind, i.message, i.similarityStatus) for i in both]
    assert [i.similarityScore or 0 for i in staged] == pytest.approx([i.similarityScore or 0 for i in both])


def test_verdicts():
    kinds = {i: [x["kind"] for x in rules.check(r, VALUE, REFS)] for i, r in enumerate(RULES)}
    assert kinds[0] == ["contains"] and kinds[2] == [] and kinds[3] == ["invalid_regex_pattern"] and kinds[7] == ["invalid_target_type"] and kinds[8] == [] and kinds[9] == ["equals"] and kinds[11] == [] and kinds[12] == []
    assert kinds[13] == ["must_change_from_path"] and kinds[15] == ["path_missing"] and kinds[17] == ["ref_missing"] and kinds[29] == [] and kinds[30] == ["contains"] and kinds[31] == ["path_missing"]
    assert kinds[33] == ["scope_no_match"] and kinds[34] == ["scope_empty"] and kinds[35] == ["invalid_scope_pattern"]
    close = rules.check(RULES[20], VALUE)[0]
    assert close["similarityStatus"] == "close" and close["message"] == "Similarity 1.000 exceeds maximum 0.98 when compared to path 'original'"


NODE = {"type": "object", "shape": {"s": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^a"}, "n": {"type": "number", "int": True, "min": 0, "max": 9}, "e": {"type": "enum", "values": ["x", 1, True, None], "optional": True}, "l": {"type": "literal", "value": "k", "nullable": True}, "a": {"type": "array", "items": {"type": "boolean"}, "minItems": 1, "maxItems": 2}}}
GOOD = {"s": "abc", "n": 3, "l": None, "a": [True]}
BAD = [{"s": "a"}, {"s": "abcde"}, {"s": "bbb"}, {"s": 1}, {"n": 1.5}, {"n": -1}, {"n": 10}, {"n": True}, {"e": "1"}, {"e": False}, {"l": "z"}, {"a": []}, {"a": [True] * 3}, {"a": [1]}, {"a": None}, {"n": js.MISSING}]


def test_constrain(spark):
    cases = [(GOOD, True), (GOOD | {"extra": 1}, True), (GOOD | {"e": 1}, True), (GOOD | {"n": 3.0}, True), ([], False), (None, False)]
    cases += [({k: v for k, v in (GOOD | b).items() if v is not js.MISSING}, False) for b in BAD]
    for v, ok in cases:
        try:
            constrain.check(constrain.compile(NODE), v)
            assert ok, v
        except constrain.ConstrainMismatch:
            assert not ok, v
    df = spark.createDataFrame([(js.to_json(v),) for v, _ in cases], "j string")
    assert [r[0] for r in df.select(constrain.holds(NODE, paths.parse(F.col("j")))).collect()] == [ok for _, ok in cases]
    assert constrain.check(NODE, GOOD | {"extra": 1}) == GOOD and constrain.check(NODE | {"additionalProperties": True}, GOOD | {"extra": 1}) == GOOD | {"extra": 1}
    closed = NODE | {"additionalProperties": False}
    with pytest.raises(constrain.ConstrainMismatch):
        constrain.check(closed, GOOD | {"extra": 1})
    assert [r[0] for r in df.limit(2).select(constrain.holds(closed, paths.parse(F.col("j")))).collect()] == [True, False]
    got = df.select(*constrain.columns(NODE, paths.parse(F.col("j")))).collect()
    assert [r[0] and json.loads(r[0]) for r in got] == [constrain.check(NODE, v) if ok else None for v, ok in cases]
    assert [r[1] for r in got] == [None if ok else "constrain_mismatch" for _, ok in cases]
    with pytest.raises(constrain.ConstrainDeclarationError):
        constrain.columns(NODE | {"additionalProperties": True}, F.col("j"))
    for bad in ({"type": "x"}, {"type": "string", "pattern": "("}, {"type": "array"}, {"type": "object", "shape": {"a": {"type": "enum", "values": []}}}):
        with pytest.raises(constrain.ConstrainDeclarationError):
            constrain.compile(bad)


def records(spark, *values):
    return rec.records_of(spark, list(values))


PREFIXED = {"kind": "prefixed_string_array", "sourcePath": "nested.convo", "outputPath": "normalized.turns", "roleField": "role", "contentField": "content", "prefixes": {"user": "user:", "assistant": "assistant:", "system": "system:"}}


def test_remap_prefixed(spark):
    out = remap.remap(records(spark, {"id": 1, "nested": {"convo": ["  user: hi ", "assistant:yo", "system: s"]}}), PREFIXED)
    assert json.loads(out.first()._json) == {"id": 1, "nested": {"convo": ["  user: hi ", "assistant:yo", "system: s"]}, "normalized": {"turns": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}, {"role": "system", "content": "s"}]}}
    ok = {"nested": {"convo": []}}
    for bad, say in ((1, "Record 2 is not an object"), ({"nested": {"convo": ["user: a", 5]}}, "Record 2 conversation item 1 is not a string"), ({"nested": {"convo": ["bot: a"]}}, "Record 2 conversation item 0 does not match any configured prefix"), ({"nested": {"convo": ["user: a"]}, "normalized": [1]}, "Record 2 Path")):
        with pytest.raises(remap.InputDatasetRemapError, match=say):
            remap.remap(records(spark, ok, bad, 1), PREFIXED)
    assert json.loads(remap.remap(records(spark, {"nested": {"convo": ["user: a "]}}), PREFIXED | {"trimContent": False}).first()._json)["normalized"]["turns"][0]["content"] == " a "


def test_remap_alpaca(spark):
    out = [json.loads(r._json)["conversations"] for r in remap.remap(records(spark, {"instruction": "i", "input": " x ", "output": "o"}, {"instruction": "i", "output": " o"}, {"instruction": "i", "input": "  ", "output": "o"}), {"kind": "alpaca"}).orderBy("_ord").collect()]
    assert out == [[{"from": "system", "value": "i"}, {"from": "user", "value": " x "}, {"from": "assistant", "value": "o"}], [{"from": "user", "value": "i"}, {"from": "assistant", "value": " o"}], [{"from": "user", "value": "i"}, {"from": "assistant", "value": "o"}]]
    for bad, say in (({"output": "o"}, "missing required Alpaca field 'instruction'"), ({"instruction": 1, "output": "o"}, "field 'instruction' must be a string"), ({"instruction": "i", "output": " "}, "field 'output' must not be empty"), ({"instruction": "i", "output": "o", "input": None}, "field 'input' must be a string")):
        with pytest.raises(remap.InputDatasetRemapError, match=say):
            remap.remap(records(spark, bad), {"kind": "alpaca"})


def load(spark, path, **more):
    return [json.loads(r._json) for r in rec.load_records(spark, {"path": str(path), **more}).orderBy("_ord").collect()]


def test_sources(spark, tmp_path):
    lines = tmp_path / "in.jsonl"
    lines.write_text('{"id":1}\n\n  {"id":2}\r\n \n{"id":3}\n{"id":4}')
    assert [x["id"] for x in load(spark, lines)] == [1, 2, 3, 4]
    assert load(spark, lines, offset=2, limit=1) == [{"id": 3}] and load(spark, lines, limit=0) == [] and load(spark, lines, offset=9) == []
    lines.write_text('{"id":1}\n\n{bad\n{"id":3}')
    assert load(spark, lines, limit=1) == [{"id": 1}]
    with pytest.raises(rec.InputDatasetParseError, match="at line 3"):
        load(spark, lines)
    array = tmp_path / "in.json"
    array.write_text('[{"id": 1, "b": 1.0}, [2], null]')
    assert load(spark, array, offset=1) == [[2], None]
    with pytest.raises(rec.InputDatasetValidationError):
        load(spark, array, readMode="stream")
    for text, error in (("{}", rec.InputDatasetValidationError), ("[1", rec.InputDatasetParseError)):
        array.write_text(text)
        with pytest.raises(error):
            load(spark, array)
    with pytest.raises(rec.InputDatasetValidationError):
        rec.infer_format("x.csv")
    assert rec.to_jsonl([1, {"a": None}]) == '1\n{"a":null}\n' and rec.to_jsonl({"a": 1}) == '{"a":1}\n' and rec.to_jsonl(js.MISSING) == "" == rec.to_jsonl([])


def test_many_lines_keep_order(spark, tmp_path):
    path = tmp_path / "many.jsonl"
    path.write_text("".join(f'{{"id": {i}, "pad": "{"x" * (i % 200)}"}}\n' + "\n" * (i % 3) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert [x["id"] for x in load(spark, path, offset=1234, limit=2000)] == list(range(1234, 3234))
        rec.write_jsonl(rec.load_records(spark, {"path": str(path)}), str(tmp_path / "out.jsonl"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    back = [json.loads(line)["id"] for f in sorted((tmp_path / "out.jsonl").glob("part-*")) for line in f.read_text().splitlines()]
    assert back == list(range(5000))


STAGE = "stages:\n  - id: a\n    instructions: x\n"
BAD_DOCS = ["stages: []", "x: 1\n" + STAGE, "stages:\n  - id: a", STAGE + "  - id: a\n    instructions: y", STAGE + "    dependsOn: [zz]", STAGE + "    mode: record_transform", STAGE + "    transform: {kind: conversation_rewrite}", STAGE + "    validate: {rules: [{kind: nope}]}", STAGE + "    validate: {rules: []}", STAGE + "    when: {path: p}", STAGE + "    when: {path: p, equals: 1, notEquals: 2}", STAGE + "    constrain: {type: nope}", STAGE + "    constrain: {type: array}", STAGE + "    parallelism: 0", "maxTokens: -1\n" + STAGE, "provider: other\n" + STAGE, "input: {path: a.jsonl, limit: 1.5}\n" + STAGE, STAGE + "    mode: workflow_delegate\n    delegate: {workflowPath: a, inputFromPath: b, outputFrom: stage_key}", STAGE + "    validate: {rules: [{kind: max_similarity_to_path, otherPath: p, threshold: 2}]}", STAGE + "    validate: {rules: [{kind: not_equal_to_path, otherPath: p, scope: {}}]}"]


@pytest.mark.parametrize("text", BAD_DOCS)
def test_documents_refused(text):
    with pytest.raises(PipelineValidationError):
        parse_workflow(text)


def test_documents():
    doc = parse_workflow("reasoningMode: off\nversion: 010\nname: yes\ninput: {path: a.jsonl, remap: {kind: alpaca}}\n" + STAGE + "    metadata: {t: 2024-01-01, e: 1e3}\n    validate: {rules: [{kind: contains, value: x, scope: ignored}]}\n    constrain: {type: object, shape: {a: {type: enum, values: [a, 1, null]}}}")
    assert doc["reasoningMode"] == "off" and doc["version"] == 10 and doc["name"] == "yes" and doc["stages"][0]["metadata"] == {"t": "2024-01-01", "e": 1000.0}
    with pytest.raises(ValueError, match="YAML"):
        parse_workflow("a: [")
