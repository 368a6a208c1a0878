"""Text, similarity, paths, patterns, JSON and templates: behaviour tables, and columns against Python."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftwork.functions import js, model_json, paths, text
from weftwork.functions.template import TextTemplate

PAIRS = [("Hello,   WORLD!", " hello world "), ("Password reset links expire in fifteen minutes", "Hash maps store values by key for quick lookup"), ("warm friendly support reply", "support reply warm friendly"), ("The link expires after fifteen minutes.", "You have fifteen minutes before the link expires."), ("", ""), ("", "hello"), ("the a", "of in"), ("é1 b", "E b 1"), ("ab", "ab c d e"), (" x　y", "x y z")]


def test_similarity_values():
    assert js.fast_similarity(*PAIRS[0]) == js.detailed_similarity(*PAIRS[0]) == 1
    assert js.fast_similarity(*PAIRS[1]) < 0.4 and js.detailed_similarity(*PAIRS[1]) < 0.5
    assert js.jaccard(PAIRS[2][0].split(), PAIRS[2][1].split()) == 1
    fast, detailed = js.fast_similarity(*PAIRS[3]), js.detailed_similarity(*PAIRS[3])
    assert fast < 0.75 and detailed > fast and detailed >= 0.55
    assert js.fast_similarity("", "") == 1 and js.fast_similarity("", "hello") == 0
    a, b = (js.tokens(js.normalize(x)) for x in ("Your password reset link expires in 15 minutes. Please use it soon.", "Your password reset link expires in 15 minutes. Please use it as soon as possible."))
    assert js.lcs_length(a, b) / max(len(a), len(b)) > 0.7


def test_columns_agree(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    for mode in ("fast", "detailed"):
        got = [r[2] for r in df.select("a", "b", text.similarity(F.col("a"), F.col("b"), mode)).collect()]
        assert got == pytest.approx([js.similarity(a, b, mode) for a, b in PAIRS], abs=1e-12)
    assert [r[0] for r in df.select(text.normalize(F.col("a"))).collect()] == [js.normalize(a) for a, _ in PAIRS]


def test_trigrams_count_utf16_units(spark):
    pairs = [("\U0001d452x", "\U0001d452y"), ("ab\U0001d452", "abd835dc52"), ("\U0001d452", "\U0001d453"), ("a\U0001d452b c", "a\U0001d453b c"), ("abc", "abc\U0001d452"), ("", "\U0001d452")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(text.dice(text.trigrams(F.col("a")), text.trigrams(F.col("b")))).collect()]
    assert got == pytest.approx([js.dice(js.trigrams(a), js.trigrams(b)) for a, b in pairs])


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=90), st.lists(st.sampled_from("abcd"), max_size=90))
def test_lcs(a, b):
    assert js.lcs_length(a, b) == slow_lcs(a, b) == js.lcs_length(b, a)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_similarity_properties(a, b):
    for mode in ("fast", "detailed"):
        s = js.similarity(a, b, mode)
        assert 0 <= s <= 1 and s == pytest.approx(js.similarity(b, a, mode)) and js.similarity(a, a, mode) == 1


SCOPES = [
    ("<final>One</final> ignored <final>Two</final>", {"includePattern": {"pattern": r"<final>[\s\S]*?</final>"}}, "<final>One</final> <final>Two</final>"),
    ("no tags", {"includePattern": {"pattern": "<final>"}}, "scope_no_match"),
    ("<think>x</think>  y  z", {"excludePatterns": [{"pattern": "<think>.*?</think>"}]}, "y z"),
    ("<think>x</think>", {"excludePatterns": [{"pattern": "<THINK>.*?</think>", "flags": "i"}]}, "scope_empty"),
    ("abc", {"excludePatterns": [{"pattern": "("}]}, "invalid_scope_pattern"),
    ("<a>1 b</a> 2 b", {"includePattern": {"pattern": "<a>.*</a>"}, "excludePatterns": [{"pattern": "</?a>"}]}, "1 b"),
]


@pytest.mark.parametrize("raw, scope, want", SCOPES)
def test_scope(spark, raw, scope, want):
    try:
        got = js.scoped(raw, scope)
    except js.ScopeError as e:
        got = e.kind
    assert got == want
    if want != "invalid_scope_pattern":
        c, wrong = text.scoped(F.col("a"), scope)
        row = spark.createDataFrame([(raw,)], "a string").select(c.alias("c"), wrong.alias("w")).first()
        assert (row.w or row.c) == want


PATTERNS = [("^abc$", "", "abc\n", False), ("^abc$", "m", "x\nabc\ny", True), (".", "", " ", False), (".", "s", " ", True), (r"\d", "", "٣", False), (r"\w", "", "é", False), (r"\s", "", " ", True), (r"\S", "", "　", False), ("É", "i", "é", True), ("[^]", "", "\n", True), ("[]", "", "a", False), (r"a\/b", "", "a/b", True), (r"[a-z&&[aeiou]]", "", "&]", True), (r"\u{1F600}", "u", "😀", True), ("(?<y>a)b", "", "ab", True)]


def test_patterns(spark):
    for p, flags, raw, want in PATTERNS:
        assert js.search(p, flags, raw) == want, (p, raw)
        assert spark.createDataFrame([(raw,)], "a string").select(text.matches(F.col("a"), p, flags)).first()[0] == want, (p, raw)
    for p, flags in (("(", ""), ("a", "gg"), ("a", "x"), ("a", "uv")):
        with pytest.raises(js.PatternError):
            js.java_pattern(p, flags)


def test_numbers_and_lengths(spark):
    for x, want in ((1.0, "1"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (-0.0, "0"), (1.5e300, "1.5e+300"), (5e-324, "5e-324"), (0.1, "0.1")):
        assert js.number_text(x) == want
    assert js.fixed3(1.0005) == "1.000" and js.fixed3(0.0625) == "0.063"
    assert js.to_json({"b": [1, 2.0, None, True], "a": {}, "é": "\n"}) == '{"b":[1,2,null,true],"a":{},"é":"\\n"}'
    assert js.to_json({"a": [1, {"b": []}]}, 2) == json.dumps({"a": [1, {"b": []}]}, indent=2)
    assert js.utf16_length("a😀b") == 4
    assert spark.createDataFrame([("a😀b",)], "a string").select(text.utf16_length(F.col("a"))).first()[0] == 4
    for bad in ("NaN", "[1,]", '{"a":1} x', "", "Infinity"):
        with pytest.raises(ValueError):
            js.parse_json(bad)


RECORD = {"a": {"b": None, "c": "x", "d": [1, 2], "e": {"f.g": 1}}, "t": True, "n": 2.5}


def test_paths(spark):
    assert js.get_path(RECORD, " a . c ") == "x" and js.get_path(RECORD, "a.b") is None and js.get_path(RECORD, "") is RECORD
    for p in ("a.z", "a.d.0", "a.c.x", "a.b.x"):
        with pytest.raises(js.PathError):
            js.get_path(RECORD, p)
    assert js.set_path(RECORD, "a.c", 1, False)["a"]["c"] == 1 and RECORD["a"]["c"] == "x"
    assert js.set_path({}, "x.y.z", 1, True) == {"x": {"y": {"z": 1}}} and js.set_path(1, "", 2, True) == 2
    for v, p, create in (({"a": [1]}, "a.b", True), ({}, "a.b", False), ({"a": None}, "a.b", True)):
        with pytest.raises(js.PathError):
            js.set_path(v, p, 1, create)
    v = spark.createDataFrame([(json.dumps(RECORD),)], "j string").select(paths.parse(F.col("j")).alias("v"))
    for p, kind in (("a.b", "null"), ("a.c", "string"), ("a.d", "array"), ("a.e", "object"), ("t", "boolean"), ("n", "number"), ("a.z", None), ("a.d.0", None)):
        at = paths.at(F.col("v"), p)
        assert v.select(paths.kind(at), paths.present(at)).first() == (kind, kind is not None)
    for p, x, same in (("n", 2.5, True), ("t", True, True), ("t", 1, False), ("a.b", None, True), ("a.c", "x", True), ("a.z", None, False), ("n", "2.5", False)):
        assert v.select(paths.equals(paths.at(F.col("v"), p), x)).first()[0] == same


NOISE = [
    ('```json\n{"a": 1}\n```', {"a": 1}), ('Sure:\n```\n[1, 2]\n```\nbye', [1, 2]), ('text {"a": "}"} more', {"a": "}"}), ('{"a": "x" + "y" + "z"}', {"a": "xyz"}), ("{a: 'it', b: [1,2,],}", {"a": "it", "b": [1, 2]}),
    ('{"content": "line\nbreak"}', {"content": "line\nbreak"}), ('{"from": "gpt", "value": "a "quoted" b"}', None), ('{"a": 1 /* c */}', {"a": 1}), ("[1, 2", None), ("plain", None), ('"text"', "text"), ("12", 12), ('{"x": // c\n 1}', {"x": 1}), ("", None), ("NaN", None),
]


@pytest.mark.parametrize("raw, want", [
    ('Sure: {a: "x]y", b: 2} ok', {"a": "x]y", "b": 2}), ("```123```", 123), ("```true```", True), ("```JSON\n[1]\n```", [1]), ("{a: [1, 2}", {"a": [1, 2]}),
    ("so {'a': 'b',} it is", {"a": "b"}), ('{"content": "a" + "b" +\n "c"}', {"content": "abc"}),
    ('{"from": "x", "value": "one\ntwo \\"q\\" three"}', {"from": "x", "value": 'one\ntwo "q" three'}), ('Here: {"a": "}"} {"b": 1}', {"a": "}"}), ("a, b: c", None), ("{a: 1} {b: 2}", {"a": 1}),
])
def test_model_json_noise(raw, want):
    if want is None:
        with pytest.raises(ValueError):
            model_json.parse(raw)
    else:
        assert model_json.parse(raw) == want


def test_model_json(spark):
    for raw, want in NOISE:
        if want is None:
            with pytest.raises(ValueError):
                model_json.parse(raw)
        else:
            assert model_json.parse(raw) == want, raw
    got = [r[0] for r in spark.createDataFrame([(r,) for r, _ in NOISE], "r string").select(model_json.parsed(F.col("r"))).collect()]
    assert got == [None if w is None else js.to_json(w) for _, w in NOISE]
    assert model_json.first_candidate("```json\n{}\n```") == "{}" and model_json.first_candidate(" x ") == "x"


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12))
def test_model_json_keeps_json(value):
    assert model_json.parse(js.to_json(value)) == value


def test_template(spark):
    t = TextTemplate("\nHi {name}, {name}: ${...} $1 $3\n")
    assert t({"name": lambda rest, *p: "A" + str(len(p))}, "x", "y") == "Hi A2, A2: x y x $3"
    assert TextTemplate("{a}{b}")({"a": "{b}", "b": 1}) == "11" and TextTemplate("{a.b}")({"a.b": "$1"}, "z") == "z"
    assert t.indent(2).template == "  Hi {name}, {name}: ${...} $1 $3" and TextTemplate("a  \nb ").trim_lines().template == "a\nb" and t.clone().template == t.template
    assert spark.range(1).select(TextTemplate("n={n}!").column({"n": F.col("id")})).first()[0] == "n=0!"


def test_lower_and_random_text(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choice("aA é.-\t\n中9😀 ß") for _ in range(30)),) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string").select(text.normalize(F.col("a"))).collect()]
    assert got == [js.normalize(r[0]) for r in rows]
