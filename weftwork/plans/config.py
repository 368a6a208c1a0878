"""Workflow documents: YAML of the 1.2 core schema, strictly checked against declared fields."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

import yaml

from weftwork.functions import js
from weftwork.operators import rules as R


class PipelineParseError(ValueError):
    pass


class PipelineValidationError(ValueError):
    pass


class _Yaml12(yaml.SafeLoader):
    """Only true/false are booleans, numbers as in JSON (and 0o, 0x), no dates."""


_Yaml12.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"~|null|Null|NULL|", "~nN\0"),
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", "-+0123456789."),
):
    _Yaml12.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"^(?:{_pattern})$"), [*_first, ""] if _tag == "null" else list(_first))


def _int(loader: yaml.SafeLoader, node: yaml.Node) -> int:
    text = node.value
    return int(text[2:], 8) if text.startswith("0o") else int(text, 16) if text.startswith("0x") else int(text)


def _float(loader: yaml.SafeLoader, node: yaml.Node) -> float:
    return float(node.value.lower().replace(".inf", "inf").replace(".nan", "nan"))


_Yaml12.add_constructor("tag:yaml.org,2002:int", _int)
_Yaml12.add_constructor("tag:yaml.org,2002:float", _float)

_STR, _NUM, _BOOL = "string", "number", "boolean"


def _is(kind: Any, value: Any) -> bool:
    if isinstance(kind, (set, frozenset)):
        return isinstance(value, str) and value in kind
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        _STR: isinstance(value, str), "name": isinstance(value, str) and value != "", _NUM: number, _BOOL: isinstance(value, bool),
        "count": number and float(value).is_integer() and value >= 0, "positive": number and float(value).is_integer() and value >= 1,
        "names": isinstance(value, list) and value != [] and all(isinstance(x, str) and x for x in value), "strings": isinstance(value, list) and all(isinstance(x, str) for x in value),
        "ratio": number and 0 <= value <= 1, "scalar": value is None or isinstance(value, (str, bool)) or number, "any": True, "object": isinstance(value, dict), "text": isinstance(value, str) or number,
        "said": isinstance(value, str) or isinstance(value, list) and all(isinstance(x, str) for x in value),
    }[kind]


#: Fields by block: name -> (kind or block or [block], required).
DOCUMENT = {
    "version": "text", "name": _STR, "description": _STR, "model": "name", "endpoint": "name", "provider": {"openai", "ollama"}, "reasoningMode": {"off", "think", "openai"},
    "apiKeyEnv": "name", "httpReferer": "name", "xTitle": "name", "maxTokens": "count", "temperature": _NUM, "outputDir": "name",
}
INPUT = {"path!": "name", "format": {"json", "jsonl"}, "readMode": {"eager", "stream"}, "offset": "count", "limit": "count"}
PREFIXED = {"kind!": {"prefixed_string_array"}, "sourcePath!": "name", "outputPath": "name", "roleField": "name", "contentField": "name", "trimContent": _BOOL, "prefixes!": "object"}
PREFIXES = {"user!": "name", "assistant!": "name", "system": "name"}
ALPACA = {"kind!": {"alpaca"}, "instructionField": "name", "inputField": "name", "outputField": "name", "outputPath": "name", "roleField": "name", "contentField": "name"}
STAGE = {
    "name": "name", "id": "name", "description": _STR, "instructions!": "name", "system": _STR, "history": _STR, "reasoning": _BOOL,
    "mode": {"batch", "iter", "record_transform", "workflow_delegate"}, "dependsOn": "names", "parallelism": "positive", "metadata": "object",
    "rules": "object", "examples": "any", "when": "object", "input": "object", "transform": "object", "delegate": "object", "constrain": "object", "validate": "object", "retry": "object",
}
REWRITE = {"kind!": {"conversation_rewrite"}, "conversationsPath!": "name", "roleField!": "name", "contentField!": "name", "targetRoles!": "names", "includeOriginalTargetTurn": _BOOL}
DELEGATE = {
    "workflowPath!": "name", "inputFromPath!": "name", "inputAs": {"initial_context", "pipeline_input"}, "outputFrom": {"final_stage_output", "stage_key"},
    "outputStageKey": "name", "outputSelectPath": "name", "onFailure": {"fail", "warn"}, "inheritParentCli": {"none", "completion", "all"},
}
RULE = {"name": "name", "path": "name", "hint": "name"}
PATTERN = {"pattern!": "name", "flags": _STR}
NODES = {
    "string": {"minLength": "count", "maxLength": "count", "pattern": _STR}, "number": {"min": _NUM, "max": _NUM, "int": _BOOL}, "boolean": {}, "literal": {"value!": "scalar"},
    "enum": {"values!": "any"}, "array": {"items!": "object", "minItems": "count", "maxItems": "count"}, "object": {"shape!": "object", "additionalProperties": _BOOL},
}


class _Check:
    def __init__(self) -> None:
        self.errors: list[str] = []

    def say(self, path: str, message: str) -> None:
        self.errors.append(f"{path or '<root>'}: {message}")

    def block(self, value: Any, fields: dict, path: str, also: tuple[str, ...] = (), strict: bool = True) -> dict:
        if not isinstance(value, dict):
            self.say(path, "must be a mapping")
            return {}
        known = {k.rstrip("!"): (kind, k.endswith("!")) for k, kind in fields.items()}
        for k, v in value.items():
            at = f"{path}.{k}" if path else str(k)
            if k in known:
                if not _is(known[k][0], v):
                    self.say(at, "has a value of the wrong type")
            elif strict and k not in also:
                self.say(at, "is not a known field")
        for k, (_, required) in known.items():
            if required and k not in value:
                self.say(f"{path}.{k}" if path else k, "is required")
        return value

    def one_operator(self, when: dict, path: str, what: str) -> None:
        if ("equals" in when) == ("notEquals" in when):
            self.say(path, f"{what} requires exactly one of equals or notEquals")

    def rule(self, rule: Any, path: str) -> None:
        kind = rule.get("kind") if isinstance(rule, dict) else None
        if kind not in R.KINDS:
            self.say(path, "is not a known validator")
            return
        fields: dict[str, Any] = dict(RULE)
        if kind in R.COMPARISONS:
            fields["ref!" if kind.endswith("_ref") else "otherPath!"] = "name"
            if kind.startswith(R.SIMILARITY_KINDS):
                fields["threshold!"] = "ratio"
                self.block(rule.get("similarity", {}), {"mode": {"fast", "detailed"}}, f"{path}.similarity")
            if "scope" in rule:
                scope = self.block(rule["scope"], {}, f"{path}.scope", ("includePattern", "excludePatterns"))
                if not scope.get("includePattern") and not scope.get("excludePatterns"):
                    self.say(f"{path}.scope", "requires includePattern or excludePatterns")
                for p in [*([scope["includePattern"]] if scope.get("includePattern") else []), *(scope.get("excludePatterns") or [])]:
                    self.block(p, PATTERN, f"{path}.scope")
        elif kind.endswith("regex"):
            fields |= PATTERN
        elif kind.endswith("contains"):
            fields["value!"] = "name"
        else:
            fields["value!"] = "scalar" if kind in R.EQUAL_KINDS else "count"
        self.block(rule, fields, path, strict=False)
        if "when" in rule:
            self.one_operator(self.block(rule["when"], {"path": "name", "equals": "scalar", "notEquals": "scalar"}, f"{path}.when"), f"{path}.when", "validate.when")

    def node(self, node: Any, path: str) -> None:
        kind = node.get("type") if isinstance(node, dict) else None
        if kind not in NODES:
            self.say(path, "is not a known constrain type")
            return
        self.block(node, {"type!": {kind}, "optional": _BOOL, "nullable": _BOOL} | NODES[kind], path)
        if kind == "array" and isinstance(node.get("items"), dict):
            self.node(node["items"], f"{path}.items")
        for k, v in node["shape"].items() if kind == "object" and isinstance(node.get("shape"), dict) else ():
            self.node(v, f"{path}.shape.{k}")
        if kind == "enum" and not (isinstance(node.get("values"), list) and node["values"] and all(_is("scalar", v) for v in node["values"])):
            self.say(f"{path}.values", "must be a list of scalars")

    def stage(self, stage: Any, path: str) -> None:
        stage = self.block(stage, STAGE, path)
        for mode, part in (("record_transform", "transform"), ("workflow_delegate", "delegate")):
            if stage.get("mode") == mode and part not in stage:
                self.say(f"{path}.{part}", f"{mode} stages require a {part} block")
            if stage.get("mode") != mode and part in stage:
                self.say(f"{path}.{part}", f"{part} is only supported for {mode} stages")
        parts = {"transform": REWRITE, "delegate": DELEGATE, "input": {"source": {"pipeline_input", "previous_stage"}}, "rules": {"include": "strings", "exclude": "strings"}, "retry": {"enabled": _BOOL, "maxAttempts": "positive"}}
        for k, fields in parts.items():
            if k in stage:
                self.block(stage[k], fields, f"{path}.{k}")
        delegate = stage.get("delegate") or {}
        if delegate.get("outputFrom") == "stage_key" and not js.trim(str(delegate.get("outputStageKey") or "")):
            self.say(f"{path}.delegate.outputStageKey", "is required when outputFrom is stage_key")
        for i, e in enumerate(stage.get("examples") or [] if isinstance(stage.get("examples") or [], list) else [None]):
            self.block(e, {"input!": "said", "output!": "said"}, f"{path}.examples[{i}]")
        if "when" in stage:
            self.one_operator(self.block(stage["when"], {"path!": "name", "equals": "any", "notEquals": "any"}, f"{path}.when"), f"{path}.when", "stage.when")
        if "constrain" in stage:
            self.node(stage["constrain"], f"{path}.constrain")
        if "validate" in stage:
            own = self.block(stage["validate"], {"onFailure": {"fail", "warn"}, "rules!": "any"}, f"{path}.validate")
            if not isinstance(own.get("rules"), list) or not own["rules"]:
                self.say(f"{path}.validate.rules", "must be a list of validators")
            for i, r in enumerate(own.get("rules") or []):
                self.rule(r, f"{path}.validate.rules[{i}]")

    def document(self, doc: Any) -> None:
        doc = self.block(doc, DOCUMENT, "", ("input", "stages"))
        stages = doc.get("stages")
        if not isinstance(stages, list) or not stages:
            self.say("stages", "must be a list of stages")
            stages = []
        if "input" in doc:
            own = self.block(doc["input"], INPUT, "input", ("remap",))
            if "remap" in own:
                kind = own["remap"].get("kind") if isinstance(own["remap"], dict) else None
                remap = self.block(own["remap"], ALPACA if kind == "alpaca" else PREFIXED, "input.remap")
                if isinstance(remap.get("prefixes"), dict):
                    self.block(remap["prefixes"], PREFIXES, "input.remap.prefixes")
        for i, s in enumerate(stages):
            self.stage(s, f"stages[{i}]")
        stages = [s for s in stages if isinstance(s, dict)]
        for field in ("id", "name"):
            seen: set[str] = set()
            for i, s in enumerate(stages):
                if (v := s.get(field)) in seen and v is not None:
                    self.say(f"stages[{i}].{field}", f"duplicate stage {field} '{v}'")
                seen.add(v)
        keys = {s.get("id") or s.get("name") or f"stage-{i + 1}" for i, s in enumerate(stages)}
        for i, s in enumerate(stages):
            for d in s.get("dependsOn") or []:
                if d not in keys:
                    self.say(f"stages[{i}].dependsOn", f"unknown stage '{d}'")
            if (s.get("input") or {}).get("source") == "pipeline_input" and s.get("mode") == "record_transform" and "input" not in doc:
                self.say(f"stages[{i}].input", "a stage over pipeline_input needs an input block")


def parse_workflow(text: str) -> dict:
    """A checked workflow document from YAML text."""
    try:
        doc = yaml.load(text, _Yaml12)  # noqa: S506 - a SafeLoader
    except yaml.YAMLError as e:
        raise PipelineParseError(f"Failed to parse workflow YAML: {e}") from e
    return validate_workflow(doc)


def validate_workflow(doc: Any) -> dict:
    check = _Check()
    check.document(doc)
    if check.errors:
        raise PipelineValidationError("Invalid workflow: " + "; ".join(check.errors))
    return doc


def load_workflow(path: str) -> dict:
    return parse_workflow(Path(path).read_text(encoding="utf-8"))


__all__ = ["PipelineParseError", "PipelineValidationError", "load_workflow", "parse_workflow", "validate_workflow"]
