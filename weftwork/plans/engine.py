"""Stage execution: batch, iter, record_transform and workflow_delegate over a DAG of stages.

Arrays are record DataFrames; what one prompt needs (a whole output, a scalar) is a value on the driver.  Model calls
over many items run in Arrow batches, each item with its own attempts, and their results are written once before they
are looked at, so no call is repeated by a later action.  Calls carry no chat history.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import js, model_json
from weftwork.operators import constrain
from weftwork.operators import rules as R
from weftwork.operators.rewrite import attempts_of, rewrite_record, said
from weftwork.plans import dag, prompts
from weftwork.plans.model import ModelClient, ModelOptions, is_auth_failure
from weftwork.sources.records import arrow_map, records_of, values_of
from weftwork.sources.scratch import written

RETRIED = ("invalid_json", "constrain_mismatch", "validator_mismatch")
#: Of more items than these a report does not hold the traces but names the table that does.
TRACED_ITEMS = 1000
RETRYABLE = frozenset((*RETRIED, "model_call_failed"))


class StageError(RuntimeError):
    def __init__(self, kind: str, message: str, stage: str = "", index: int = 0, raw: str | None = None) -> None:
        super().__init__(message)
        self.kind, self.stage, self.index, self.raw = kind, stage, index, raw

    def as_dict(self) -> dict:
        return {"kind": self.kind, "stageIdentifier": self.stage, "stageIndex": self.index, "message": str(self), "retryable": self.kind in RETRYABLE, "rawModelOutput": self.raw}


@dataclass
class Result:
    ok: bool = True
    outputs: dict[str, Any] = field(default_factory=dict)
    statuses: dict[str, str] = field(default_factory=dict)
    dependencies: dict[str, list[str]] = field(default_factory=dict)
    traces: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    failed: dict | None = None

    def value(self, key: str) -> Any:
        out = self.outputs.get(key, js.MISSING)
        return values_of(out) if isinstance(out, DataFrame) else out


#: Runs a child workflow: (delegate block, input value) -> (result, key of its last declared stage).
Delegate = Callable[[dict, Any], tuple[Result, str]]


def call_once(stage: dict, prompt: str, client: ModelClient, options: ModelOptions, single: bool, attempts: int) -> dict:
    """A structured answer under the stage's constraint and rules, with retries: {output | error, warnings, traces}."""
    rules, fail = (stage.get("validate") or {}).get("rules"), (stage.get("validate") or {}).get("onFailure", "fail") == "fail"
    base, traces = prompt, []
    for attempt in range(1, attempts + 1):
        raw, issues, kind, reason, value = None, [], None, "", None
        try:
            raw = client.complete(prompt, options, "")
        except Exception as e:  # noqa: BLE001 - the client's failure is the stage's
            kind, reason = ("constrain_mismatch" if stage.get("constrain") else "model_call_failed"), str(e)
        if kind is None and stage.get("constrain"):
            try:
                value = constrain.check(stage["constrain"], js.parse_json(raw))
            except (ValueError, RecursionError) as e:
                kind, reason = "constrain_mismatch", f"Model output does not satisfy stage constrain schema: {e}"
        elif kind is None:
            try:
                value = model_json.parse(raw)
            except ValueError:
                kind, reason = "invalid_json", "Model output is not valid JSON"
        if kind is None and single and not isinstance(value, dict):
            kind, reason = "invalid_json", "Iter stage output must be a single JSON object (not an array or primitive)"
        if kind is None:
            issues = R.validate(value, rules)
            if issues and fail:
                kind, reason = "validator_mismatch", "Model output failed stage validators: " + "; ".join(i["message"] for i in issues)
        traces.append({"attempt": attempt, "maxAttempts": attempts, "promptSnapshot": prompt, "rawModelOutput": raw, "validationIssues": issues, "failureKind": kind, "success": kind is None})
        if kind is None:
            warnings = [{"kind": f"validator_mismatch.{i['kind']}", "message": said([i])} for i in issues]
            return {"output": value, "warnings": warnings, "traces": traces}
        if kind not in RETRIED or attempt == attempts:
            return {"error": {"kind": kind, "message": reason, "raw": raw}, "warnings": [], "traces": traces}
        prompt = base + "\n\n" + prompts.retry_feedback(attempt, kind, reason, issues, attempts)
    raise AssertionError("attempts is at least 1")


class StageEngine:
    def __init__(self, spark: SparkSession, client: ModelClient, options: ModelOptions | None = None, parallelism: int | None = None, delegate: Delegate | None = None, distributed: bool = True, reporter: Any = None) -> None:
        """distributed: send the client to the executors (it must be picklable and give the same text again)."""
        self.spark, self.client, self.options = spark, client, options or ModelOptions()
        self.parallelism, self.delegate, self.distributed, self.reporter = parallelism, delegate, distributed, reporter

    def run(self, stages: list[dict], initial: Any = js.MISSING, records: DataFrame | None = None) -> Result:
        result, prior = Result(), []
        try:
            nodes = dag.resolve(stages)
        except dag.StageGraphError as e:
            result.ok, result.failed = False, StageError("invalid_record_transform_input", str(e)).as_dict()
            return result
        result.dependencies = {n.key: n.depends_on for n in nodes}

        def context(path: str) -> dict:
            """What ``path`` may look at: outputs that it does not name stay where they are."""
            return ({} if initial is js.MISSING else {"initialContext": initial}) | {"outputsByStage": {k: result.value(k) for k in result.outputs if k in path or path.count(".") == 0}}

        for done, node in enumerate(nodes):
            if self.reporter:
                self.reporter.progress(done, len(nodes))
            if any(result.statuses[d] != "executed" for d in node.depends_on):
                result.statuses[node.key] = "blocked"
                continue
            if node.stage.get("when") and not dag.gate(node.stage, context(node.stage["when"].get("path") or "")):
                result.statuses[node.key] = "skipped"
                continue
            try:
                if node.stage.get("constrain"):
                    try:
                        constrain.compile(node.stage["constrain"])
                    except constrain.ConstrainDeclarationError as e:
                        raise StageError("constrain_mismatch", f"Invalid stage constrain declaration: {e}") from e
                chained = self._execute(node, initial, records, prior, result, context)
            except StageError as e:
                e.stage, e.index = node.key, node.index
                result.ok, result.failed = False, e.as_dict()
                return result
            result.statuses[node.key] = "executed"
            if chained:
                prior.append((node.key, result.outputs[node.key]))
        if self.reporter:
            self.reporter.progress(len(nodes), len(nodes))
        return result

    def _execute(self, node: dag.Node, initial: Any, records: DataFrame | None, prior: list, result: Result, context: Callable[[str], dict]) -> bool:
        """Put the node's output into the result; whether later prompts see it."""
        mode = node.stage.get("mode", "batch")
        if mode == "workflow_delegate":
            return self._delegate(node, result, context)
        {"batch": self._batch, "iter": self._iter}.get(mode, self._transform)(node, initial, records, prior, result)
        return True

    def _note(self, node: dag.Node, result: Result, warnings: list[dict], record: int | None = None) -> None:
        base = {"stageIdentifier": node.key, "stageIndex": node.index} | ({} if record is None else {"recordIndex": record})
        result.warnings += [base | w for w in warnings]
        for w in warnings if self.reporter else ():
            self.reporter.warning(base | w)

    def _batch(self, node: dag.Node, initial: Any, records: DataFrame | None, prior: list, result: Result) -> None:
        told = [{"stageIdentifier": k, "output": values_of(v) if isinstance(v, DataFrame) else v} for k, v in prior]
        got = call_once(node.stage, prompts.stage_prompt(node.stage, initial, told), self.client, self.options, False, 1)
        result.traces.append({"stageIdentifier": node.key, "stageIndex": node.index, "subtraces": got["traces"]})
        if "error" in got:
            raise StageError(got["error"]["kind"], got["error"]["message"], raw=got["error"]["raw"])
        self._note(node, result, got["warnings"])
        result.outputs[node.key] = got["output"]

    def _width(self, stage: dict) -> int:
        return max(1, min(stage.get("parallelism") or 1, self.parallelism or 1))

    def _each(self, items: DataFrame, stage: dict, each: Callable[[int, Any], dict]) -> list[dict] | DataFrame:
        """``each`` over the items: as a written table (_ord, _result), from executors or, for a client that stays here, the driver."""
        if self.distributed:
            spread = items.repartition(self._width(stage)) if self.parallelism else items
            packed = spread.select("_ord", F.to_json(F.struct("_ord", "_json")).alias("_json"))

            def run(x: str) -> str:
                row = json.loads(x)
                return js.to_json(each(row["_ord"], json.loads(row["_json"])))

            return written(arrow_map(packed, run, "_result"), "stage")
        rows = [(r["_ord"], js.to_json(each(r["_ord"], json.loads(r["_json"])))) for r in items.orderBy("_ord").collect()]
        return self.spark.createDataFrame(rows, "_ord long, _result string")

    @staticmethod
    def _read(done: DataFrame, path: str, kind: str = "string") -> Any:
        return F.from_json(F.get_json_object("_result", path), kind) if kind != "string" else F.get_json_object("_result", path)

    def _first_error(self, done: DataFrame, path: str = "$.error") -> tuple[int, dict] | None:
        bad = done.select("_ord", F.get_json_object("_result", path).alias("e")).where("e is not null").agg(F.min(F.struct("_ord", "e")).alias("m")).first().m
        return (bad._ord, json.loads(bad.e)) if bad else None

    def _traced(self, node: dag.Node, result: Result, done: DataFrame, name: str) -> None:
        """The items' traces: in the report, or where they are many, in the stage's written table, which the report names."""
        base = {"stageIdentifier": node.key, "stageIndex": node.index}
        n = done.count()
        if n > TRACED_ITEMS:
            result.traces.append(base | {"items": n, "subtracesTable": os.path.commonpath(done.inputFiles()) if done.inputFiles() else None})
        else:
            result.traces.append(base | {"subtraces": [{name: i} | t for i, t in self._side(done, "traces")]})

    def _side(self, done: DataFrame, field_: str) -> list[tuple[int, dict]]:
        """Warnings or traces of the items, in order."""
        rows = done.select("_ord", F.get_json_object("_result", f"$.{field_}").alias("x")).where("x <> '[]'").orderBy("_ord").collect()
        return [(r._ord, w) for r in rows for w in json.loads(r.x)]

    def _iter(self, node: dag.Node, initial: Any, records: DataFrame | None, prior: list, result: Result) -> None:
        if not node.depends_on:
            raise StageError("invalid_iter_input", "Iter mode requires a previous stage output array")
        key = node.depends_on[-1]
        source = result.outputs.get(key)
        if not isinstance(source, (list, DataFrame)):
            raise StageError("invalid_iter_input", f"Iter mode requires previous stage '{key}' output to be a JSON array")
        items = source if isinstance(source, DataFrame) else records_of(self.spark, source)
        kept = [{"stageIdentifier": k, "output": v} for k, v in prior if not isinstance(v, (list, DataFrame))]
        stage, client, options, attempts = node.stage, self.client, self.options, attempts_of(node.stage)

        def each(i: int, item: Any) -> dict:
            told = [*kept, {"stageIdentifier": key, "output": item}]
            return call_once(stage, prompts.stage_prompt(stage, initial, told, item), client, options, True, attempts)

        done = self._each(items, stage, each)
        if bad := self._first_error(done):
            raise StageError(bad[1]["kind"], f"Iter item {bad[0]} failed: {bad[1]['message']}", raw=bad[1].get("raw"))
        for i, w in self._side(done, "warnings"):
            self._note(node, result, [w], i)
        self._traced(node, result, done, "itemIndex")
        result.outputs[node.key] = done.select("_ord", self._read(done, "$.output").alias("_json"))

    def _transform(self, node: dag.Node, initial: Any, records: DataFrame | None, prior: list, result: Result) -> None:
        stage = node.stage
        wants = (stage.get("input") or {}).get("source") or ("previous_stage" if node.depends_on else "pipeline_input")
        if wants == "pipeline_input":
            items = records
            if items is None:
                raise StageError("invalid_record_transform_input", "record_transform requires pipeline input records")
        else:
            if not node.depends_on:
                raise StageError("invalid_record_transform_input", "record_transform has no previous stage to read")
            items = result.outputs.get(node.depends_on[-1])
            if isinstance(items, list):
                items = records_of(self.spark, items)
            if not isinstance(items, DataFrame):
                raise StageError("invalid_record_transform_input", f"record_transform requires previous stage '{node.depends_on[-1]}' output to be an array")
        done = self._each(items, stage, transform_function(stage, self.client, self.options))
        if bad := self._first_error(done):
            raise StageError(bad[1]["kind"], bad[1]["message"])
        for i, w in self._side(done, "warnings"):
            self._note(node, result, [w], i)
        self._traced(node, result, done, "recordIndex")
        result.outputs[node.key] = done.select("_ord", self._read(done, "$.output").alias("_json"))

    def _delegate(self, node: dag.Node, result: Result, context: Callable[[str], dict]) -> bool:
        block = node.stage["delegate"]
        warn = block.get("onFailure", "fail") == "warn"

        def fail(message: str, chained: bool) -> bool:
            if not warn:
                raise StageError("delegated_workflow_failed", message)
            self._note(node, result, [{"kind": "delegated_workflow_failed", "message": message}])
            result.outputs[node.key] = None
            return chained

        try:
            value = js.get_path(context(block["inputFromPath"]), block["inputFromPath"])
        except js.PathError as e:
            return fail(f"Delegated workflow input could not be resolved: {e}", False)
        if block.get("inputAs", "initial_context") == "pipeline_input" and not isinstance(value, list):
            return fail("Delegated workflow pipeline_input requires an array", True)
        if self.delegate is None:
            raise StageError("delegated_workflow_failed", "no workflow runner is set")
        child, last = self.delegate(block, value)
        result.warnings += [{**w, "stageIdentifier": f"{node.key}::{w['stageIdentifier']}"} for w in child.warnings]
        result.traces.append({"stageIdentifier": node.key, "stageIndex": node.index, "delegatedRun": {"ok": child.ok, "traces": child.traces}})
        if not child.ok:
            return fail(f"Delegated workflow failed: {child.failed['message'] if child.failed else ''}", True)
        out = child.value(block["outputStageKey"] if block.get("outputFrom") == "stage_key" else last)
        try:
            if out is js.MISSING:
                raise js.PathError("Delegated workflow output is not available")
            result.outputs[node.key] = js.get_path(out, block.get("outputSelectPath"))
        except js.PathError as e:
            return fail(str(e), True)
        return True


def transform_function(stage: dict, client: ModelClient, options: ModelOptions) -> Callable[[int, Any], dict]:
    """One record through the rewrite and the record rules: {output, warnings, traces, error?}."""
    own = stage.get("validate") or {}

    def each(i: int, record: Any) -> dict:
        done = rewrite_record(record, stage, lambda prompt: client.complete(prompt, options))
        issues = R.validate(done.record, own.get("rules"), skip_inapplicable=True)
        out: dict[str, Any] = {"output": done.record, "warnings": list(done.warnings), "traces": done.traces}
        if issues and own.get("onFailure", "fail") == "fail":
            out["error"] = {"kind": "validator_mismatch", "message": "Transformed record failed stage validators: " + "; ".join(x["message"] for x in issues)}
        elif issues:
            out["warnings"] += [{"kind": f"validator_mismatch.{x['kind']}", "message": said([x])} for x in issues]
        auth = next((w for w in done.warnings if w["kind"] == "model_call_failed" and is_auth_failure(w["message"])), None)
        if auth and "error" not in out:
            out["error"] = {"kind": "model_call_failed", "message": auth["message"]}
        return out

    return each
