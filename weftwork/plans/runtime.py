"""Workflow runs: document to plan to results, artifacts, delegated workflows, and the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftwork.functions import js
from weftwork.operators.remap import InputDatasetRemapError
from weftwork.plans import config, dag
from weftwork.plans.engine import Result, StageEngine, StageError
from weftwork.plans.model import HttpClient, ModelClient, ModelOptions, api_key_of, endpoint_of, is_auth_failure, model_name
from weftwork.sources.records import InputDatasetParseError, InputDatasetValidationError, load_records, records_of, to_jsonl, write_jsonl
from weftwork.streaming.record_stream import CheckpointError, can_stream, run_stream

DEEPEST = 3
EXIT_OK, EXIT_ERROR, EXIT_FAILED = 0, 2, 3


class DelegationError(RuntimeError):
    pass


@dataclass(frozen=True)
class RunOptions:
    """What the command line sets."""

    model: str | None = None
    endpoint: str | None = None
    provider: str | None = None
    api_key: str | None = None
    max_tokens: int | None = None
    temperature: float | None = None
    http_referer: str | None = None
    x_title: str | None = None
    output_dir: str | None = None
    context: Any = js.MISSING
    parallelism: int | None = None
    checkpoint: str | None = None
    checkpoint_every: int | None = None
    resume: bool = False
    think: bool = False

    def inherited(self, how: str) -> RunOptions:
        """What a delegated workflow takes over: nothing, what shapes completions, or all but outputs and resuming."""
        if how == "none":
            return RunOptions()
        if how == "completion":
            return RunOptions(**{k: getattr(self, k) for k in ("model", "endpoint", "provider", "api_key", "max_tokens", "temperature", "http_referer", "x_title", "think")})
        return replace(self, output_dir=None, checkpoint=None, checkpoint_every=None, resume=False)


def client_of(document: dict, options: RunOptions) -> HttpClient:
    provider = options.provider or document.get("provider") or os.environ.get("WEFTWORK_PROVIDER", "openai").lower()
    key = api_key_of(options.api_key, document.get("apiKeyEnv"))
    headers = {"HTTP-Referer": options.http_referer or document.get("httpReferer"), "X-Title": options.x_title or document.get("xTitle")}
    return HttpClient(endpoint_of(provider, options.endpoint or document.get("endpoint") or os.environ.get("WEFTWORK_ENDPOINT")), key, {k: v for k, v in headers.items() if v})


class WorkflowRunner:
    def __init__(self, spark: SparkSession, client: ModelClient | None = None, distributed: bool = True, reporter: Any = None) -> None:
        self.spark, self.client, self.distributed, self.reporter = spark, client, distributed, reporter

    def run(self, path: str, options: RunOptions = RunOptions(), artifacts: bool = True, ancestry: tuple[str, ...] = (), records: DataFrame | None = None) -> tuple[Result, dict, dict]:
        """(result, document, report) of a workflow file."""
        began, real = time.time(), os.path.realpath(path)
        document = config.load_workflow(path)
        client = self.client or client_of(document, options)
        name = model_name(options.model, document, os.environ | ({"WEFTWORK_MODEL": "stub"} if self.client else {}))
        model = ModelOptions(name, think=options.think, reasoning_mode=document.get("reasoningMode", "off")).merged(max_tokens=options.max_tokens or document.get("maxTokens"), temperature=options.temperature if options.temperature is not None else document.get("temperature"))
        folder, stem = options.output_dir or document.get("outputDir") or "./output", document.get("name") or Path(path).stem
        if artifacts and can_stream(document, options.resume, options.checkpoint_every):
            return self._stream(document, path, client, model, f"{folder}/{stem}.jsonl", options, began)
        source = load_records(self.spark, document["input"]) if document.get("input") else None

        def delegate(block: dict, value: Any) -> tuple[Result, str]:
            child = os.path.realpath(os.path.join(os.path.dirname(real), block["workflowPath"]))
            if child in (*ancestry, real):
                raise DelegationError(f"Delegation cycle detected for workflow '{child}'")
            if len(ancestry) + 1 > DEEPEST:
                raise DelegationError(f"Delegation max depth {DEEPEST} exceeded at '{child}'")
            own = options.inherited(block.get("inheritParentCli", "none"))
            as_input = block.get("inputAs", "initial_context") == "pipeline_input"
            own = own if as_input else replace(own, context=value)
            got, doc, _ = self.run(child, own, False, (*ancestry, real), records_of(self.spark, value) if as_input else None)
            return got, dag.stage_key(doc["stages"][-1], len(doc["stages"]) - 1)

        engine = StageEngine(self.spark, client, model, options.parallelism, delegate, self.distributed, None if ancestry else self.reporter)
        result = engine.run(document["stages"], options.context, records if records is not None else source)
        report = self.report(result, document, path, began)
        if artifacts:
            os.makedirs(folder, exist_ok=True)
            if result.ok:
                last = result.outputs.get(dag.stage_key(document["stages"][-1], len(document["stages"]) - 1), js.MISSING)
                if isinstance(last, DataFrame):
                    write_jsonl(last, f"{folder}/{stem}.jsonl")
                else:
                    Path(f"{folder}/{stem}.jsonl").write_text(to_jsonl(last), encoding="utf-8")
            Path(f"{folder}/{stem}.report.json").write_text(json.dumps(report, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
        return result, document, report

    def _stream(self, document: dict, path: str, client: ModelClient, model: ModelOptions, output: str, options: RunOptions, began: float) -> tuple[Result, dict, dict]:
        result = Result(statuses={dag.stage_key(document["stages"][0], 0): "executed"})
        extra: dict = {}
        try:
            state = run_stream(self.spark, document, path, client, model, output, options.checkpoint, options.checkpoint_every, options.resume)
            result.warnings = state.pop("warnings")
            extra = state
        except StageError as e:
            result.ok, result.failed = False, e.as_dict()
        report = self.report(result, document, path, began) | extra
        Path(output).parent.mkdir(parents=True, exist_ok=True)
        Path(output.removesuffix(".jsonl") + ".report.json").write_text(json.dumps(report, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
        return result, document, report

    def report(self, result: Result, document: dict, path: str, began: float) -> dict:
        return {
            "ok": result.ok, "pipelinePath": path, "name": document.get("name") or Path(path).stem, "startedAt": datetime.fromtimestamp(began, UTC).isoformat(), "durationMs": round(1000 * (time.time() - began)),
            "stageStatuses": result.statuses, "dependencyGraph": result.dependencies, "warnings": result.warnings, "failedStage": result.failed, "traces": result.traces,
        }


def classify(error: BaseException) -> tuple[str, str]:
    """(error type, hint) of a run that could not start or go on."""
    if "api key env" in str(error).lower() or is_auth_failure(str(error)):
        return "AuthenticationError", "Check that the API key is set, valid and in the variable that the workflow names."
    for kind, hint in (
        (config.PipelineParseError, "Check the YAML syntax of the workflow."), (config.PipelineValidationError, "Check the workflow's fields."),
        (InputDatasetParseError, "Check that every line or the file is JSON."), (InputDatasetRemapError, "Check the remap against the records."), (InputDatasetValidationError, "Check the input's path and format."),
        (CheckpointError, "Check the checkpoint file."), (DelegationError, "Check which workflows delegate to each other."), (FileNotFoundError, "Check the path."),
    ):
        if isinstance(error, kind):
            return type(error).__name__, hint
    return type(error).__name__, "See the error."


def initial_context(text: str | None, path: str | None) -> Any:
    if text is not None and path is not None:
        raise ValueError("Use either --context or --context-file, not both")
    if path is not None:
        text = Path(path).read_text(encoding="utf-8")
    return js.MISSING if text is None else js.parse_json(text)


def parse_args(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="weftwork")
    p.add_argument("pipeline")
    for flag in ("--model", "--api-key", "--http-referer", "--x-title", "--out", "--output-dir", "--context", "--context-file", "--endpoint", "--resume"):
        p.add_argument(flag)
    p.add_argument("--provider", choices=("openai", "ollama"))
    p.add_argument("--max-tokens", type=int)
    p.add_argument("--temperature", type=float)
    p.add_argument("--parallelism", type=int)
    p.add_argument("--checkpoint-every", type=int)
    p.add_argument("--console", choices=("quiet", "summary", "warnings", "full"), default="summary")
    p.add_argument("--progress", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--show-thoughts", action="store_true")
    return p.parse_args(args)


def main(args: list[str] | None = None, spark: SparkSession | None = None, client: ModelClient | None = None, out: Any = None) -> int:
    from weftwork.plans.reporter import Reporter

    cli = parse_args(sys.argv[1:] if args is None else args)
    reporter = Reporter(cli.console, cli.progress, out or sys.stderr)
    folder = cli.output_dir
    try:
        checkpoint = cli.resume or (f"{folder or './output'}/{Path(cli.pipeline).stem}.checkpoint.json" if cli.checkpoint_every else None)
        if checkpoint:
            os.makedirs(os.path.dirname(checkpoint) or ".", exist_ok=True)
        options = RunOptions(
            cli.model, cli.endpoint, cli.provider, cli.api_key, cli.max_tokens, cli.temperature, cli.http_referer, cli.x_title, folder,
            initial_context(cli.context, cli.context_file), cli.parallelism, checkpoint, cli.checkpoint_every, bool(cli.resume), cli.show_thoughts,
        )
        spark = spark or SparkSession.builder.appName("weftwork").getOrCreate()
        result, _, report = WorkflowRunner(spark, client, reporter=reporter).run(cli.pipeline, options)
        if cli.out:
            os.makedirs(os.path.dirname(cli.out) or ".", exist_ok=True)
            Path(cli.out).write_text(json.dumps(report, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    except Exception as e:  # noqa: BLE001 - the top level reports whatever ended the run
        kind, hint = classify(e)
        reporter.error(kind, hint, e)
        if folder:
            os.makedirs(folder, exist_ok=True)
            Path(f"{folder}/{Path(cli.pipeline).stem}.failure.json").write_text(json.dumps({"errorType": kind, "hint": hint, "error": {"name": kind, "message": str(e)}}, indent=2), encoding="utf-8")
        return EXIT_ERROR
    reporter.finish(report)
    return EXIT_OK if result.ok else EXIT_FAILED


if __name__ == "__main__":
    sys.exit(main())
