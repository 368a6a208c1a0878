"""Streaming record transforms: bounded batches of records, append output, and a checkpoint to resume from.

The source is a Structured Streaming reader whose offsets are record numbers, so a batch holds at most
``checkpoint_every`` records (BATCH where none is set).  Each batch writes one file named by its first record before the checkpoint moves; a batch
that runs again writes the same file again, so a restart repeats work but not output.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weftwork.functions import js
from weftwork.plans.engine import StageError, transform_function
from weftwork.plans.model import ModelClient, ModelOptions
from weftwork.sources.records import InputDatasetValidationError, arrow_map, infer_format
from weftwork.sources.scratch import written


class CheckpointError(ValueError):
    pass


def can_stream(document: dict, resume: bool = False, every: int | None = None) -> bool:
    """One record_transform stage over the pipeline's own input, and something that asks for a stream."""
    stages, source = document["stages"], document.get("input")
    one = len(stages) == 1 and stages[0].get("mode") == "record_transform" and (stages[0].get("input") or {}).get("source", "pipeline_input") == "pipeline_input"
    return bool(one and source and (source.get("readMode") == "stream" or resume or every))


def load_checkpoint(path: str, pipeline: str | None = None) -> dict:
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    for key, ok in (("pipelinePath", isinstance(found.get("pipelinePath"), str)), ("stageIdentifier", isinstance(found.get("stageIdentifier"), str))):
        if not ok:
            raise CheckpointError(f"Checkpoint is missing {key}")
    n = found.get("nextRecordOffset")
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise CheckpointError("Checkpoint is missing valid nextRecordOffset")
    if pipeline is not None and found["pipelinePath"] != pipeline:
        raise CheckpointError(f"Checkpoint pipelinePath '{found['pipelinePath']}' does not match requested pipeline '{pipeline}'")
    return found


def write_checkpoint(path: str, pipeline: str, stage: str, offset: int, source: str | None = None, output: str | None = None) -> None:
    row = {"pipelinePath": pipeline, "inputPath": source, "stageIdentifier": stage, "nextRecordOffset": offset, "outputJsonlPath": output, "updatedAt": datetime.now(UTC).isoformat()}
    part = f"{path}.part"
    Path(part).write_text(json.dumps({k: v for k, v in row.items() if v is not None}, indent=2) + "\n", encoding="utf-8")
    os.replace(part, path)


#: Records of a batch where none are asked for, and of each of its partitions.
BATCH, PART = 1000, 250


def _records(path: str, n: int = 0, byte: int = 0) -> Iterator[tuple[int, str, int, int]]:
    """(number, text, start, end) of the non-blank lines from ``byte`` on, the first numbered ``n``, without holding the file."""
    with open(path, "rb") as f:
        f.seek(byte)
        for line in f:
            text, start = js.trim(line.decode("utf-8")), byte
            byte += len(line)
            if text:
                yield n, text, start, byte
                n += 1


class _Range(InputPartition):
    def __init__(self, first: int, end: int, byte: int) -> None:
        self.first, self.end, self.byte = first, end, byte


class _Reader(DataSourceStreamReader):
    """Offsets are a record's number and its byte, so that a batch reads its own part of the file and no more."""

    def __init__(self, options: dict) -> None:
        self.path, self.start = options["path"], int(options.get("start", 0))
        self.most, self.every = int(options.get("limit", 1 << 60)), int(options.get("every", BATCH))
        self._at: dict | None = None
        self._marks: dict[int, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        byte = next((start for n, _, start, _ in _records(self.path) if n == self.start), None)
        return {"record": self.start, "byte": os.path.getsize(self.path) if byte is None else byte}

    def latestOffset(self) -> dict:  # noqa: N802
        at = self._at = self._at or self.initialOffset()
        end, self._marks = dict(at), {}
        left = min(self.every, self.start + self.most - at["record"])
        for n, _, start, stop in itertools.islice(_records(self.path, at["record"], at["byte"]), max(0, left)):
            if (n - at["record"]) % PART == 0:
                self._marks[n] = start
            end = {"record": n + 1, "byte": stop}
        self._at = end
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self._at is None or self._at["record"] < end["record"]:
            self._at = dict(end)
        marks = {start["record"]: start["byte"]} | {n: b for n, b in self._marks.items() if start["record"] < n < end["record"]}
        firsts = sorted(marks)
        return [_Range(n, stop, marks[n]) for n, stop in zip(firsts, [*firsts[1:], end["record"]], strict=True)]

    def read(self, part: _Range) -> Iterator[tuple]:
        for n, text, _, _ in itertools.islice(_records(self.path, part.first, part.byte), max(0, part.end - part.first)):
            yield n, text

    def commit(self, end: dict) -> None:
        pass


class JsonlRecords(DataSource):
    """``spark.readStream.format("jsonl_records")``: options path, start, limit and every."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_records"

    def schema(self) -> str:
        return "_ord long, _json string"

    def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


def run_stream(spark: SparkSession, document: dict, pipeline: str, client: ModelClient, options: ModelOptions, output: str, checkpoint: str | None = None, every: int | None = None, resume: bool = False, stream_state: str | None = None) -> dict:
    """Rewrite the records of a one-stage workflow.  output: a folder of JSON lines files.  Returns counters and
    warnings.  The original window (offset, limit) also bounds a resumed run."""
    source, stage = document["input"], document["stages"][0]
    if (source.get("format") or infer_format(source["path"])) != "jsonl":
        raise InputDatasetValidationError(f"readMode=stream is currently only supported for jsonl input: {source['path']}")
    key, first = stage.get("id") or stage.get("name") or "stage-1", source.get("offset", 0)
    end = first + source["limit"] if "limit" in source else None
    start = max(first, load_checkpoint(checkpoint, pipeline)["nextRecordOffset"]) if resume and checkpoint else first
    state: dict[str, Any] = {"resumeFrom": start, "processedCount": 0, "warnings": []}
    each = transform_function(stage, client, options)
    Path(output).mkdir(parents=True, exist_ok=True)
    if not resume:
        for old in Path(output).glob("records-*.jsonl"):
            old.unlink()

    def one(text: str) -> str:
        try:
            return js.to_json(each(0, js.parse_json(text)))
        except ValueError:
            return js.to_json({"error": {"kind": "invalid_json", "message": "Failed to parse JSONL record"}, "warnings": []})

    def batch(df: DataFrame, _: int) -> None:
        done = written(arrow_map(df, one, "_result"), "stream").orderBy("_ord").collect()  # at most ``every`` records
        lines, at = [], None
        for r in done:
            got = json.loads(r["_result"])
            call = next((w for w in got["warnings"] if w["kind"] == "model_call_failed"), None)
            error = {"kind": "model_call_failed", "message": call["message"]} if call else got.get("error")
            if error:
                at = (r["_ord"], error)
                break
            lines.append(js.to_json(got["output"]) + "\n")
            state["warnings"] += [{"stageIdentifier": key, "stageIndex": 0, "recordIndex": r["_ord"] - first} | w for w in got["warnings"]]
        if lines:
            name = f"{output}/records-{done[0]['_ord']:015d}.jsonl"
            Path(f"{name}.part").write_text("".join(lines), encoding="utf-8")
            os.replace(f"{name}.part", name)
            state["processedCount"] += len(lines)
        if checkpoint and done:
            write_checkpoint(checkpoint, pipeline, key, done[0]["_ord"] + len(lines), source["path"], output)
        if at:
            raise StageError(at[1]["kind"], f"Record {at[0]}: {at[1]['message']}", key)

    spark.dataSource.register(JsonlRecords)
    reader = spark.readStream.format("jsonl_records").option("path", source["path"]).option("start", start)
    if end is not None:
        reader = reader.option("limit", max(0, end - start))
    if every:
        reader = reader.option("every", every)
    writer = reader.load().writeStream.foreachBatch(batch)
    if stream_state:
        writer = writer.option("checkpointLocation", stream_state)
    query = writer.start()
    try:
        query.processAllAvailable()
    except Exception as e:
        raise StageError("model_call_failed" if "model_call_failed" in str(e) else "validator_mismatch", str(e).split("\n")[0], key) from e
    finally:
        query.stop()
    if checkpoint and not state["processedCount"]:
        write_checkpoint(checkpoint, pipeline, key, start, source["path"], output)
    return state
