"""Stage graphs, stages, rewrites, streaming and the command line, with scripted and stub models."""

import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from weftwork.functions import js
from weftwork.operators import rewrite
from weftwork.plans import dag, prompts, reporter, runtime
from weftwork.plans.engine import StageEngine
from weftwork.plans.model import HttpClient, ModelError, ModelOptions, ScriptedClient, StubClient, endpoint_of, model_name, reasoning_fields, stream_tokens
from weftwork.sources import records as rec
from weftwork.streaming import record_stream as stream


def stages(*rows):
    return [{"instructions": "do", **r} for r in rows]


def run(spark, own, replies, **more):
    client = ScriptedClient(list(replies))
    return StageEngine(spark, client, distributed=False).run(own, **more), client


# --- graph -------------------------------------------------------------------------------------------------------


def test_graph():
    own = stages({"id": "seed"}, {"id": "a", "dependsOn": ["seed"]}, {"id": "b", "dependsOn": ["seed"]}, {"id": "merge", "dependsOn": ["a", "b"]})
    assert [n.key for n in dag.resolve(own)] == ["seed", "a", "b", "merge"]
    assert [n.key for n in dag.resolve(stages({"id": "r"}, {"id": "z", "dependsOn": ["y"]}, {"id": "y", "dependsOn": ["r"]}))] == ["r", "y", "z"]
    assert [n.depends_on for n in dag.resolve(stages({}, {}, {"name": "n"}))] == [[], ["stage-1"], ["stage-2"]]
    for bad, say in ((stages({"id": "a", "dependsOn": ["b"]}, {"id": "b", "dependsOn": ["a"]}), "Cycle detected in stage dependency graph involving: a, b"), (stages({"id": "a", "dependsOn": ["a"]}), "cannot depend on itself"), (stages({"id": "a", "dependsOn": ["q"]}), "depends on unknown stage")):
        with pytest.raises(dag.StageGraphError, match=say):
            dag.resolve(bad)


def test_fan_in_and_gates(spark):
    own = stages({"id": "seed"}, {"id": "a", "dependsOn": ["seed"]}, {"id": "b", "dependsOn": ["seed"]}, {"id": "merge", "dependsOn": ["a", "b"]})
    out, client = run(spark, own, ['{"s":1}', '{"a":1}', "[1]", '"m"'])
    assert out.ok and list(out.outputs) == ["seed", "a", "b", "merge"] and all(k in client.prompts[3] for k in ('"seed"', '"a"', '"b"'))
    own = stages({"id": "seed"}, {"id": "c", "when": {"path": "outputsByStage.seed.enabled", "equals": True}}, {"id": "d"})
    out, _ = run(spark, own, ['{"enabled":false}'])
    assert out.ok and out.statuses == {"seed": "executed", "c": "skipped", "d": "blocked"}
    assert not dag.gate({"when": {"path": "x.y", "notEquals": 1}}, {})
    out, _ = run(spark, stages({"id": "a", "dependsOn": ["b"]}, {"id": "b", "dependsOn": ["a"]}), [])
    assert not out.ok and "Cycle detected" in out.failed["message"]


# --- batch and iter ----------------------------------------------------------------------------------------------


def test_batch(spark):
    out, client = run(spark, stages({"id": "a"}), ['```json\n{"x": 1}\n```'], initial={"seed": 2})
    assert out.outputs["a"] == {"x": 1} and "Initial Context (JSON):\n{\n  \"seed\": 2\n}" in client.prompts[0]
    for reply, extra, kind in (("nope", {}, "invalid_json"), (ModelError("HTTP 500"), {}, "model_call_failed"), ('{"x": 1}', {"constrain": {"type": "array", "items": {"type": "string"}}}, "constrain_mismatch"), (ModelError("x"), {"constrain": {"type": "boolean"}}, "constrain_mismatch"), ('{"x": 1}', {"validate": {"rules": [{"kind": "equals", "path": "x", "value": 2}]}}, "validator_mismatch"), ("{}", {"constrain": {"type": "string", "pattern": "("}}, "constrain_mismatch")):
        out, _ = run(spark, stages({"id": "a", **extra}), [reply])
        assert not out.ok and out.failed["kind"] == kind, reply
    out, _ = run(spark, stages({"id": "a", "validate": {"onFailure": "warn", "rules": [{"kind": "equals", "path": "x", "value": 2, "name": "r"}]}}), ['{"x": 1}'])
    assert out.ok and out.warnings == [{"stageIdentifier": "a", "stageIndex": 0, "kind": "validator_mismatch.equals", "message": "[r] Value is not equal to expected value"}]


def test_iter(spark):
    own = stages({"id": "all"}, {"id": "each", "mode": "iter", "constrain": {"type": "object", "shape": {"v": {"type": "number"}}}})
    out, client = run(spark, own, ["[1,2]", '{"v":1,"z":0}', '{"v":2}'])
    assert out.value("each") == [{"v": 1}, {"v": 2}] and "Current Iter Item (JSON):\n2" in client.prompts[2] and "Current Iter Item (JSON):\n1" not in client.prompts[2]
    out, _ = run(spark, stages({"id": "all"}, {"id": "each", "mode": "iter"}), ["[1,2]", '{"v":1}', "[2]"])
    assert out.failed["message"].startswith("Iter item 1 failed: Iter stage output must be a single JSON object")
    for own, say in ((stages({"id": "e", "mode": "iter"}), "Iter mode requires a previous stage output array"), (stages({"id": "all"}, {"id": "e", "mode": "iter"}), "output to be a JSON array")):
        out, _ = run(spark, own, ['{"a":1}'])
        assert out.failed["kind"] == "invalid_iter_input" and say in out.failed["message"]


def test_iter_retries(spark):
    retry = {"retry": {"enabled": True, "maxAttempts": 3}, "validate": {"rules": [{"kind": "min_length", "path": "t", "value": 3, "hint": "longer"}]}}
    own = stages({"id": "all"}, {"id": "e", "mode": "iter", **retry})
    out, client = run(spark, own, ["[1]", "no json", '{"t":"ab"}', '{"t":"abc"}'])
    assert out.value("e") == [{"t": "abc"}]
    assert "not valid JSON parseable" in client.prompts[2] and "Hints:\n- longer" in client.prompts[3] and "final retry" in client.prompts[3] and "no json" not in client.prompts[3]
    out, client = run(spark, own, ["[1]", ModelError("down")])
    assert not out.ok and len(client.prompts) == 2
    out, client = run(spark, stages({"id": "all"}, {"id": "e", "mode": "iter", "retry": {"enabled": True}}), ["[1]", "x", "y"])
    assert not out.ok and len(client.prompts) == 3


def test_iter_is_the_same_on_executors(spark):
    def stub(p):
        return "[3,1,2]" if "Current Iter" not in p else js.to_json({"v": p[p.index("(JSON):\n", p.index("Current Iter")) + 8 :].split("\n")[0]})

    own = stages({"id": "all"}, {"id": "e", "mode": "iter", "parallelism": 3})
    a = StageEngine(spark, StubClient(stub), parallelism=2).run(own).value("e")
    assert a == StageEngine(spark, StubClient(stub), distributed=False).run(own).value("e") == [{"v": "3"}, {"v": "1"}, {"v": "2"}]


# --- rewrites ----------------------------------------------------------------------------------------------------

T = {"kind": "conversation_rewrite", "conversationsPath": "c", "roleField": "from", "contentField": "value", "targetRoles": ["gpt"]}


def rewritten(record, replies, **more):
    client = ScriptedClient(list(replies))
    out = rewrite.rewrite_record(record, {"instructions": "do", "transform": T, **more}, lambda p: client.complete(p, ModelOptions()))
    return out, client


def talk(*turns):
    return {"id": 1, "c": [{"from": f, "value": v, "k": i} for i, (f, v) in enumerate(turns)]}


def test_rewrite_fold():
    out, client = rewritten(talk(("human", "q"), ("gpt", "a"), ("human", "r"), ("gpt", "b")), ["A", "```\nB\n```"])
    assert [t["value"] for t in out.record["c"]] == ["q", "A", "r", "B"] and out.record["c"][3]["k"] == 3 and not out.warnings
    assert '"value": "A"' in client.prompts[1] and "Current Target Turn" in client.prompts[1]
    _, client = rewritten(talk(("gpt", "a")), ["A"], transform=T | {"includeOriginalTargetTurn": False})
    assert "Current Target Turn" not in client.prompts[0]


def test_rewrite_retries_against_refs():
    rule = {"kind": "max_similarity_to_ref", "path": "value", "ref": "previous_same_role_turn.value", "threshold": 0.82}
    out, client = rewritten(talk(("gpt", "one"), ("human", "x"), ("gpt", "two")), ["Alpha beta gamma delta", "Alpha beta gamma delta", "Quite other words here"], validate={"rules": [rule]}, retry={"enabled": True, "maxAttempts": 2})
    assert [t["success"] for t in out.traces] == [True, False, True] and not out.warnings and out.record["c"][2]["value"] == "Quite other words here"
    assert out.traces[1]["failureKind"].startswith("validator_mismatch") and "similarity_score: 1.000" in client.prompts[2]


def test_rewrite_keeps_bad_turns():
    out, _ = rewritten(talk(("gpt", "a")), ["  "])
    assert out.record["c"][0]["value"] == "a" and [w["kind"] for w in out.warnings] == ["empty_output"]
    out, _ = rewritten(talk(("gpt", "a"), ("gpt", "b")), [ModelError("down"), "B"], retry={"enabled": True})
    assert [t["value"] for t in out.record["c"]] == ["a", "B"] and out.warnings[0]["kind"] == "model_call_failed"
    out, _ = rewritten({"c": [1, {"value": "x"}, {"from": "gpt"}, {"from": "human"}]}, [])
    assert [w["message"] for w in out.warnings] == ["Turn 0 is not an object", "Turn 1 is missing string role field 'from'", "Turn 2 is missing string content field 'value'"]
    assert [w["kind"] for w in rewritten({}, [])[0].warnings + rewritten({"c": 1}, [])[0].warnings] == ["missing_conversations_path", "invalid_conversations_value"]
    rule = {"kind": "contains", "path": "value", "value": "z", "name": "must"}
    out, _ = rewritten(talk(("gpt", "a")), ["b"], validate={"rules": [rule]})
    assert out.warnings[0]["kind"] == "validator_mismatch.contains" and out.warnings[0]["message"].startswith("[must] ") and out.warnings[0]["validatorName"] == "must"


def test_fold_column(spark):
    df = spark.createDataFrame([([("u", "q"), ("a", "x"), ("a", "y")],)], "t array<struct<r:string,c:string>>")
    out = df.select(rewrite.fold_turns(F.col("t"), "r", "c", ["a"], lambda c: F.lit("same"), lambda new, turn, done: rewrite.last_of_role(done, "r", turn["r"]).isNull() | (rewrite.last_of_role(done, "r", turn["r"])["c"] != new))).first()[0]
    assert [x.c for x in out] == ["q", "same", "y"]


def test_record_transform(spark):
    source = rec.records_of(spark, [talk(("gpt", "a")), talk(("gpt", "b"))])
    own = stages({"id": "r", "mode": "record_transform", "transform": T})
    out, _ = run(spark, own, ["A", "B"], records=source)
    assert [r["c"][0]["value"] for r in out.value("r")] == ["A", "B"]
    out, _ = run(spark, own, ["A", ModelError("HTTP 401: no")], records=source)
    assert not out.ok and out.failed["kind"] == "model_call_failed"
    out, _ = run(spark, own, ["A", ModelError("HTTP 500")], records=source)
    assert out.ok and out.warnings[0]["recordIndex"] == 1 and out.value("r")[1]["c"][0]["value"] == "b"
    out, _ = run(spark, [own[0] | {"validate": {"rules": [{"kind": "equals", "path": "id", "value": 2}]}}], ["A", "B"], records=source)
    assert out.failed["message"].startswith("Transformed record failed stage validators")
    for own, kind in ((own, "invalid_record_transform_input"), (stages({"id": "a"}, own[0]), "invalid_record_transform_input")):
        out, _ = run(spark, own, ['{"x":1}'])
        assert out.failed["kind"] == kind


# --- prompts, model, reporter ------------------------------------------------------------------------------------


def test_prompts():
    stage = {"instructions": " do ", "system": "sys", "rules": {"include": ["a", "b"], "exclude": ["c"]}, "history": "h", "examples": [{"input": "i", "output": ["o"]}]}
    p = prompts.stage_prompt(stage, None, [{"stageIdentifier": "s", "output": 1}], 5)
    heads = ["System:\nsys", "Instructions:\ndo", "Rules (include):\n- a\n- b", "Rules (exclude):\n- c", "History:\nh", 'Examples:\nExample 1:\nInput: "i"', "Initial Context (JSON):\nnull", "Prior Stage Outputs", "Current Iter Item (JSON):\n5", "Output Contract:"]
    assert [p.index(h) for h in heads] == sorted(p.index(h) for h in heads)
    text = prompts.retry_feedback(1, "empty_output", "r", [], 2, "text")
    assert "- Next Attempt: 2 of 2" in text and "final retry" in text and "usable rewritten turn" in text and text.endswith("extra wrapper text.")
    assert "of" not in prompts.retry_feedback(1, "invalid_json", "r").split("Next Attempt")[1].split("\n")[0]


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        type(self).seen.append((dict(self.headers), body))
        if body["model"] == "bad":
            self.send_error(401)
            return
        out = json.dumps({"choices": [{"message": {"content": " hi \n"}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *a):
        pass


def test_http_client():
    Handler.seen = []
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpClient(endpoint_of("openai", f"http://127.0.0.1:{server.server_port}/v1/"), "key", {"X-Title": "t"})
    assert client.complete("p", ModelOptions("m", reasoning_mode="think", think=True), "s") == "hi"
    headers, body = Handler.seen[0]
    assert headers["Authorization"] == "Bearer key" and body["messages"][0] == {"role": "system", "content": "s"} and body["think"] is True and body["max_tokens"] == 1000
    with pytest.raises(ModelError, match="HTTP 401"):
        client.complete("p", ModelOptions("bad"))
    server.shutdown()
    assert reasoning_fields(ModelOptions()) == {} and model_name(None, {}, {"OLLAMA_MODEL": "o"}) == "o"
    with pytest.raises(ValueError, match="Model is required"):
        model_name(None, {}, {})
    sse = 'data: {"choices":[{"delta":{"content":"He"}}]}\n\ndata: {"choices":[{"delta":{"content":"y"}}]}\ndata: [DONE]\n'
    assert "".join(stream_tokens(sse[i : i + 3] for i in range(0, len(sse), 3))) == "Hey"


def test_reporter():
    assert [reporter.duration(x) for x in (5, 1500, 61_000)] == ["5ms", "1.5s", "1m 1s"]
    assert reporter.progress_bar(1, 2, 4) == "[##--] 50% (1/2)" and reporter.display_width("a中é") == 4
    report = {"warnings": [{"stageIdentifier": "s", "kind": "k", "message": "m"}], "stageStatuses": {"s": "executed"}, "failedStage": None, "durationMs": 5}
    for mode, n in (("quiet", 0), ("summary", 1), ("warnings", 2), ("full", 3)):
        out = io.StringIO()
        reporter.Reporter(mode, out=out).finish(report)
        assert len(out.getvalue().splitlines()) == n


# --- runs --------------------------------------------------------------------------------------------------------


def shout(p):
    at = p.index("Current Target Turn:\n") + 21
    return js.parse_json(p[at : p.index("\n\nRewrite Task:")])["value"] + "!"


def flow(tmp_path, n=5, **more):
    (tmp_path / "in.jsonl").write_text("".join(js.to_json(talk(("human", "q"), ("gpt", f"a{i}"))) + "\n\n" for i in range(n)))
    doc = {"model": "m", "input": {"path": str(tmp_path / "in.jsonl"), **more}, "stages": [{"id": "r", "instructions": "x", "mode": "record_transform", "input": {"source": "pipeline_input"}, "transform": T}]}
    (tmp_path / "flow.yaml").write_text(json.dumps(doc))
    return str(tmp_path / "flow.yaml")


def lines(folder):
    return [json.loads(x) for f in sorted(p for p in folder.iterdir() if not p.name.startswith((".", "_"))) for x in f.read_text().splitlines()]


def test_eager_run(spark, tmp_path):
    path = flow(tmp_path)
    out = io.StringIO()
    assert runtime.main([path, "--output-dir", str(tmp_path / "o")], spark, StubClient(shout), out) == 0 and "Done in" in out.getvalue()
    assert [r["c"][1]["value"] for r in lines(tmp_path / "o/flow.jsonl")] == [f"a{i}!" for i in range(5)]
    report = json.loads((tmp_path / "o/flow.report.json").read_text())
    assert report["ok"] and report["stageStatuses"] == {"r": "executed"}
    assert runtime.main([str(tmp_path / "none.yaml"), "--output-dir", str(tmp_path / "o")], spark, StubClient(shout), out) == 2
    assert json.loads((tmp_path / "o/none.failure.json").read_text())["errorType"] == "FileNotFoundError"
    (tmp_path / "bad.yaml").write_text(json.dumps({"model": "m", "stages": [{"instructions": "x"}]}))
    assert runtime.main([str(tmp_path / "bad.yaml"), "--output-dir", str(tmp_path / "o"), "--context", "{}"], spark, StubClient(lambda p: "no"), out) == 3
    assert runtime.main([path, "--context", "{}", "--context-file", "x", "--output-dir", str(tmp_path)], spark, StubClient(shout), out) == 2


def test_stream_resume(spark, tmp_path):
    path, ck = flow(tmp_path, 5, offset=1, limit=3), str(tmp_path / "c.json")
    args = [path, "--output-dir", str(tmp_path / "o"), "--checkpoint-every", "2"]
    assert runtime.main(args, spark, StubClient(shout), io.StringIO()) == 0
    own = tmp_path / "o/flow.jsonl"
    assert sorted(p.name for p in own.iterdir()) == ["records-000000000000001.jsonl", "records-000000000000003.jsonl"]
    assert [r["c"][1]["value"] for r in lines(own)] == ["a1!", "a2!", "a3!"]
    ck = str(tmp_path / "o/flow.checkpoint.json")
    assert stream.load_checkpoint(ck, path)["nextRecordOffset"] == 4
    assert runtime.main([*args, "--resume", ck], spark, StubClient(shout), io.StringIO()) == 0
    report = json.loads((tmp_path / "o/flow.report.json").read_text())
    assert report["resumeFrom"] == 4 and report["processedCount"] == 0 and len(lines(own)) == 3
    with pytest.raises(stream.CheckpointError, match="does not match"):
        stream.load_checkpoint(ck, "other")
    for bad in ({}, {"pipelinePath": "p"}, {"pipelinePath": "p", "stageIdentifier": "s", "nextRecordOffset": -1}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(stream.CheckpointError):
            stream.load_checkpoint(str(tmp_path / "bad.json"))


def test_stream_stops_and_goes_on(spark, tmp_path):
    path = flow(tmp_path, 4, readMode="stream")

    def once(p):
        if "a2" in p:
            raise ModelError("HTTP 500")
        return shout(p)

    args = [path, "--output-dir", str(tmp_path / "o"), "--checkpoint-every", "2"]
    assert runtime.main(args, spark, StubClient(once), io.StringIO()) == 3
    ck = str(tmp_path / "o/flow.checkpoint.json")
    assert stream.load_checkpoint(ck)["nextRecordOffset"] == 2
    assert runtime.main([*args, "--resume", ck], spark, StubClient(shout), io.StringIO()) == 0
    assert [r["c"][1]["value"] for r in lines(tmp_path / "o/flow.jsonl")] == [f"a{i}!" for i in range(4)]
    assert not stream.can_stream({"stages": [{"mode": "batch"}], "input": {"readMode": "stream"}})


def delegating(tmp_path, child, **block):
    doc = {"model": "m", "stages": [{"id": "seed", "instructions": "x"}, {"id": "d", "instructions": "x", "mode": "workflow_delegate", "delegate": {"workflowPath": "child.yaml", "inputFromPath": "outputsByStage.seed.items", **block}}]}
    (tmp_path / "parent.yaml").write_text(json.dumps(doc))
    (tmp_path / "child.yaml").write_text(json.dumps(child))
    return str(tmp_path / "parent.yaml")


def test_delegate(spark, tmp_path):
    child = {"model": "m", "stages": [{"id": "one", "instructions": "y", "validate": {"onFailure": "warn", "rules": [{"kind": "equals", "path": "v", "value": 0}]}}, {"id": "two", "instructions": "z"}]}
    go = lambda path, *replies: runtime.WorkflowRunner(spark, ScriptedClient(list(replies)), False).run(path, artifacts=False)[0]
    path = delegating(tmp_path, child, outputSelectPath="w")
    out = go(path, '{"items":[1]}', '{"v":1}', '{"w":{"deep":1}}')
    assert out.ok and out.outputs["d"] == {"deep": 1} and out.warnings[0]["stageIdentifier"] == "d::one"
    out = go(delegating(tmp_path, child, outputFrom="stage_key", outputStageKey="one"), '{"items":[1]}', '{"v":1}', '{"w":1}')
    assert out.outputs["d"] == {"v": 1}
    assert not go(path, '{"x":1}').ok and go(path, '{"items":[1]}', "bad").failed["kind"] == "delegated_workflow_failed"
    out = go(delegating(tmp_path, child, onFailure="warn"), '{"items":[1]}', "bad")
    assert out.ok and out.outputs["d"] is None and out.warnings[0]["kind"] == "delegated_workflow_failed"
    out = go(delegating(tmp_path, child, inputAs="pipeline_input"), '{"items":{}}')
    assert "requires an array" in out.failed["message"]
    (tmp_path / "in.jsonl").write_text("")
    rows = {"model": "m", "input": {"path": str(tmp_path / "in.jsonl")}, "stages": [{"id": "r", "instructions": "x", "mode": "record_transform", "input": {"source": "pipeline_input"}, "transform": T}]}
    out = go(delegating(tmp_path, rows, inputAs="pipeline_input"), js.to_json({"items": [talk(("gpt", "a"))]}), "A")
    assert out.outputs["d"][0]["c"][0]["value"] == "A"
    looped = {"model": "m", "stages": [{"id": "seed", "instructions": "x"}, {"id": "d", "instructions": "x", "mode": "workflow_delegate", "delegate": {"workflowPath": "parent.yaml", "inputFromPath": "outputsByStage.seed", "onFailure": "warn"}}]}
    with pytest.raises(runtime.DelegationError, match="cycle"):
        go(delegating(tmp_path, looped), '{"items":[1]}', "1")
    assert runtime.RunOptions(model="m", parallelism=2, output_dir="x", resume=True).inherited("all") == runtime.RunOptions(model="m", parallelism=2)
    assert runtime.RunOptions(model="m", parallelism=2).inherited("completion") == runtime.RunOptions(model="m") and runtime.RunOptions(model="m").inherited("none") == runtime.RunOptions()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


def test_service_configuration():
    from weftwork.plans.model import api_key_of, complete_once, is_auth_failure

    assert endpoint_of("ollama") == "http://localhost:11434/v1/chat/completions" and endpoint_of("openai", "http://h/v1/") == endpoint_of("openai", "http://h") == "http://h/v1/chat/completions"
    assert api_key_of(" k ", "V", {}) == "k" and api_key_of(None, "V", {"V": " x "}) == "x" and api_key_of(None, None, {"OPENROUTER_API_KEY": "r"}) == "r" and api_key_of(None, None, {}) is None
    for call in (lambda: api_key_of(None, "V", {"V": " "}), lambda: endpoint_of("other")):
        with pytest.raises(ValueError):
            call()
    assert is_auth_failure("HTTP 403: x") and not is_auth_failure("took 401 ms")
    assert reasoning_fields(ModelOptions(reasoning_mode="openai", think=True)) == {"reasoning": {"enabled": True}}
    assert complete_once(StubClient(lambda p: f" {p} "), "p", temperature=0.1) == "p"
    assert rewrite.unfenced("```text\nA\nB\n```") == "A\nB" and rewrite.unfenced("```A```") in ("", "A") and rewrite.unfenced("x ```a``` ") == "x ```a```"


def test_deep_delegation(spark, tmp_path):
    def link(i):
        return {"model": "m", "stages": [{"id": "s", "instructions": "x"}, {"id": "d", "instructions": "x", "mode": "workflow_delegate", "delegate": {"workflowPath": f"w{i + 1}.yaml", "inputFromPath": "outputsByStage.s"}}]}

    for n, fine in ((3, True), (4, False)):
        for i in range(n):
            (tmp_path / f"w{i}.yaml").write_text(json.dumps(link(i)))
        (tmp_path / f"w{n}.yaml").write_text(json.dumps({"model": "m", "stages": [{"id": "end", "instructions": "x"}]}))
        runner = runtime.WorkflowRunner(spark, ScriptedClient(["1"] * 9), False)
        if fine:
            assert runner.run(str(tmp_path / "w0.yaml"), artifacts=False)[0].outputs["d"] == 1
        else:
            with pytest.raises(runtime.DelegationError, match="max depth 3"):
                runner.run(str(tmp_path / "w0.yaml"), artifacts=False)


def test_report_path_and_live_console(spark, tmp_path):
    path = tmp_path / "w.yaml"
    path.write_text("name: w\nstages:\n  - id: a\n    instructions: x\n    validate:\n      onFailure: warn\n      rules:\n        - {kind: contains, path: b, value: z}\n")
    out, report = io.StringIO(), tmp_path / "deep" / "r.json"
    args = [str(path), "--out", str(report), "--output-dir", str(tmp_path / "o"), "--console", "full"]
    assert runtime.main(args, spark, StubClient(lambda p: '{"b": "y"}'), out) == 0
    told = json.loads(report.read_text())
    assert told["ok"] and told["traces"][0]["subtraces"] and (tmp_path / "o" / "w.jsonl").exists() and not (tmp_path / "deep" / "w.jsonl").exists()
    said = out.getvalue()
    assert "100% (1/1)" in said and said.count("Warning [a]") == len(told["warnings"]) == 1


def test_top_level_errors_and_endpoint(monkeypatch):
    assert runtime.classify(ValueError("Pipeline requires API key env 'K', but it is not set"))[0] == "AuthenticationError"
    assert runtime.classify(RuntimeError("HTTP 401: no"))[0] == "AuthenticationError" and runtime.classify(FileNotFoundError("x"))[0] == "FileNotFoundError"
    monkeypatch.setenv("WEFTWORK_ENDPOINT", "http://h:1")
    assert runtime.client_of({}, runtime.RunOptions()).endpoint.startswith("http://h:1/") and runtime.client_of({"endpoint": "http://d"}, runtime.RunOptions()).endpoint.startswith("http://d/")


def test_gates_look_only_at_what_they_name(spark, monkeypatch):
    from weftwork.plans import engine

    asked = []
    real = engine.Result.value
    monkeypatch.setattr(engine.Result, "value", lambda self, k: (asked.append(k), real(self, k))[1])
    stages = [{"id": "one", "instructions": "x"}, {"id": "two", "instructions": "x"}, {"id": "three", "instructions": "x", "when": {"path": "outputsByStage.two.go", "equals": True}}]
    got = engine.StageEngine(spark, StubClient(lambda p: '{"go": true}')).run(stages)
    assert got.statuses["three"] == "executed" and asked == ["two"]


def test_many_traces_stay_in_their_table(spark, monkeypatch):
    from weftwork.plans import engine
    from weftwork.sources.records import records_of

    monkeypatch.setattr(engine, "TRACED_ITEMS", 2)
    stage = {"id": "r", "mode": "record_transform", "instructions": "x", "transform": {"kind": "conversation_rewrite", "conversationsPath": "c", "roleField": "from", "contentField": "value", "targetRoles": ["gpt"]}}
    records = records_of(spark, [{"c": [{"from": "gpt", "value": f"v{i}"}]} for i in range(3)])
    got = engine.StageEngine(spark, StubClient(lambda p: '{"value": "new"}')).run([stage], records=records)
    trace = got.traces[0]
    assert trace["items"] == 3 and spark.read.parquet(trace["subtracesTable"]).count() == 3


def test_stream_source_reads_its_own_bytes(tmp_path):
    from weftwork.streaming import record_stream as S

    path = tmp_path / "x.jsonl"
    path.write_bytes("".join(f'{{"n": "é{i}"}}\n' + "\n" * (i % 3) for i in range(1700)).encode())
    whole = [(n, t) for n, t, _, _ in S._records(str(path))]
    reader = S._Reader({"path": str(path), "start": "5", "limit": "1500"})
    at, seen, sizes = reader.initialOffset(), [], []
    while (end := reader.latestOffset()) != at:
        parts = reader.partitions(at, end)
        sizes.append(len(parts))
        seen += [x for p in parts for x in reader.read(p)]
        again = S._Reader({"path": str(path), "start": "5", "limit": "1500"}).partitions(at, end)  # after a restart
        assert len(again) == 1 and list(reader.read(again[0])) == seen[-(end["record"] - at["record"]) :]
        at = end
    assert seen == whole[5:1505] and sizes == [4, 2]
