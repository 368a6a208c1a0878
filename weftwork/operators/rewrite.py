"""Conversation rewrite: each target turn of a record is rewritten, left to right, under validation with retries.

Later turns see the accepted rewrites of earlier ones, so one record is a sequential fold; records are independent and
run in Arrow batches.  Where the rewrite is itself an expression, ``fold_turns`` is the same fold in Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions import js
from weftwork.operators import rules as R
from weftwork.plans import prompts

_WHOLE_FENCE = regex.compile(r"\A```[A-Za-z0-9_-]*\s*([\s\S]*?)\s*```\Z")


@dataclass
class Rewritten:
    record: Any
    warnings: list[dict] = field(default_factory=list)
    traces: list[dict] = field(default_factory=list)


def unfenced(text: str) -> str:
    text = js.trim(text)
    m = _WHOLE_FENCE.match(text)
    return js.trim(m[1]) if m else text


def attempts_of(stage: dict) -> int:
    retry = stage.get("retry") or {}
    return retry.get("maxAttempts", 2) if retry.get("enabled") else 1


def said(issues: list[dict]) -> str:
    return "; ".join((f"[{n}] " if (n := js.trim(i.get("ruleName") or "")) else "") + i["message"] for i in issues)


def refs_of(turns: list[Any], done: list[Any], at: int, role: str, content: str) -> dict[str, Any]:
    """What rules may refer to: the turn as it was, the turn before it and the last one of its role, both rewritten."""
    own = turns[at]
    same = next((t for t in reversed(done) if isinstance(t, dict) and t.get(role) == own.get(role)), js.MISSING)
    return {"original_target_turn": own, "original_target_content": own.get(content), "previous_turn": done[-1] if done else js.MISSING, "previous_same_role_turn": same}


def rewrite_record(record: Any, stage: dict, complete: Callable[[str], str]) -> Rewritten:
    """complete: the model call; its exceptions keep the turn and are never retried."""
    t, out = stage["transform"], Rewritten(record)
    role, content, path = t["roleField"], t["contentField"], t["conversationsPath"]
    try:
        turns = js.get_path(record, path)
    except js.PathError as e:
        out.warnings.append({"kind": "missing_conversations_path", "message": str(e)})
        return out
    if not isinstance(turns, list):
        out.warnings.append({"kind": "invalid_conversations_value", "message": f"Path '{path}' must resolve to an array of turns"})
        return out
    done: list[Any] = []
    for i, turn in enumerate(turns):
        bad = None
        if not isinstance(turn, dict):
            bad = f"Turn {i} is not an object"
        elif not isinstance(turn.get(role), str):
            bad = f"Turn {i} is missing string role field '{role}'"
        elif turn[role] in t["targetRoles"] and not isinstance(turn.get(content), str):
            bad = f"Turn {i} is missing string content field '{content}'"
        if bad:
            out.warnings.append({"kind": "invalid_turn_shape", "message": bad, "turnIndex": i})
        if bad or turn[role] not in t["targetRoles"]:
            done.append(turn)
            continue
        done.append(_turn(turns, done, i, stage, complete, out))
    out.record = js.set_path(record, path, done, create=False)
    return out


def _turn(turns: list[Any], done: list[Any], i: int, stage: dict, complete: Callable[[str], str], out: Rewritten) -> Any:
    t, most, feedback = stage["transform"], attempts_of(stage), ""
    turn, content = turns[i], t["contentField"]
    refs = refs_of(turns, done, i, t["roleField"], content)
    for attempt in range(1, most + 1):
        prompt = prompts.rewrite_prompt(stage, done, turn if t.get("includeOriginalTargetTurn", True) else js.MISSING, feedback)
        trace = {"turnIndex": i, "attempt": attempt, "maxAttempts": most, "promptSnapshot": prompt, "rawModelOutput": None, "validationIssues": [], "failureKind": None, "success": False}
        out.traces.append(trace)
        warning = {"turnIndex": i, "attempt": attempt, "maxAttempts": most}
        try:
            raw = complete(prompt)
        except Exception as e:  # noqa: BLE001 - whatever the client raises is the turn's failure
            trace["failureKind"] = "model_call_failed"
            out.warnings.append(warning | {"kind": "model_call_failed", "message": str(e)})
            return turn
        trace["rawModelOutput"], new = raw, unfenced(raw)
        if not new:
            kind, reason, found = "empty_output", f"Turn {i} rewrite output was empty", []
        else:
            found = R.validate(turn | {content: new, "content": new}, (stage.get("validate") or {}).get("rules"), refs, skip_inapplicable=True)
            if not found:
                trace["success"] = True
                return turn | {content: new}
            kind, reason = f"validator_mismatch.{found[0]['kind']}", said(found)
        trace |= {"failureKind": kind, "validationIssues": found}
        feedback = prompts.retry_feedback(attempt, kind.split(".")[0], reason, found, most, "text")
    name = js.trim(found[0].get("ruleName") or "") if found else ""
    out.warnings.append(warning | {"kind": kind, "message": reason} | ({"validatorName": name} if name else {}))
    return turn


def fold_turns(turns: Column, role: str, content: str, targets: list[str], rewrite: Callable[[Column], Column], accept: Callable[[Column, Column, Column], Column]) -> Column:
    """The fold as an expression over an array of (role, content) structs.  accept(new text, turn, done turns): whether
    the rewrite stays; else the turn is kept as it was."""

    def step(done: Column, turn: Column) -> Column:
        new = rewrite(turn[content])
        ok = turn[role].isin(*targets) & F.coalesce(accept(new, turn, done), F.lit(False))
        return F.array_append(done, F.struct(turn[role].alias(role), F.when(ok, new).otherwise(turn[content]).alias(content)))

    kind = f"array<struct<{role}:string,{content}:string>>"
    return F.aggregate(turns, F.array().cast(kind), step)


def last_of_role(done: Column, role: str, wanted: Column) -> Column:
    """The latest done turn of a role, NULL if there is none."""
    same = F.filter(done, lambda t: t[role] == wanted)
    return F.when(F.size(same) > 0, F.element_at(same, -1))
