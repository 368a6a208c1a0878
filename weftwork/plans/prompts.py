"""Prompt text for stages, rewrites and retries.  The wording is fixed; sections are joined by a blank line."""

from __future__ import annotations

from typing import Any

from weftwork.functions import js

# Fixed texts.
OUTPUT_CONTRACT = """Output Contract:
- Respond with JSON only.
- Do not include markdown, code fences, prose, or any non-JSON text.
- Ensure the response is valid JSON that can be parsed by JSON.parse."""
REWRITE_RULES = """Rewrite Output Rules:
- Return only the full rewritten target turn text.
- Do not return JSON.
- Do not wrap the response in markdown or code fences.
- Do not include any text before or after the rewritten turn.
- Preserve the target turn content while applying the requested rewrite."""
WHAT_WENT_WRONG = {
    "invalid_json": "- Previous response was not valid JSON parseable by JSON.parse.",
    "invalid_content_output": "- The response must be exactly one JSON object containing string field 'content'.",
    "empty_output": "- Previous response was empty or did not contain a usable rewritten turn.",
}
FINAL_RETRY = "- This is the final retry. Prioritize satisfying the correction requirements exactly."
HOW_TO_FIX = {
    "json": "- Return only the required JSON shape.\n- Do not include explanations, markdown, or extra text.",
    "text": "- Return only the rewritten target turn text.\n- Do not include explanations, markdown, JSON, or extra wrapper text.",
}


def _section(title: str, body: str) -> list[str]:
    return [f"{title}:\n{body}"] if body else []


def _bullets(lines: list[str] | None) -> str:
    return "\n".join(f"- {x}" for x in lines or ())


def _pretty(value: Any) -> str:
    return js.to_json(value, 2)


def stage_prompt(stage: dict, initial: Any = js.MISSING, prior: list[dict] | None = None, item: Any = js.MISSING) -> str:
    rules = stage.get("rules") or {}
    examples = [f"Example {i}:\nInput: {_pretty(e['input'])}\nOutput: {_pretty(e['output'])}" for i, e in enumerate(stage.get("examples") or (), 1)]
    parts = [
        *_section("System", js.trim(stage.get("system") or "")),
        f"Instructions:\n{js.trim(stage['instructions'])}",
        *_section("Rules (include)", _bullets(rules.get("include"))),
        *_section("Rules (exclude)", _bullets(rules.get("exclude"))),
        *_section("History", js.trim(stage.get("history") or "")),
        *_section("Examples", "\n\n".join(examples)),
        *([] if initial is js.MISSING else _section("Initial Context (JSON)", _pretty(initial))),
        *(_section("Prior Stage Outputs For Chaining (JSON)", _pretty(prior)) if prior else []),
        *([] if item is js.MISSING else _section("Current Iter Item (JSON)", _pretty(item))),
        OUTPUT_CONTRACT,
    ]
    return "\n\n".join(parts)


def rewrite_prompt(stage: dict, before: list[Any], target: Any = js.MISSING, feedback: str = "") -> str:
    parts = [
        *_section("System", js.trim(stage.get("system") or "")),
        f"Prior Conversation Turns:\n{_pretty(before)}",
        *([] if target is js.MISSING else [f"Current Target Turn:\n{_pretty(target)}"]),
        f"Rewrite Task:\n{js.trim(stage['instructions'])}",
        *([js.trim(feedback)] if js.trim(feedback) else []),
        REWRITE_RULES,
    ]
    return "\n\n".join(parts)


def _issue_lines(issue: dict) -> list[str]:
    name = js.trim(issue.get("ruleName") or "")
    out = [f"- [{name}] {issue['message']}" if name else f"- {issue['message']}"]
    if "similarityScore" in issue:
        out += [f"  {label}: {js.fixed3(issue[k])}" for label, k in (("similarity_score", "similarityScore"), ("threshold", "similarityThreshold"), ("distance", "similarityDistance"))]
        out.append(f"  status: {issue['similarityStatus']}")
        out += [f"  similarity_mode: {issue['similarityMode']}"] if issue.get("similarityMode") else []
    return out


def retry_feedback(attempt: int, kind: str, reason: str, issues: list[dict] | None = None, most: int | None = None, form: str = "json") -> str:
    """What the next attempt is told about the last."""
    following = attempt + 1 if most is None else min(attempt + 1, most)
    status = f"- Next Attempt: {following}" + ("" if most is None else f" of {most}")
    wrong = [WHAT_WENT_WRONG[kind]] if kind in WHAT_WENT_WRONG else [x for i in issues or () for x in _issue_lines(i)]
    hints = list(dict.fromkeys(js.trim(i["hint"]) for i in issues or () if js.trim(i.get("hint") or "")))
    parts = [
        f"Previous Attempt Failed:\n- Attempt: {attempt}\n- Failure Kind: {kind}\n- Reason: {reason}",
        "Retry Status:\n" + status + (f"\n{FINAL_RETRY}" if most is not None and following >= most else ""),
        *_section("Validation Issues", "\n".join(wrong)),
        *_section("Hints", _bullets(hints)),
        f"Fix Instructions:\n- Correct the issue described above.\n- Keep all original task requirements.\n{HOW_TO_FIX[form]}",
    ]
    return "\n\n".join(parts)
