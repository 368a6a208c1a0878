"""The stage graph: keys, dependencies, a stable topological order, and gates."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from typing import Any

from weftwork.functions import js


class StageGraphError(ValueError):
    pass


@dataclass
class Node:
    key: str
    index: int
    stage: dict
    depends_on: list[str]


def stage_key(stage: dict, index: int) -> str:
    return stage.get("id") or stage.get("name") or f"stage-{index + 1}"


def resolve(stages: list[dict]) -> list[Node]:
    """Nodes in execution order: dependencies first, then by declaration.  A stage without ``dependsOn`` follows the
    one declared before it."""
    keys = [stage_key(s, i) for i, s in enumerate(stages)]
    nodes = {}
    for i, (k, s) in enumerate(zip(keys, stages, strict=True)):
        needs = list(dict.fromkeys(s.get("dependsOn") or (keys[i - 1 : i] if i else [])))
        for d in needs:
            if d == k:
                raise StageGraphError(f"Stage '{k}' cannot depend on itself")
            if d not in keys:
                raise StageGraphError(f"Stage '{k}' depends on unknown stage '{d}'")
        nodes[k] = Node(k, i, s, needs)
    waiting = {k: len(n.depends_on) for k, n in nodes.items()}
    ready = [n.index for k, n in nodes.items() if not waiting[k]]
    out = []
    while ready:
        node = nodes[keys[heapq.heappop(ready)]]
        out.append(node)
        for n in nodes.values():
            if node.key in n.depends_on:
                waiting[n.key] -= 1
                if not waiting[n.key]:
                    heapq.heappush(ready, n.index)
    if len(out) < len(nodes):
        left = [k for k in keys if nodes[k] not in out]
        raise StageGraphError(f"Cycle detected in stage dependency graph involving: {', '.join(left)}")
    return out


def gate(stage: dict, context: Any) -> bool:
    """Whether a stage's ``when`` lets it run; a missing path does not."""
    when = stage.get("when")
    if not when:
        return True
    try:
        value = js.get_path(context, when["path"])
    except js.PathError:
        return False
    return js.same(value, when["equals"]) if "equals" in when else not js.same(value, when["notEquals"])


def statuses(nodes: list[Node], runs: Any) -> dict[str, str]:
    """executed, skipped or blocked for each stage; runs(node): its gate, asked only if nothing blocks it."""
    out: dict[str, str] = {}
    for n in nodes:
        blocked = any(out[d] in ("blocked", "skipped") for d in n.depends_on)
        out[n.key] = "blocked" if blocked else "executed" if runs(n) else "skipped"
    return out
