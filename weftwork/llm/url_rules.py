"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks.

A rule is a host and a path.  It fits its host and all subdomains, if the url's path starts with the rule's.  The trie's
first edges are the host's labels from the right, the next are whole path segments; what follows the last slash of a
rule's path is compared as a prefix.  Of all rules that fit, the one with the longest text wins (then the one with the
longer host), whether it allows or blocks; without any the default holds.

The trie is broadcast, so the number of rules is checked against MOST_RULES first.

Defined results: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the
path goes on from there to ``?``, ``#`` or the end; a null url, or one without ``://``, has empty host and path and
gets the default; repeated rows get equal results; rules of equal host and path that disagree: the one given first holds; very
long urls are read whole; an empty table gives an empty table; columns other than the id and url are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from weftwork.llm.common import quoted

MOST_RULES = 500_000
ALLOW, BLOCK = "allow", "block"
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    segments: dict[str, _Node] = field(default_factory=dict)
    ends: list[tuple[str, str, str]] = field(default_factory=list)  # prefix of the next segment, rule, verdict
    any_path: tuple[str, str] | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        """rules: (verdict, host, path)."""
        self.root = _Node()
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} url rules: too many to broadcast")
            host = host.translate(_LOWER)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.labels.setdefault(label, _Node())
            if not path:
                node.any_path = node.any_path or (host, verdict)
                continue
            if path[0] != "/":
                raise ValueError(f"a rule's path starts with a slash: {path!r}")
            *whole, rest = path[1:].split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            node.ends.append((rest, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best: tuple[int, int, str, str] | None = None
        segments = path[1:].split("/") if path else []

        def note(rule: str, verdict: str, host_size: int) -> None:
            nonlocal best
            if best is None or (len(rule), host_size) > best[:2]:
                best = (len(rule), host_size, rule, verdict)

        node, size = self.root, 0
        labels = host.split(".")[::-1] if host else []
        for k in range(len(labels) + 1):
            if node.any_path:
                note(*node.any_path, size)
            at: _Node | None = node
            for segment in segments:
                for prefix, rule, verdict in at.ends:
                    if segment.startswith(prefix):
                        note(rule, verdict, size)
                at = at.segments.get(segment)
                if at is None:
                    break
            if k == len(labels) or labels[k] not in node.labels:
                break
            node, size = node.labels[labels[k]], size + len(labels[k]) + 1
        return best and best[2:]


def split_url(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0]


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", page_id: str = "page_id", default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict for each row."""
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trie.value
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [tree.match(*p) or (None, default) for p in parts]
            cols = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(quoted(page_id).cast("long").alias("page_id"), quoted(url).alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
