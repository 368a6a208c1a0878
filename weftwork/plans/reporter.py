"""Console output of a run: quiet, summary, warnings or full, and a text progress bar."""

from __future__ import annotations

import time
import unicodedata
from typing import Any, TextIO


def duration(ms: float) -> str:
    if ms < 1000:
        return f"{round(ms)}ms"
    s = ms / 1000
    return f"{s:.1f}s" if s < 60 else f"{int(s // 60)}m {int(s % 60)}s"


def display_width(text: str) -> int:
    """Terminal columns: wide characters are two, combining marks none."""
    return sum(0 if unicodedata.combining(c) or c in "‍️" else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def progress_bar(done: int, total: int, width: int = 24, full: str = "#", empty: str = "-") -> str:
    share = min(1.0, max(0.0, done / total)) if total else 0.0
    n = round(width * share)
    return f"[{full * n}{empty * (width - n)}] {100 * share:.0f}% ({done}/{total})"


class Reporter:
    def __init__(self, mode: str = "summary", progress: bool = True, out: TextIO | None = None, every: float = 0.1) -> None:
        self.mode, self.show_progress, self.out, self.every, self._last = mode, progress, out, every, 0.0
        self._told: list[dict] = []

    def _say(self, text: str) -> None:
        if self.out:
            print(text, file=self.out)

    def progress(self, done: int, total: int) -> None:
        """At most one line each ``every`` seconds, and the last."""
        now = time.monotonic()
        if self.show_progress and self.mode != "quiet" and (now - self._last >= self.every or done == total):
            self._last = now
            self._say(progress_bar(done, total))

    def warning(self, w: dict) -> None:
        """Said when it comes up, or at the end; once."""
        if w in self._told:
            return
        self._told.append(w)
        if self.mode in ("warnings", "full"):
            at = "".join(f" {k} {w[f]}" for k, f in (("record", "recordIndex"), ("turn", "turnIndex")) if f in w)
            self._say(f"Warning [{w.get('stageIdentifier')}]{at}: {w['kind']}: {w['message']}")

    def error(self, kind: str, hint: str, error: BaseException) -> None:
        self._say(f"{kind}: {error}\nHint: {hint}")

    def finish(self, report: dict[str, Any]) -> None:
        for w in report["warnings"]:
            self.warning(w)
        if self.mode == "quiet":
            return
        if self.mode == "full":
            for k, s in report["stageStatuses"].items():
                self._say(f"{k}: {s}")
        if report["failedStage"]:
            self._say(f"Failed at {report['failedStage']['stageIdentifier']}: {report['failedStage']['message']}")
        self._say(f"Done in {duration(report['durationMs'])}, {len(report['warnings'])} warnings")
