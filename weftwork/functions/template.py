"""Text templates: ``{name}`` from arguments in their order, ``${...}`` all positionals, ``$1`` one of them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class TextTemplate:
    def __init__(self, template: str) -> None:
        template = template[1:] if template.startswith("\n") else template
        self.template = template[:-1] if template.endswith("\n") else template

    def __call__(self, args: Mapping[str, Any] | None = None, *positional: Any) -> str:
        return self.render(args, positional)

    def render(self, args: Mapping[str, Any] | None = None, positional: tuple = ()) -> str:
        args = dict(args or {})
        values = {k: v({n: x for n, x in args.items() if n != k}, *positional) if callable(v) else v for k, v in args.items()}
        out = self.template
        for k, v in values.items():
            out = out.replace("{" + k + "}", str(v))
        out = out.replace("${...}", " ".join(map(str, positional)))
        return re.sub(r"\$(\d+)", lambda m: str(positional[int(m[1]) - 1]) if 0 < int(m[1]) <= len(positional) else m[0], out)

    def column(self, args: Mapping[str, Column]) -> Column:
        """The template over columns: one chain of built-in replacements."""
        out = F.lit(self.template)
        for k, v in args.items():
            out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
        return out

    def clone(self) -> TextTemplate:
        return TextTemplate(self.template)

    def indent(self, level: int) -> TextTemplate:
        return TextTemplate("\n".join(" " * level + x if x.strip() else x for x in self.template.split("\n")))

    def trim_lines(self) -> TextTemplate:
        return TextTemplate("\n".join(x.rstrip() for x in self.template.split("\n")))
