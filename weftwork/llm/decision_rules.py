"""Quality rules: a decision list learned by sequential covering.

Statistics of labelled documents are split into a growing and a pruning part.  A rule grows by the threshold condition
with the highest information gain until it covers no kept document of the growing part, then loses trailing conditions
as long as that raises its worth on the pruning part; rules that are not precise enough there end the list.  What a
rule covers is taken out before the next one grows.  The list is emitted as an ordered conditional expression over
the statistics, so it is read, stored and run as any other Spark column.

Defined results: null text has no words; a document without words fails the base rules; where a label is missing the
list is empty and keeps all; repeated rows get equal results; a value that ties with a threshold is on its lower side; very
long texts are counted whole; an empty table gives an empty one; columns other than the id and text are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import quoted

#: At most so many labelled rows are learned from.
TRAIN_ROWS = 20_000
LEAST_WORDS = 50
MOST_REPEATED = 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_echoes")

#: What rules may test, as Spark SQL over the statistics.
TESTS = {
    "symbols per word": "n_symbols / greatest(n_words, 1)",
    "characters per word": "word_chars / greatest(n_words, 1)",
    "share of words in repeated windows": "n_repeat_words / greatest(n_words, 1)",
    "share of repeated lines": "n_dup_lines / greatest(n_lines, 1)",
    "share of upper case": "n_upper / greatest(word_chars, 1)",
    "share of words like the one before": "n_echoes / greatest(n_words, 1)",
    "words per line": "n_words / greatest(n_lines, 1)",
}


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The numbers named in STATISTICS."""
    raw = text or b""
    words = raw.split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
        seen.add(line)
    chars = len(raw) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    if not raw.isascii():  # continuation bytes are not characters
        chars -= int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    upper = int(np.count_nonzero((np.frombuffer(raw, np.uint8) - np.uint8(65)) < 26))
    return n, chars, symbols, dup, repeated, lines, upper, sum(map(bytes.__eq__, words, words[1:]))


def with_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[] for _ in STATISTICS]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS)
    return docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).mapInArrow(run, schema)


@dataclass
class Condition:
    test: str
    above: bool
    limit: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.test] > self.limit if self.above else x[self.test] <= self.limit

    def column(self) -> Column:
        c = F.expr(TESTS[self.test])
        return c > F.lit(self.limit) if self.above else c <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.test} {'>' if self.above else '<='} {self.limit:g}"


Rule = list[Condition]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: Rule = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None, None)
        for test, v in x.items():
            values = np.unique(np.quantile(v[inside], np.linspace(0, 1, 65), method="nearest"))
            for limit in (values[:-1] + values[1:]) / 2:
                for above in (True, False):
                    c = Condition(test, above, float(limit))
                    now = inside & c.holds(x)
                    q = (now & bad).sum()
                    if q:
                        gain = q * (np.log2(q / now.sum()) - before)
                        if gain > best[0]:
                            best = (gain, c, now)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    c = covers(rule, x)
    p, n = (c & bad).sum(), (c & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precise: float = 0.75, seed: int = 5) -> list[Rule]:
    """The rules that reject, in order."""
    rules: list[Rule] = []
    if not bad.any() or bad.all():
        return rules
    left = np.random.default_rng(seed).permutation(len(bad))
    while len(rules) < most_rules and bad[left].any():
        cut = 2 * len(left) // 3
        grow, prune = left[:cut], left[cut:]
        gx, px = ({k: v[i] for k, v in x.items()} for i in (grow, prune))
        rule = _grow(gx, bad[grow], most_conditions)
        while len(rule) > 1 and _worth(rule[:-1], px, bad[prune]) >= _worth(rule, px, bad[prune]):
            rule = rule[:-1]
        hit = covers(rule, px)
        if not rule or not hit.any() or bad[prune][hit].mean() < precise:
            break
        rules.append(rule)
        left = left[~covers(rule, {k: v[left] for k, v in x.items()})]
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled rows (those whose ids hash lowest); the sample is bounded, so it is broadcast."""
    sample = labels.where(quoted(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", quoted(label).cast("int").alias("y")).distinct()
    sample = F.broadcast(sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows))
    own = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    stats = with_statistics(own.join(sample, "doc_id", "left_semi")).join(sample, "doc_id")
    found = stats.where(f"n_words >= {LEAST_WORDS}").select("doc_id", "y", *[F.expr(e).alias(f"x{i}") for i, e in enumerate(TESTS.values())])
    found = found.orderBy(*found.columns).limit(4 * rows).collect()
    table = np.array([r[1:] for r in found], float).reshape(-1, 1 + len(TESTS))
    return learn({t: table[:, i + 1] for i, t in enumerate(TESTS)}, table[:, 0] == 0)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false at the first rule that holds, else true."""
    out = F
    for rule in rules:
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = out.when(both, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the statistics, base_failed and kept."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = with_statistics(docs, text, doc_id).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
