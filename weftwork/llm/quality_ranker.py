"""Quality classifier by Bradley-Terry pairwise ranking.

From labelled rows come preference pairs (label 1 before label 0): all of them, from every labelled row.  A weight vector is
learned by logistic loss on the difference of the pair's features, so that only the order of documents is learned; then a
threshold is put at the quantile of the labelled scores that the share of label 0 names.  The reported score is a logistic
curve through that threshold, of a slope fitted on the same rows: 0.3 at the threshold, higher where label 1 is likelier.

Nothing is sampled.  The features of all labelled rows are written once; each pass over them yields sums of bounded size, and
passes add up.  The loss over all pairs needs no list of pairs: on a panel of scores two wide, a logistic curve equals its
polynomial through 16 Chebyshev nodes to about 1e-13, so that each row's share at the nodes of its panel (``_shares``) stands
for its score, and pairs of nodes stand for pairs of rows.  Newton's steps end at the one minimum.

Features are counts over the whole text, so the cost is linear and nothing is looked up.

Defined results: null text counts as empty; empty texts get a score like any other; rows without a label are scored but
not learned from; where one of the labels is missing, every score is 1; repeated rows get equal scores; a score that ties
with the threshold is accepted; very long texts are counted whole; an empty table gives an empty one; columns named
like an added one are replaced, others are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import materialize, quoted, without

AT = 0.3
#: Scores are tabulated on panels two wide, at so many nodes each.
NODES = 16
_NODE = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
#: A pass over the labelled rows has at most so many tasks, which bounds what the driver adds up.
TASKS = 128

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]\\^~_=+@/")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[:32] = True
FEATURES = 17


def features(text: bytes | None) -> list[float]:
    raw = text or b""
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, c, w = max(1, len(words)), max(1, len(raw)), np.log1p(len(words))
    kinds = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    bare = sum(1 for x in words if len(x) == 1)
    share = lambda mask: float(bytes_[mask].sum()) / c
    sym, up = share(_SYMBOL), share(_UPPER)
    return [
        w, min(len(words), 30) / 30, np.sqrt(sym), sym, np.sqrt(up), up, share(_DIGIT), share(_STOP), share(_BANG), share(_CONTROL),
        kinds / n, 1 - kinds / n if len(words) > 20 else 0.0, np.sqrt(again / n), 1 - len(set(lines)) / max(1, len(lines)),
        bare / n, c / n / 10, float(not words),
    ]


def feature_rows(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(x) for x in texts], float).reshape(-1, FEATURES)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _raw(_wide(x, self.mean, self.scale), self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold) + np.log(AT / (1 - AT)), -40, 40)))


def _wide(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -4, 4)
    return np.concatenate([z, z * z], axis=1)


def _raw(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (z * w).sum(axis=1)  # row by row: a product of matrices may round by the batch


def _logistic(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -700, 700)))


#: What a pass yields of some rows: arrays by key, to be added.
Sums = dict
Pass = Callable[[np.ndarray, np.ndarray], Sums]


def _added(parts: Iterable[Sums]) -> Sums:
    out: Sums = {}
    for part in parts:
        for k, v in part.items():
            out[k] = out[k] + v if k in out else v
    return out


def _totals(x: np.ndarray, y: np.ndarray) -> Sums:
    return {k: np.concatenate([[(y == k).sum()], x[y == k].sum(axis=0)]) for k in (0, 1)}


def _squares(mean: np.ndarray, x: np.ndarray, y: np.ndarray) -> Sums:
    return {0: ((x - mean) ** 2).sum(axis=0)}


def _shares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each score's panel, and its share at each node of it: f(s) is the sum of shares times f at the nodes."""
    panel = np.floor(s / 2)
    d = (s - 2 * panel - 1)[:, None] - _NODE
    hit = d == 0
    weight = (-1.0) ** np.arange(NODES) * np.sin((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    share = weight / np.where(hit, 1, d)
    share = np.where(hit.any(axis=1)[:, None], hit, share)
    return panel.astype(np.int64), share / share.sum(axis=1, keepdims=True)


def _moments(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> Sums:
    """By panel and label: at each node, the rows' shares and the sum of their shares times their features."""
    z = _wide(x, mean, scale)
    panel, share = _shares(_raw(z, w))
    one = np.concatenate([np.ones((len(z), 1)), z], axis=1)
    return {(int(p), k): share[at].T @ one[at] for p in np.unique(panel) for k in (0, 1) if (at := (panel == p) & (y == k)).any()}


def _curvature(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, bend: dict, x: np.ndarray, y: np.ndarray) -> Sums:
    z = _wide(x, mean, scale)
    panel, share = _shares(_raw(z, w))
    h = np.zeros(len(z))
    for p in np.unique(panel):
        for k in (0, 1):
            if (at := (panel == p) & (y == k)).any():
                h[at] = share[at] @ bend[int(p), k]
    return {0: (z * h[:, None]).T @ z}


def _counts(of: Ranker, done: int, bits: int, prefixes: set[int], x: np.ndarray, y: np.ndarray) -> Sums:
    """Rows whose score, as an ordered number of 64 bits, begins with a prefix of ``done`` bits, by the ``bits`` after it."""
    key = _ordered(of.raw(x)) >> np.uint64(64 - done - bits)
    high = key >> np.uint64(bits)
    return {p: np.bincount((key[high == p] & np.uint64(2**bits - 1)).astype(np.int64), minlength=2**bits) for p in prefixes}


def _ordered(s: np.ndarray) -> np.ndarray:
    b = (s + 0.0).view(np.uint64)  # no negative zero
    return np.where(b >> np.uint64(63) == 1, ~b, b | np.uint64(1 << 63))


def _slopes(of: Ranker, slopes: np.ndarray, x: np.ndarray, y: np.ndarray) -> Sums:
    """At each slope, how the likelihood of the labels rises with it."""
    v = of.raw(x) - of.threshold
    return {0: np.array([((y - _logistic(a * v + np.log(AT / (1 - AT)))) * v).sum() for a in slopes])}


def train(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> Ranker | None:
    """The ranker of rows at hand."""
    return learn(lambda f: f(x, y), l2)


def learn(over: Callable[[Pass], Sums], l2: float = 1e-3) -> Ranker | None:
    """The minimum of the mean of log(1 + exp(-(s_i - s_j))) over all pairs of label 1 (i) and label 0 (j), plus
    l2 / 2 * w.w, then threshold and slope.  ``over``: the sums of a pass over all rows."""
    total = over(_totals)
    n0, n1 = (int(total[k][0]) if k in total else 0 for k in (0, 1))
    if not n0 or not n1:
        return None
    n, pairs = n0 + n1, float(n0) * n1
    mean = (total[0][1:] + total[1][1:]) / n
    scale = np.sqrt(over(partial(_squares, mean))[0] / n) + 1e-6

    def at(w: np.ndarray) -> tuple[float, np.ndarray, dict, np.ndarray]:
        """Loss, slope, weights of the rows' own squares in the curvature, and the rest of the curvature."""
        got = over(partial(_moments, mean, scale, w))
        of = {k: sorted(p for p, label in got if label == k) for k in (0, 1)}
        nodes = {k: np.concatenate([2 * p + 1 + _NODE for p in of[k]]) for k in (0, 1)}
        sums = {k: np.concatenate([got[p, k] for p in of[k]]) for k in (0, 1)}
        loss, slope, cross, bend = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w))), {(p, 0): np.zeros(NODES) for p in of[0]}
        for p in of[1]:  # a panel of label 1 against all of label 0
            d = nodes[0][None] - (2 * p + 1 + _NODE)[:, None]
            lost, own = _logistic(d), got[p, 1]
            kappa = lost * (1 - lost)
            loss += own[:, 0] @ (np.maximum(d, 0) + np.log1p(np.exp(-np.abs(d)))) @ sums[0][:, 0]
            slope -= own[:, 1:].T @ (lost @ sums[0][:, 0]) - sums[0][:, 1:].T @ (own[:, 0] @ lost)
            one = own[:, 1:].T @ kappa @ sums[0][:, 1:]
            cross -= one + one.T
            bend[p, 1] = kappa @ sums[0][:, 0] / pairs
            for q, b in zip(of[0], (own[:, 0] @ kappa).reshape(-1, NODES), strict=True):
                bend[q, 0] = bend[q, 0] + b / pairs
        return loss / pairs + l2 / 2 * w @ w, slope / pairs + l2 * w, bend, cross / pairs

    w = np.zeros(2 * len(mean))
    loss, slope, bend, cross = at(w)
    while True:
        step = -np.linalg.solve(over(partial(_curvature, mean, scale, w, bend))[0] + cross + l2 * np.eye(len(w)), slope)
        gain = float(-slope @ step)
        if not gain >= 1e-16:
            w = w + step
            break
        size = 1.0
        while (new := at(w + size * step))[0] > loss - 1e-4 * size * gain + 1e-12:
            size /= 2
        w = w + size * step
        loss, slope, bend, cross = new
    out = Ranker(mean, scale, w, 0.0, 1.0)
    out.threshold = _threshold(over, out, n0, n)
    out.slope = _slope(over, out)
    return out


def _threshold(over: Callable[[Pass], Sums], of: Ranker, n0: int, n: int) -> float:
    """The quantile n0 / n of all scores, exactly: it lies between the scores of ranks n0 and n0 + 1, found bit by bit."""
    found, done = [(0, n0 - 1), (0, n0)], 0  # prefix, rank among the scores that begin with it
    for bits in (12, 12, 12, 12, 12, 4):
        counts = over(partial(_counts, of, done, bits, {p for p, _ in found}))
        for i, (p, rank) in enumerate(found):
            upto = np.cumsum(counts[p])
            b = int(np.searchsorted(upto, rank, side="right"))
            found[i] = (p << bits | b, rank - int(upto[b - 1] if b else 0))
        done += bits
    keys = np.array([p for p, _ in found], np.uint64)
    low, high = np.where(keys >> np.uint64(63) == 1, keys & np.uint64(2**63 - 1), ~keys).view(np.float64)
    return float(low + (high - low) * (1 - n0 / n))


def _slope(over: Callable[[Pass], Sums], of: Ranker, least: float = 0.05, most: float = 20.0) -> float:
    """The likeliest slope of the curve, with its value at the threshold held."""
    for _ in range(4):
        grid = np.geomspace(least, most, 32)
        rise = over(partial(_slopes, of, grid))[0]  # falls along the grid
        if rise[0] <= 0 or rise[-1] >= 0:
            return float(grid[0] if rise[0] <= 0 else grid[-1])
        k = int((rise > 0).sum())
        least, most, up, down = grid[k - 1], grid[k], rise[k - 1], rise[k]
    return float(least + (most - least) * up / (up - down))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> Ranker | None:
    """A ranker from all labelled documents.  ``may_learn``: a condition on the labels' doc_id.  Texts become features
    before they meet their labels, so that no text is moved."""
    known = labels.where(may_learn & quoted(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", quoted(label).cast("int").alias("y")).distinct()
    own = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).where(F.col("doc_id").isNotNull())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = feature_rows(b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    found = materialize(own.mapInArrow(describe, "doc_id long, x array<double>").join(known, "doc_id").select("y", "x"), "quality-features")

    def over(f: Pass) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = _added(f(b.column(1).flatten().to_numpy().reshape(-1, FEATURES), b.column(0).to_numpy()) for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], names=["sums"])

        return _added(pickle.loads(r.sums) for r in found.coalesce(TASKS).mapInArrow(run, "sums binary").collect())

    return learn(over)


def score(docs: DataFrame, ranker: Ranker | None, text: str = "text", to: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``to``: each whole text's score, 0 to 1."""
    docs = without(docs, to)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            s = ranker.score(feature_rows(texts)) if ranker else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, to])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def accepted(docs: DataFrame, ranker: Ranker | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` at or above the threshold, columns unchanged."""
    return score(docs, ranker, text, "quality_score_of_stage").where(F.col("quality_score_of_stage") >= AT).drop("quality_score_of_stage")
