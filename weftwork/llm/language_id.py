"""Language ID by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, each filter's best response in a window is kept
(max pooling), and a softmax over these maxima gives the languages.  The network is trained in numpy on the driver,
on a bounded sample of labelled rows, and applied to every window of every text in batches.

Defined results: a text that is null or has no letter (Unicode category L: numerals like a half or a Roman eight are
none) is ``und`` with score 0; null labels are not learned from; where no row can be learned from, every text is ``und``;
repeated rows get equal results; of classes that tie the alphabetically first is given; a very long text is read
whole, in batches of windows; other columns are not looked at, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import quoted

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
#: At most so many labelled rows, of each so many windows, are learned from.
TRAIN_ROWS = 3000
TRAIN_WINDOWS = 4
BATCH = 2048
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
#: A-Z as a-z, digits and symbols as blanks.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


@dataclass
class ByteConvNet:
    languages: list[str]
    filters: list[np.ndarray]  # a width: (width, 256, FILTERS)
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of the filters in each window, and where they are."""
        out, where = [], []
        for w, b in zip(self.filters, self.bias, strict=True):
            n = windows.shape[1] - len(w) + 1
            x = w[0][windows[:, :n]]
            for j in range(1, len(w)):
                x += w[j][windows[:, j : j + n]]
            at = x.argmax(axis=1)
            out.append(np.maximum(np.take_along_axis(x, at[:, None], 1)[:, 0] + b, 0))
            where.append(at)
        return np.concatenate(out, axis=1), where

    def maxima(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for w, b in zip(self.filters, self.bias, strict=True):
            n = windows.shape[1] - len(w) + 1
            x = w[0].take(windows[:, :n], axis=0)
            for j in range(1, len(w)):
                x += w[j].take(windows[:, j : j + n], axis=0)
            out.append(np.maximum(x.max(axis=1) + b, 0))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _log_softmax(self.maxima(windows) @ self.dense + self.offset)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text; the last is filled with blanks."""
    raw = _FOLD[np.frombuffer(text, np.uint8)]
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WINDOW)


def train(windows: np.ndarray, labels: list[str], epochs: int = 14, seed: int = 7, rate: float = 0.01) -> ByteConvNet:
    """Adam on the cross entropy, each language weighing the same."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rnd = np.random.default_rng(seed)
    net = ByteConvNet(languages, [rnd.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rnd.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*net.filters, *net.bias, net.dense, net.offset]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(y, minlength=len(languages))
    weigh = (len(y) / np.maximum(share, 1) / len(languages)).astype(np.float32)
    for epoch in range(epochs):
        order = rnd.permutation(len(y))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x, own = windows[pick], y[pick]
            pooled, where = net.pooled(x)
            error = np.exp(_log_softmax(pooled @ net.dense + net.offset))
            error[np.arange(len(own)), own] -= 1
            error *= weigh[own][:, None] / len(own)
            back = (error @ net.dense.T) * (pooled > 0)
            grads_w, grads_b = [], []
            for k, (w, best) in enumerate(zip(net.filters, where, strict=True)):
                g, into = np.zeros_like(w), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(w)):
                    byte = np.take_along_axis(x, best + j, 1)
                    np.add.at(g[j], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), into)
                grads_w.append(g)
                grads_b.append(into.sum(axis=0))
            t += 1
            for i, g in enumerate([*grads_w, *grads_b, pooled.T @ error, error.sum(axis=0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= (rate / (1 + epoch / 5) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> ByteConvNet | None:
    """A network from at most ``rows`` labelled rows (picked by the hash of their ids) and TRAIN_WINDOWS windows of each,
    spread over its text.  None where there is no such row."""
    rows_there = docs.where(may_learn & quoted(lang).isNotNull()).count()
    # about half as many again as are needed pass this cut, so that what tasks send to the driver does not grow with them
    low = F.pmod(F.xxhash64(quoted(doc_id)), F.lit(1 << 24)) <= F.lit(int(min(1.0, 1.5 * rows / max(1, rows_there)) * (1 << 24)))
    n = F.length("t")
    cut = F.array(*[F.substring(F.col("t"), (n * i / TRAIN_WINDOWS).cast("int") + 1, F.lit(WINDOW)) for i in range(TRAIN_WINDOWS)])
    found = (
        docs.where(may_learn & low & quoted(lang).isNotNull() & quoted(text).isNotNull())
        .select(quoted(lang).alias("y"), quoted(text).alias("t"), F.xxhash64(quoted(doc_id)).alias("o"))
        .where(F.col("t").rlike(r"\p{L}"))
        .select("y", "o", F.array_distinct(cut).alias("w"))
        .orderBy("o", "y", "w")
        .limit(rows)
        .collect()
    )
    pairs = sorted((r.y, w) for r in found for w in r.w if _LETTER.search(w))
    if not pairs:
        return None
    return train(np.concatenate([windows_of(w.encode())[:1] for _, w in pairs]), [y for y, _ in pairs])


def predict(docs: DataFrame, net: ByteConvNet | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score for every row: the mean over its windows of the log probabilities, normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            speaks = np.array([bool(x) and _LETTER.search(x) is not None for x in texts], bool)
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if net is not None and speaks.any():
                total = np.zeros((len(texts), len(net.languages)))
                count = np.zeros(len(texts))
                for rows, windows in _batches(texts, speaks):
                    np.add.at(total, rows, net.log_probabilities(windows))
                    np.add.at(count, rows, 1)
                p = np.exp(_log_softmax(total[speaks] / count[speaks][:, None]))
                best = p.argmax(axis=1)
                for i, k, s in zip(np.flatnonzero(speaks).tolist(), best.tolist(), p.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = net.languages[k], s
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def _batches(texts: list[str | None], speaks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, windows) of at most BATCH windows."""
    rows, held, n = [], [], 0
    for i in np.flatnonzero(speaks).tolist():
        w = windows_of(texts[i].encode())
        for at in range(0, len(w), BATCH):
            part = w[at : at + BATCH]
            rows.append(np.full(len(part), i))
            held.append(part)
            n += len(part)
            if n >= BATCH:
                yield np.concatenate(rows), np.concatenate(held)
                rows, held, n = [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(held)
