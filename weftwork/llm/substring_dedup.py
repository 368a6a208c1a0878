"""Substring dedup: remove words that lie in a 13-word window which also starts in a document with a smaller id.

``weftwork.llm._repeats`` finds the word grams that occur more than once and deals their contexts into shards.
In each shard a suffix automaton is built over the reference contexts, every state with the smallest document that
holds its strings; the shard's documents are then streamed through it.  At each word the automaton gives the longest
suffix that a smaller document also holds (the matching statistic), and each match of at least the window length
becomes a removed span.

The automata are dealt with their documents rather than broadcast: over the whole corpus they grow with the data, so
no broadcast of them has a size bound.

Defined results: null text has no words and stays null; rows with equal ``doc_id`` are not smaller than each other, so
equal rows are treated alike; null ids come last; texts of fewer words than the window lose nothing; an empty table
gives an empty table; very long texts are read whole, their windows in blocks; input columns are kept, but columns
named like an added one are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftwork.llm import _repeats as R
from weftwork.llm.common import without

GRAM = 6
#: Contexts of one automaton: more than a gram can have before its windows are compared by hash.
SHARD = 2048
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    edge = np.diff(np.concatenate(([False], ~_BLANK[raw], [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_tokens(text: bytes) -> np.ndarray:
    """A 64-bit number for each word: its bytes themselves (mixed, one to one) up to seven, two mixed halves up to sixteen,
    XXH3 beyond."""
    raw = np.frombuffer(text, np.uint8)
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.frombuffer(text + bytes(8), np.uint8)
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = (end - start).astype(np.uint64)
    head = eight[start]
    few = size < np.uint64(8)
    head[few] &= (np.uint64(1) << (np.uint64(8) * size[few])) - np.uint64(1)
    out = R.mix(head ^ (size << np.uint64(56)))
    more = np.flatnonzero((end - start >= 8) & (end - start <= 16))
    out[more] = R.mix(R.mix(head[more] + size[more] * R.R1) + eight[end[more] - 8] * R.R2)
    view = memoryview(text)
    for i in np.flatnonzero(end - start > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[start[i] : end[i]])
    return out


class SuffixAutomaton:
    """Of several token sequences.  Each state: its longest length, its suffix link, its transitions, and the smallest
    document in which its strings end."""

    def __init__(self) -> None:
        self.length, self.link, self.next, self.least = [0], [-1], [{}], [R.LAST]

    def add(self, tokens: list[int], doc: int) -> None:
        length, link, nxt, least = self.length, self.link, self.next, self.least
        last = 0
        for c in tokens:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    cur = q
                else:
                    cur = self._split(last, c, q)
            else:
                cur = len(length)
                length.append(length[last] + 1)
                link.append(0)
                nxt.append({})
                least.append(R.LAST)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    link[cur] = q if length[p] + 1 == length[q] else self._split(p, c, q)
            if doc < least[cur]:
                least[cur] = doc
            last = cur

    def _split(self, p: int, c: int, q: int) -> int:
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(self.next[q].copy())
        self.least.append(R.LAST)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def finish(self) -> None:
        """Carry each state's smallest document to the states of its suffixes."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            u = self.link[v]
            if self.least[v] < self.least[u]:
                self.least[u] = self.least[v]

    def earlier_matches(self, tokens: list[int], doc: int, least: int) -> list[tuple[int, int]]:
        """[start, end) of the suffixes, at least ``least`` long, that a smaller document holds."""
        out: list[tuple[int, int]] = []
        v, n = 0, 0
        for i, c in enumerate(tokens):
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            u, m = v, n
            while u and self.least[u] >= doc:
                u = self.link[u]
                m = self.length[u]
            if u and m >= least:
                if out and i + 1 - m <= out[-1][1]:
                    out[-1] = (min(out[-1][0], i + 1 - m), i + 1)
                else:
                    out.append((i + 1 - m, i + 1))
        return out


def compare(s: R.Shape, c: R.Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(c.h, kind="stable")  # the contexts of a gram lie together, in corpus order
    bounds = [0, *(np.flatnonzero(np.diff(c.h[order])) + 1).tolist(), len(order)]
    tokens = [x[s.reach - a : s.reach + b] for x, a, b in zip(c.tok.tolist(), c.left.tolist(), c.right.tolist(), strict=True)]
    doc, left, of = c.doc.tolist(), c.left.tolist(), c.of.tolist()
    idx: list[int] = []
    lo: list[int] = []
    hi: list[int] = []
    shard: list[int] = []

    def run() -> None:
        sam = SuffixAutomaton()
        for i in shard:
            if of[i] < 0:
                sam.add(tokens[i], doc[i])
        sam.finish()
        for i in shard:
            for a, b in sam.earlier_matches(tokens[i], doc[i], s.window):
                idx.append(i)
                lo.append(a - left[i])
                hi.append(b - left[i])
        shard.clear()

    for a, b in zip(bounds, bounds[1:], strict=False):
        if len(shard) + b - a > SHARD and shard:
            run()
        shard.extend(order[a:b].tolist())
    if shard:
        run()
    return np.array(idx, np.int64), np.array(lo, np.int64), np.array(hi, np.int64)


def shape(window: int, hot: int = R.HOT) -> R.Shape:
    return R.Shape(window, min(GRAM, window), True, word_tokens, hot)


def _kept(raw: bytes | None, spans: list[tuple[int, int]]) -> list[bytes]:
    words = (raw or b"").split()
    for a, b in reversed(spans):
        del words[a:b]
    return words


def remove_copied_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 13) -> DataFrame:
    """``docs`` with ``text`` as its kept words joined by one space where words were removed, else as it was, and
    ``word_spans``: the removed [start, end) word spans."""
    docs = without(docs, "word_spans")
    at = docs.columns.index(text)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("word_spans", T.ArrayType(span))])

    def each(t: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
        new = [b" ".join(_kept(raw, cut)).decode() if cut else (raw if raw is None else raw.decode()) for raw, cut in zip(R.text_of(t, text), spans, strict=True)]
        cuts = [[{"start": a, "end": b} for a, b in cut] for cut in spans]
        t = t.set_column(at, t.schema.field(at), pa.array(new, t.schema.field(at).type))
        return t.append_column("word_spans", pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))

    return _apply(docs, text, doc_id, window, each, schema)


def copied_words_digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 13, hot: int = R.HOT) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space, one row per input row."""

    def each(t: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
        n, removed, sha = [], [], []
        for raw, cut in zip(R.text_of(t, text), spans, strict=True):
            kept = _kept(raw, cut)
            gone = sum(b - a for a, b in cut)
            n.append(len(kept) + gone)
            removed.append(gone)
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"doc_id": t.column(doc_id).cast(pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return _apply(docs.select(doc_id, text), text, doc_id, window, each, "doc_id long, n_words long, n_removed long, kept_sha256 string", hot)


def _apply(docs: DataFrame, text: str, doc_id: str, window: int, each: object, schema: object, hot: int = R.HOT) -> DataFrame:
    chunks = R.pack(docs, text, doc_id)
    return R.rewrite(chunks, R.find(shape(window, hot), chunks, text, doc_id, compare), each, schema)
