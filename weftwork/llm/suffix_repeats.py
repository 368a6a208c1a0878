"""Suffix-array dedup: remove bytes that lie in a 100-byte string which also starts earlier in the corpus.

``weftwork.llm._repeats`` finds anchors whose 32-byte gram occurs more than once.  For each bucket of grams this
module sorts the suffixes that start at the anchors (an enhanced, sparse suffix array, cut at the window length),
scans the common-prefix array with a stack into its interval tree, and walks the left contexts of each interval the
same way.  An interval of length l whose members share m bytes to the left is a repeat of l + m bytes; it is reported
only where it is right-maximal (its members lie in several child intervals) and left-maximal (its members differ, or
end, in the next byte to the left), with all its occurrences rather than neighbouring pairs.  Of every such group the
earliest occurrence stays.

Defined results: null text counts as empty, stays null and loses nothing; texts shorter than the window lose nothing;
rows with equal ``doc_id`` (null ids come last) are separate documents, earlier by their place in a packed chunk, so
of fully equal rows one stays whole; an empty table gives an empty table; all input columns are returned as they are,
but columns named like an added one are replaced; very long texts are read whole, their windows in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftwork.llm import _repeats as R
from weftwork.llm.common import without

GRAM = 32


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every common-prefix interval of two suffixes or more, children before parents.
    lcp[i]: common prefix of suffixes i - 1 and i; lcp[0] is ignored."""
    stack: list[tuple[int, int]] = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, lb = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > now:
            depth, lb = stack.pop()
            if depth > 0:
                yield depth, lb, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, lb))


def _words(m: np.ndarray) -> list[np.ndarray]:
    """Byte rows as big-endian numbers, most significant first: they sort like the bytes."""
    pad = -m.shape[1] % 8
    if pad:
        m = np.pad(m, ((0, 0), (0, pad)))
    w = np.ascontiguousarray(m).view(">u8").astype(np.uint64)
    return [w[:, i] for i in range(w.shape[1])]


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix length of byte rows, at most ``most``."""
    diff = a != b
    first = np.where(diff.any(axis=1), diff.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def maximal_repeats(s: R.Shape, c: R.Contexts) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes from the anchor on, occurrences as context indexes) of each maximal repeat of at
    least the window length that holds an anchor."""
    right, left = c.tok[:, s.reach :], np.ascontiguousarray(c.tok[:, : s.reach][:, ::-1])
    sa = np.lexsort((c.right, *_words(right)[::-1], c.h))
    lcp = np.zeros(len(sa), np.int64)
    for a in range(1, len(sa), 100_000):
        i, j = sa[a - 1 : a + 99_999][: len(sa) - a], sa[a : a + 100_000]
        i = i[: len(j)]
        lcp[a : a + len(j)] = np.where(c.h[i] == c.h[j], _common(right[i], right[j], np.minimum(c.right[i], c.right[j])), 0)
    rank = np.empty(len(sa), np.int64)
    rank[np.lexsort((c.left, *_words(left)[::-1]))] = np.arange(len(sa))
    lefts = [int.from_bytes(x, "big") for x in map(bytes, left)]
    bits, clip, place, rank_of, order = 8 * left.shape[1], c.left.tolist(), lcp.tolist(), rank.tolist(), sa.tolist()
    where = [0] * len(order)
    for i, x in enumerate(order):
        where[x] = i

    def back(i: int, j: int) -> int:
        return min(clip[i], clip[j], (bits - (lefts[i] ^ lefts[j]).bit_length()) // 8)

    for depth, lb, rb in lcp_intervals(place):
        need = s.window - depth
        if need > s.reach:
            continue
        members = sorted(order[lb : rb + 1], key=rank_of.__getitem__)
        lefts_lcp = [0, *(back(i, j) for i, j in zip(members, members[1:], strict=False))]
        if max(lefts_lcp) < need:
            continue
        if need == 0 and min(lefts_lcp[1:]) == 0:
            yield 0, depth, members
        for m, a, b in lcp_intervals(lefts_lcp):
            if m < need:
                continue
            group = members[a : b + 1]
            if len(group) < rb - lb + 1:  # else it spans the whole interval, so it is right-maximal
                at = [where[x] for x in group]
                if min(place[min(at) + 1 : max(at) + 1]) > depth:
                    continue
            yield m, depth, group


def compare(s: R.Shape, c: R.Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every occurrence but the earliest of each maximal repeat the union of its spans: all of them hold the anchor, so it
    is one span for each context."""
    back, on = [0] * len(c.h), [0] * len(c.h)
    for m, depth, group in maximal_repeats(s, c):
        first = min(group)  # contexts are in corpus order
        for x in group:
            if x != first:
                if m > back[x]:
                    back[x] = m
                if depth > on[x]:
                    on[x] = depth
    i = np.flatnonzero(on)
    return i, -np.array(back, np.int64)[i], np.array(on, np.int64)[i]


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def shape(window: int, hot: int = R.HOT) -> R.Shape:
    return R.Shape(window, min(GRAM, max(1, window // 2)), False, _bytes, hot)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 100, whole_characters: bool = True) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``, and ``repeat_spans``: the removed [start, end) byte spans.
    whole_characters: keep a character of which only some bytes are covered, so that the text stays valid UTF-8."""
    docs = without(docs, "repeat_spans")
    kept_schema = T.StructType([*docs.schema.fields, T.StructField("repeat_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    at = docs.columns.index(text)

    def each(t: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
        out, cuts = [], []
        for raw, cut in zip(R.text_of(t, text), spans, strict=True):
            if raw is not None and whole_characters:
                cut = [x for x in ((_char(raw, a, False), _char(raw, b, True)) for a, b in cut) if x[0] < x[1]]
            cuts.append([{"start": a, "end": b} for a, b in cut])
            out.append(raw if raw is None else kept_of(raw, cut))
        if whole_characters:
            column = pa.array([x if x is None else x.decode("utf-8", "replace") for x in out], t.schema.field(at).type)
        else:
            column = pa.array([x if x is None else x.decode("utf-8", "ignore") for x in out], t.schema.field(at).type)
        t = t.set_column(at, t.schema.field(at), column)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return t.append_column("repeat_spans", pa.array(cuts, kind))

    return _apply(docs, text, doc_id, window, each, kept_schema)


def repeat_digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 100, hot: int = R.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that are left, one row per input row."""

    def each(t: pa.Table, spans: list[list[tuple[int, int]]]) -> pa.Table:
        raw = [x or b"" for x in R.text_of(t, text)]
        kept = [kept_of(x, cut) for x, cut in zip(raw, spans, strict=True)]
        n = [len(x) for x in raw]
        return pa.table({"doc_id": t.column(doc_id).cast(pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array([a - len(b) for a, b in zip(n, kept, strict=True)], pa.int64()), "n_spans": pa.array([len(x) for x in spans], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})

    return _apply(docs.select(doc_id, text), text, doc_id, window, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot)


def _apply(docs: DataFrame, text: str, doc_id: str, window: int, each: object, schema: object, hot: int = R.HOT) -> DataFrame:
    chunks = R.pack(docs, text, doc_id)
    return R.rewrite(chunks, R.find(shape(window, hot), chunks, text, doc_id, compare), each, schema)


def kept_of(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def _char(raw: bytes, at: int, back: bool) -> int:
    """The next character boundary at or after ``at``, or the last at or before it."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += -1 if back else 1
    return at
