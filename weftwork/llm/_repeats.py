"""Distributed search for repeated token windows, shared by the byte and the word operator.

A window is ``W`` consecutive tokens of one row.  Both operators ask which windows also start earlier in the
corpus, for every window of every row, without moving every window:

1. *Pack.*  Rows are packed once into compressed Arrow chunks of bounded size (a written table).
2. *Anchor.*  Each window elects one of its k-token grams (the smallest hash, leftmost on ties).  The choice depends
   on the window's content alone, so equal windows elect the same gram at the same offset.  An anchor carries the hash
   of its gram and of its context, the up to ``2W - k`` tokens that the windows around it can touch.  Equal anchors
   of one chunk are merged before anything is shuffled, so a gram that fills a third of the corpus is one entry a chunk.
3. *Resolve.*  Per bucket of gram hashes: a gram with one context that occurs once has nothing to compare.  Of all other
   contexts the first occurrence is asked for; its later occurrences become references to it and are not moved.
4. *Compare.*  The contexts of a gram go to the operator's own index (suffix array or automaton), and one more row stands
   for the later occurrences of a context.  What the index says of that row holds for all references, so that every
   removal comes from the index, but a repeated context is moved and compared once.  A gram of more than ``hot``
   different contexts would make one task large: its contexts are cut into parts, each for the windows that hold a longer
   gram around it, and dealt by that gram (``_parts``; the more contexts, the longer).  Parts go to the same index.
5. *Apply.*  The spans, relative to their anchors, return to the chunks and are spread over the anchors.

Step 3 gathers 25 bytes for each different (gram, context, chunk) of a gram hash in one task, the other steps one chunk or
one bucket; nothing is broadcast and nothing reaches the driver but the number of chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from weftwork.llm.common import materialize

CHUNK_BYTES = 8 << 20
BLOCK = 1 << 19
#: Of the chunks, which are written once and moved twice.
LEVEL = 6
HOT = 4096
#: (up to so many times ``hot`` contexts of a gram, parts of each); beyond the last a part is one window.
PARTS = ((1, 1), (16, 2), (128, 8))
#: Chunks and buckets for each task of an exchange.
TASK_CHUNKS, TASK_BUCKETS = 8, 2
#: Contexts cut into parts at a time.
HELD = 20_000
LAST = np.iinfo(np.int64).max

R1, R2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_tokens(raw: np.ndarray) -> np.ndarray:
    return _TABLE[raw]


def powers(r: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i <= n."""
    have = _powers.get(int(r))
    if have is None or len(have[0]) <= n:
        both = []
        for base in (int(r), pow(int(r), -1, 1 << 64)):
            p = np.full(max(n + 1, BLOCK * 2), base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[int(r)] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def prefix(tok: np.ndarray, r: np.uint64) -> np.ndarray:
    out = np.zeros(len(tok) + 1, np.uint64)
    np.cumsum(tok * powers(r, len(tok))[0][: len(tok)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, r: np.uint64, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (pre[hi] - pre[lo]) * powers(r, len(pre))[1][lo]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


@dataclass
class Shape:
    """What a window is.  ``tokens(text)``: a row's tokens as 64-bit numbers.  ``strict``: only a smaller document
    counts as earlier; else an earlier start in the same row does too."""

    window: int
    gram: int
    strict: bool
    tokens: Callable[[bytes], np.ndarray] = field(repr=False)
    hot: int = HOT

    @property
    def reach(self) -> int:
        return self.window - self.gram


def _block_anchors(s: Shape, pieces: list[tuple[int, np.ndarray, int, int, int]]) -> tuple[np.ndarray, ...]:
    """pieces: (row, tokens of the piece, offset of the piece in the row, first window start, end of window starts,
    all in the row's own positions) with the row's length last.  Returns row, pos, gram hash, context hash, left, right."""
    lens = np.array([len(p[1]) for p in pieces])
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    tok = np.concatenate([p[1] for p in pieces])
    n, k, w = len(tok), s.gram, s.reach + 1
    p1 = prefix(tok, R1)
    grams = mix((p1[k:] - p1[:-k]) * powers(R1, n)[1][: n - k + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), w)
    offset = np.array([p[2] for p in pieces])
    edge = np.zeros(len(best) + 1, np.int32)
    first, end = at + np.array([p[3] for p in pieces]) - offset, at + np.array([p[4] for p in pieces]) - offset
    np.add.at(edge, first, 1)
    np.add.at(edge, end, -1)
    a = (best[np.cumsum(edge[:-1]) > 0] & low).astype(np.int64)
    a = a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a
    which = np.searchsorted(at, a, "right") - 1
    pos = a - at[which] + offset[which]
    left = np.minimum(pos, s.reach)
    right = np.minimum(np.array([p[5] for p in pieces])[which] - pos, s.window)
    p2 = prefix(tok, R2)
    ctx = mix(spans_hash(p2, R2, a - left, a + right)) ^ mix((left * 4096 + right).astype(np.uint64) + R1)
    return np.array([p[0] for p in pieces])[which], pos, grams[a], ctx, left, right


def anchors(s: Shape, texts: list[bytes | None], keep: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """All anchors of the rows, in row and position order.  keep: collects the rows' tokens."""
    out, block, size = [], [], 0

    def flush() -> None:
        nonlocal block, size
        if block:
            out.append(_block_anchors(s, block))
        block, size = [], 0

    for row, text in enumerate(texts):
        tok = s.tokens(text or b"")
        n = len(tok)
        if keep is not None:
            keep[row] = tok
        for a in range(0, n - s.window + 1, BLOCK):
            b = min(a + BLOCK, n - s.window + 1)
            lo, hi = max(0, a - s.window), min(n, b + 2 * s.window)
            piece = tok[lo:hi]
            block.append((row, byte_tokens(piece) if piece.dtype == np.uint8 else piece, lo, a, b, n))
            size += hi - lo
            if size >= BLOCK:
                flush()
    flush()
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64), e, e
    row, pos, h, ctx, left, right = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(row) > 1:  # a long row's pieces may elect the same anchor twice
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])))
        row, pos, h, ctx, left, right = (x[new] for x in (row, pos, h, ctx, left, right))
    return row, pos, h, ctx, left, right


# --- chunks ------------------------------------------------------------------------------------------------------


def _ipc(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
        w.write_table(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def pack(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` as a written table (chunk long, blob binary); rows of a chunk are in id order, null ids last."""
    at, by = docs.columns.index(text), docs.columns.index(doc_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            key = t.column(by)
            order = np.argsort(key.fill_null(LAST).to_numpy().astype(np.int64), kind="stable")
            blob = _ipc(t.take(pa.array(order)).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "blob"])

        for b in batches:
            lens = pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()
            start = 0
            for i in range(b.num_rows):
                size += lens[i] + 64
                if size >= CHUNK_BYTES:
                    held.append(b.slice(start, i + 1 - start))
                    yield out()
                    held, size, start = [], 0, i + 1
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield out()

    return materialize(docs.mapInArrow(cut, "chunk long, blob binary"), "chunks", "uncompressed")


def text_of(t: pa.Table, text: str) -> list[bytes | None]:
    return t.column(t.column_names.index(text)).cast(pa.binary()).to_pylist()


def ids_of(t: pa.Table, doc_id: str) -> np.ndarray:
    return t.column(doc_id).fill_null(LAST).to_numpy().astype(np.int64)


# --- packed arrays -----------------------------------------------------------------------------------------------


def dump(*arrays: np.ndarray, level: int = 1) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), level)


def load(blob: bytes, n: int, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """kinds: (dtype, values a row)."""
    raw, out, at = zstandard.decompress(blob), [], 0
    for kind, width in kinds:
        a = np.frombuffer(raw, kind, n * width, at)
        at += a.nbytes
        out.append(a.reshape(n, width) if width > 1 else a)
    return out


@dataclass
class Index:
    """A chunk's anchors, and its distinct (gram, context) pairs in hash order with the first anchor of each."""

    row: np.ndarray
    pos: np.ndarray
    h: np.ndarray
    ctx: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rep: np.ndarray
    inverse: np.ndarray


def index_chunk(s: Shape, texts: list[bytes | None], keep: dict[int, np.ndarray] | None = None) -> Index:
    row, pos, h, ctx, left, right = anchors(s, texts, keep)
    order = np.lexsort((ctx, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return Index(row, pos, h, ctx, left, right, order[new], inverse)


def dealt(h: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by bucket (stable), and (bucket, from, to) in that order of each bucket that has any."""
    b = (h % np.uint64(n)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b = b[order]
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))[: len(b)])
    ends = np.append(first[1:], len(b))[: len(first)]
    return order, list(zip(b[first].tolist(), first.tolist(), ends.tolist(), strict=True))


#: What a chunk is told of an entry: its first occurrence is elsewhere; send its context; the first occurrence is here (or,
#: if only smaller documents count, in a row of the same document).  From bit LEVEL_BIT on: into how many parts (an index of
#: PARTS) the context of its first occurrence is cut and sent, too.
REFERS, SEND, FIRST, LEVEL_BIT = 1, 2, 8, 4


def resolve(s: Shape, h: np.ndarray, ctx: np.ndarray, doc: np.ndarray, multi: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(status of each entry, index of its context's first occurrence).  multi: it occurs later in its own chunk, too."""
    order = np.lexsort((chunk, doc, ctx, h))
    hs, cs, ds = h[order], ctx[order], doc[order]
    new_h = np.concatenate(([True], hs[1:] != hs[:-1]))
    new_c = new_h | np.concatenate(([True], cs[1:] != cs[:-1]))
    g, c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
    many = np.bincount(g[new_c])[g]
    first = np.flatnonzero(new_c)[c]
    later = ds > ds[first] if s.strict else ~new_c
    copied = np.bincount(c, later | multi[order])[c] > 0
    live = copied | (many > 1)
    level = np.searchsorted([s.hot * times for times, _ in PARTS], many, "left")
    told = np.where(new_c, np.where(copied | (level == 0), SEND, 0), REFERS) | np.where(later, 0, FIRST | level << LEVEL_BIT)
    out, leader = np.empty(len(h), np.uint8), np.empty(len(h), np.int64)
    out[order] = np.where(live, told, 0)
    leader[order] = order[first]
    return out, leader


def bucket_key(h: np.ndarray, ctx: np.ndarray, status: np.ndarray) -> np.ndarray:
    """What contexts meet under: their gram, but those of a gram with too many only their own copies."""
    return np.where(status >> LEVEL_BIT, mix(h ^ mix(ctx)), h)


def merge_spans(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the spans of each row, touching ones joined."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    big = np.int64(1) << np.int64(40)
    top = np.maximum.accumulate(hi + row * big)
    new = np.ones(len(row), bool)
    new[1:] = lo[1:] + row[1:] * big > top[:-1]
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(row) - 1]))
    return row[new], lo[new], top[last] - row[new] * big


#: Rows that move: entries and what is told of them; contexts and parts of them; references; and for the end the places of
#: entries, and spans relative to the anchors of an entry.
ENTRIES, CONTEXTS, REFERENCES, PLACES, REPLIES = range(5)
_OUT = "kind int, bucket int, chunk long, at int, n int, blob binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])


def _row(kind: int, bucket: int, chunk: int, n: int, blob: bytes, at: int = 0) -> dict:
    return {"kind": kind, "bucket": bucket, "chunk": chunk, "at": at, "n": n, "blob": blob}


def table_of(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_SCHEMA)


@dataclass
class Contexts:
    """The contexts of a bucket, in corpus order.  tok: reach + window tokens a row, the anchor at column ``reach``; outside
    left and right it holds zeros.  The last rows stand for later occurrences: ``of`` is the row they repeat, else -1."""

    h: np.ndarray
    doc: np.ndarray
    left: np.ndarray
    right: np.ndarray
    tok: np.ndarray
    of: np.ndarray


#: From contexts to removed spans: arrays (index of the context, start, end) relative to the context's anchor.
Compare = Callable[[Shape, Contexts], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _gather(s: Shape, ix: Index, keep: dict[int, np.ndarray], pick: np.ndarray) -> np.ndarray:
    kind = next(iter(keep.values())).dtype
    out = np.zeros((len(pick), s.reach + s.window), kind)
    for i, a in enumerate(pick):
        left, right, p = ix.left[a], ix.right[a], ix.pos[a]
        out[i, s.reach - left : s.reach + right] = keep[int(ix.row[a])][p - left : p + right]
    return out


def _parts(s: Shape, level: int, tok: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The parts of contexts, of each: (index of the context, key, hash of the part, left, right).

    The windows around an anchor start 0 to ``reach`` tokens before it.  Those that start lo to hi before it all hold the
    tokens from -lo to window - hi: a gram longer than the anchor's, the longer the fewer starts there are in a part.  Equal
    windows have equal ones, so they meet under its hash, and a part needs only the tokens that its own windows touch."""
    n = PARTS[level][1] if level < len(PARTS) else s.reach + 1
    q = -(-(s.reach + 1) // n)
    t = byte_tokens(tok) if tok.dtype == np.uint8 else tok
    sums = []
    for r in (R1, R2):
        p = np.zeros((len(t), t.shape[1] + 1), np.uint64)
        np.cumsum(t * powers(r, t.shape[1])[0][: t.shape[1]], axis=1, out=p[:, 1:])
        sums.append((p, powers(r, t.shape[1])[1]))

    def hashed(which: int, of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        p, inverse = sums[which]
        return mix((p[of, s.reach + hi] - p[of, s.reach - lo]) * inverse[s.reach - lo])

    for lo in range(0, s.reach + 1, q):
        hi = min(lo + q - 1, s.reach)
        of = np.flatnonzero(np.maximum(lo, s.window - right) <= np.minimum(hi, left))
        a, b = np.minimum(left[of], hi), np.minimum(right[of], s.window - lo)
        key = mix(hashed(0, of, np.full(len(of), lo), np.full(len(of), s.window - hi)) + np.uint64(lo + 1))
        yield of, key, hashed(1, of, a, b) ^ mix((a * 4096 + b).astype(np.uint64) + R1), a, b


def _only(s: Shape, tok: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``tok`` with zeros outside left and right."""
    at = np.arange(tok.shape[1])[None, :] - s.reach
    return np.where((at >= -left[:, None]) & (at < right[:, None]), tok, np.zeros(1, tok.dtype))


def _by_chunk(chunk: np.ndarray) -> list[np.ndarray]:
    """Indexes of each chunk's rows."""
    o = np.argsort(chunk, kind="stable")
    return np.split(o, np.flatnonzero(np.diff(chunk[o])) + 1) if len(o) else []


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, member) of all members of the ranges."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of]


def _answers(s: Shape, group: pa.Table, compare: Compare) -> list[dict]:
    """What the index says of a bucket's contexts, for each chunk that holds them."""
    g = group.filter(pc.equal(group["kind"], CONTEXTS))
    if not g.num_rows:
        return []
    width, kinds = s.reach + s.window, [("u8", 1), ("i8", 1), ("i4", 1), ("i4", 1), ("u1", 1), ("u1", 1), ("u1", 1)]
    parts = []
    for m, blob in zip(g["n"].to_pylist(), g["blob"], strict=True):
        wide = len(zstandard.decompress(blob.as_buffer())) // m - 27 > width
        parts.append(load(blob.as_buffer(), m, *kinds, ("u8" if wide else "u1", width)))
    chunk = np.repeat(g["chunk"].to_numpy(), g["n"].to_numpy())
    h, doc, at, entry, left, right, multi, tok = (np.concatenate([p[i] for p in parts]) for i in range(8))
    o = np.lexsort((at, chunk, doc))
    h, doc, chunk, entry, left, right, multi, tok = (x[o] for x in (h, doc, chunk, entry, left.astype(np.int64), right.astype(np.int64), multi, tok))

    r = group.filter(pc.equal(group["kind"], REFERENCES))
    to_chunk, to_entry, own_chunk, own_entry, needs = (np.zeros(0, k) for k in ("i8", "i4", "i8", "i4", "u1"))
    if r.num_rows:
        refs = [load(blob.as_buffer(), m, ("i8", 1), ("i4", 1), ("i8", 1), ("i4", 1), ("u1", 1)) for m, blob in zip(r["n"].to_pylist(), r["blob"], strict=True)]
        to_chunk, to_entry, own_chunk, own_entry, needs = (np.concatenate([p[i] for p in refs]) for i in range(5))
    by = np.lexsort((entry, chunk))  # the context that each reference names
    names = np.rec.fromarrays([chunk[by], entry[by]], names="chunk,entry")
    of = by[np.searchsorted(names, np.rec.fromarrays([to_chunk, to_entry], names="chunk,entry"))]

    copied = multi > 0
    copied[of[needs & 2 > 0]] = True
    again = np.flatnonzero(copied)
    c = Contexts(*(np.concatenate((x, x[again])) for x in (h, doc, left, right, tok)), np.concatenate((np.full(len(h), -1), again)))
    c.doc[len(h) :] = LAST  # after whatever they repeat
    i, lo, hi = compare(s, c)

    a, b, m = np.flatnonzero(needs & 1), np.flatnonzero(needs & 2), np.flatnonzero(multi)
    key = np.concatenate((2 * np.arange(len(h)), 2 * m + 1, 2 * of[a], 2 * of[b] + 1))
    target_chunk = np.concatenate((chunk, chunk[m], own_chunk[a], own_chunk[b]))
    target_entry = np.concatenate((entry, entry[m], own_entry[a], own_entry[b]))
    order = np.argsort(key, kind="stable")
    wanted = np.where(c.of[i] < 0, 2 * i, 2 * c.of[i] + 1)
    x, to = _ranges(np.searchsorted(key[order], wanted, "left"), np.searchsorted(key[order], wanted, "right"))
    to = order[to]
    rows = []
    for part in _by_chunk(target_chunk[to]):
        t, v = to[part], x[part]
        rows.append(_row(REPLIES, 0, int(target_chunk[t[0]]), len(t), dump((2 * target_entry[t].astype(np.int64) + key[t] % 2), lo[v].astype(np.int16), hi[v].astype(np.int16))))
    return rows


def find(s: Shape, chunks: DataFrame, text: str, doc_id: str, compare: Compare) -> DataFrame:
    """What ``rewrite`` needs to know of the removed spans: rows of kind PLACES and REPLIES for the chunks."""
    n_chunks = chunks.count()
    n = max(32, n_chunks // 2)
    least = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk_tasks, bucket_tasks = max(least, n_chunks // TASK_CHUNKS), max(least, n // TASK_BUCKETS)

    def entries(ix: Index, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document of each entry's first anchor, whether later ones are copies, whether each anchor is one)."""
        doc = ids[ix.row[ix.rep]]
        copy = ids[ix.row] > doc[ix.inverse] if s.strict else np.arange(len(ix.row)) != ix.rep[ix.inverse]
        return doc, np.bincount(ix.inverse, copy, len(doc)) > 0, copy

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = unpack(blob.as_buffer())
                ix = index_chunk(s, text_of(t, text))
                doc, multi, _ = entries(ix, ids_of(t, doc_id))
                order, parts = dealt(ix.h[ix.rep], n)
                rows = []
                for k, lo, hi in parts:
                    e = order[lo:hi]
                    a = ix.rep[e]
                    rows.append(_row(ENTRIES, k, chunk, len(e), dump(ix.h[a], ix.ctx[a], doc[e], multi[e].astype(np.uint8)), lo))
                yield from table_of(rows).to_batches()

    def settle(group: pa.Table) -> pa.Table:
        sizes, chunk, at = group["n"].to_numpy(), group["chunk"].to_numpy(), group["at"].to_numpy()
        parts = [load(blob.as_buffer(), m, ("u8", 1), ("u8", 1), ("i8", 1), ("u1", 1)) for m, blob in zip(sizes.tolist(), group["blob"], strict=True)]
        h, ctx, doc, multi = (np.concatenate([p[i] for p in parts]) for i in range(4))
        ends = np.cumsum(sizes)
        whose, entry = np.repeat(chunk, sizes), np.arange(len(h)) - np.repeat(ends - sizes - at, sizes)
        status, leader = resolve(s, h, ctx, doc, multi, whose)
        told = zip(chunk.tolist(), at.tolist(), sizes.tolist(), ends.tolist(), strict=True)
        rows = [_row(ENTRIES, 0, c, m, dump(status[e - m : e]), a) for c, a, m, e in told if status[e - m : e].any()]  # silence says 0
        refs = np.flatnonzero(status & REFERS)
        needs = np.where(status[refs] & FIRST, 1 | 2 * multi[refs], 2).astype(np.uint8)
        to, key = leader[refs], bucket_key(h[leader[refs]], ctx[leader[refs]], status[leader[refs]])
        order, places = dealt(key, n)
        for k, lo, hi in places:
            o = order[lo:hi]
            o = o[np.lexsort((entry[refs[o]], whose[refs[o]]))]
            x = refs[o]
            rows.append(_row(REFERENCES, k, 0, len(x), dump(whose[to[o]], entry[to[o]].astype(np.int32), whose[x], entry[x].astype(np.int32), needs[o])))
        return table_of(rows)

    def back(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[dict] = []
        for chunk, blob in zip(docs["chunk"].to_pylist(), docs["blob"], strict=True):
            t = unpack(blob.as_buffer())
            keep: dict[int, np.ndarray] = {}
            ix = index_chunk(s, text_of(t, text), keep)
            ids = ids_of(t, doc_id)
            doc, multi, copy = entries(ix, ids)
            order, _ = dealt(ix.h[ix.rep], n)
            number = np.empty(len(order), np.int64)  # of an entry, as it was sent
            number[order] = np.arange(len(order))
            status = np.zeros(len(ix.rep), np.uint8)
            for at, m, packed in zip(told["at"].to_pylist(), told["n"].to_pylist(), told["blob"], strict=True):
                status[order[at : at + m]] = load(packed.as_buffer(), m, ("u1", 1))[0]
            mine = status[ix.inverse]
            early = (mine & FIRST > 0) & ~copy

            live = np.flatnonzero(mine & (REFERS | SEND))
            places = [(2 * number[ix.inverse[live]] + ~early[live], ix.row[live], ix.pos[live])]

            pick = np.flatnonzero(status & SEND)
            key = bucket_key(ix.h[ix.rep[pick]], ix.ctx[ix.rep[pick]], status[pick])
            by, parts = dealt(key, n)
            for k, lo, hi in parts:
                e = pick[by[lo:hi]]
                a = ix.rep[e]
                rows.append(_row(CONTEXTS, k, chunk, len(e), dump(key[by[lo:hi]], doc[e], a.astype(np.int32), number[e].astype(np.int32), ix.left[a].astype(np.uint8), ix.right[a].astype(np.uint8), multi[e].astype(np.uint8), _gather(s, ix, keep, a))))

            known = len(ix.rep)  # entries numbered so far
            for level in range(1, len(PARTS) + 1):
                hot = np.flatnonzero((mine >> LEVEL_BIT == level) & early)
                for part in np.split(hot, range(HELD, len(hot), HELD)):
                    if not len(part):
                        continue
                    tok = _gather(s, ix, keep, part)
                    for of, key, one, left, right in _parts(s, level, tok, ix.left[part], ix.right[part]):
                        if not len(of):
                            continue
                        o = np.lexsort((of, one, key))
                        a, key, one = part[of[o]], key[o], one[o]  # equal parts in corpus order
                        new = np.concatenate(([True], (key[1:] != key[:-1]) | (one[1:] != one[:-1])))
                        e, first = np.cumsum(new) - 1, np.flatnonzero(new)
                        own = ids[ix.row[a]]
                        copy = own > own[first][e] if s.strict else ~new
                        places.append((2 * (known + e) + copy, ix.row[a], ix.pos[a]))
                        multi, key = np.bincount(e, copy, len(first)) > 0, key[first]
                        x = of[o][first]
                        left, right = left[o][first], right[o][first]
                        by, parts = dealt(key, n)
                        for k, lo, hi in parts:
                            y = by[lo:hi]
                            rows.append(_row(CONTEXTS, k, chunk, len(y), dump(key[y], own[first][y], part[x[y]].astype(np.int32), (known + y).astype(np.int32), left[y].astype(np.uint8), right[y].astype(np.uint8), multi[y].astype(np.uint8), _only(s, tok[x[y]], left[y], right[y]))))
                        known += len(first)
            to, row, pos = (np.concatenate(x) for x in zip(*places, strict=True))
            o = np.argsort(to, kind="stable")
            rows.append(_row(PLACES, 0, chunk, len(o), dump(to[o], row[o].astype(np.int32), pos[o].astype(np.int64))))
        return table_of(rows)

    def last(group: pa.Table) -> pa.Table:
        return table_of(_answers(s, group, compare))

    sent = chunks.mapInArrow(forward, _OUT).repartition(bucket_tasks, "bucket")
    settled = materialize(sent.groupBy("bucket").applyInArrow(settle, _OUT), "settled", "uncompressed")
    told = settled.where(f"kind = {ENTRIES}").repartition(chunk_tasks, "chunk")
    both = materialize(chunks.repartition(chunk_tasks, "chunk").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(back, _OUT), "spans", "uncompressed")
    asked = both.where(f"kind = {CONTEXTS}").unionByName(settled.where(f"kind = {REFERENCES}"))
    more = asked.repartition(bucket_tasks, "bucket").groupBy("bucket").applyInArrow(last, _OUT)
    return both.where(f"kind = {PLACES}").unionByName(more).repartition(chunk_tasks, "chunk")


def _spread(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all removed spans of a chunk."""
    out = [(np.zeros(0, np.int64),) * 3]
    place = [np.zeros(0, np.int64)] * 3
    replies = []
    for kind, m, blob in zip(found["kind"].to_pylist(), found["n"].to_pylist(), found["blob"], strict=True):
        if not m:
            continue
        if kind == PLACES:
            place = load(blob.as_buffer(), m, ("i8", 1), ("i4", 1), ("i8", 1))
        else:
            replies.append(load(blob.as_buffer(), m, ("i8", 1), ("i2", 1), ("i2", 1)))
    for key, lo, hi in replies:
        x, to = _ranges(np.searchsorted(place[0], key, "left"), np.searchsorted(place[0], key, "right"))
        out.append((place[1][to].astype(np.int64), place[2][to] + lo[x], place[2][to] + hi[x]))
    return merge_spans(*(np.concatenate(x) for x in zip(*out, strict=True)))


def rewrite(chunks: DataFrame, spans: DataFrame, each: Callable[[pa.Table, list[list[tuple[int, int]]]], pa.Table], schema: object) -> DataFrame:
    """``each(rows of a chunk, sorted disjoint spans of each row)`` over all chunks.  ``spans``: what ``find`` gave."""

    def apply(docs: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for blob in docs["blob"]:
            t = unpack(blob.as_buffer())
            per: list[list[tuple[int, int]]] = [[] for _ in range(t.num_rows)]
            for r, a, b in zip(*(x.tolist() for x in _spread(found)), strict=True):
                per[r].append((a, b))
            out.append(each(t, per))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(apply, schema)


__all__ = ["Contexts", "Shape", "find", "merge_spans", "pack", "rewrite"]
