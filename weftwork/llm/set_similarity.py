"""Texts that share LEAST of their shingles: candidates by MinHash bands, pruned by sketches, verified by the shingles.

Each text has MINIMA minima of its shingle hashes, each under a permutation of its own.  Two texts of Jaccard similarity
s agree in a minimum with probability s.  Texts meet where a band of two minima agrees: at s = 0.8 a pair meets in none of
BANDS bands with probability 0.36 ** 10, below 0.0001.  Before shingles are moved, pairs that agree in fewer than AGREE
of the minima's bytes are dropped (at s = 0.8 that loses one pair in ten million).  What is left is verified exactly.

Two looks keep large groups cheap.  First each bucket links its members to its smallest one; what verifies is
merged.  Then only buckets that still hold several components compare members of different components.  Where
that gives more than PAIRS pairs a member, the sets come to the bucket instead of pairs to the sets: shared shingles are
counted there over an inverted index, and only a spanning forest of what is similar leaves it.  A bucket of more than
DENSE members is dealt again under each further band of its members, LEVELS times at most, so that it falls apart unless its
members agree in all of them.  Nothing is capped.

Shingles are compared by 64-bit hash; texts of equal words are one node, by 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import materialize
from weftwork.llm.components import connected_components

MINIMA, BANDS, AGREE = 100, 10, 58
DENSE, LEVELS, PAIRS = 4096, 3, 8
#: Rows that one task of a bucket exchange takes.
TASK_ROWS = 500_000

_FACTORS = np.random.default_rng(20240611).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(own: np.ndarray) -> tuple[list[int], bytes]:
    """(bands, a byte of each minimum) of a set of hashes; nothing for an empty set."""
    if not len(own):
        return [], b""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), 4096):
        least = np.minimum(least, (own[a : a + 4096][:, None] * _FACTORS[None, :]).min(axis=0))
    bands = [xxhash.xxh64_intdigest(least[2 * b : 2 * b + 2].tobytes(), b) - (1 << 63) for b in range(BANDS)]
    return bands, ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is 4/5 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of whole buckets, whose first column is sorted: parts of all batches that end between two keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut == 0 and held and held[-1].column(0)[-1].as_py() == key[0]:
            held.append(b)  # one bucket goes on over several batches
            continue
        yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().columns
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().columns


def bucket_pairs(n: np.ndarray, root: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the pairs of a bucket's members that may be similar and are not in one component."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(n), 256):
        for b in range(a, len(n), 1024):
            x, y = slice(a, a + 256), slice(b, b + 1024)
            p, q = n[x][:, None], n[y][None, :]
            i, j = np.nonzero((root[x][:, None] != root[y][None, :]) & (5 * np.minimum(p, q) >= 4 * np.maximum(p, q)))
            for c in range(0, len(i), 65_536):
                one, two = i[c : c + 65_536] + a, j[c : c + 65_536] + b
                ok = (one < two) & ((marks[one] == marks[two]).sum(axis=1) >= AGREE)
                left.append(one[ok])
                right.append(two[ok])
    return np.concatenate(left), np.concatenate(right)


def bucket_forest(root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets (distinct hashes) that span what they connect beyond the given components."""
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(np.concatenate(sets), kind="stable")
    value = np.concatenate(sets)[order]
    at = np.concatenate(([0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]))
    group = np.empty(len(value), np.int64)
    group[order] = np.repeat(np.arange(len(at) - 1), np.diff(at))
    holders, ends, out = owner[order], np.concatenate(([0], np.cumsum(size))), []
    up = {r: r for r in root.tolist()}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    for i in range(len(sets)):
        own = group[ends[i] : ends[i + 1]]
        met = [holders[at[g] : at[g + 1]] for g in own.tolist() if at[g + 1] - at[g] > 1]
        if not met:
            continue
        both = np.bincount(np.concatenate(met), minlength=len(sets))
        both[: i + 1] = 0
        for j in np.flatnonzero(5 * both >= 4 * (size[i] + size - both)).tolist():
            x, y = top(int(root[i])), top(int(root[j]))
            if both[j] and x != y:
                up[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def _buckets(cols: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """(from, to) of each bucket of two and more."""
    h = cols[0].to_numpy()
    edge = np.concatenate(([0], np.flatnonzero(np.diff(h)) + 1, [len(h)])).tolist()
    return ((a, b) for a, b in zip(edge, edge[1:], strict=False) if b - a > 1)


def _compared(rows: DataFrame) -> DataFrame:
    """``rows`` (h, node, root, n, sketch), buckets by h, to pairs (u, v), or for a bucket of many pairs its number as ``crowd``."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in runs(batches):
            h, node, root, n = (c.to_numpy() for c in cols[:4])
            marks = np.frombuffer(b"".join(cols[4].to_pylist()), np.uint8).reshape(len(h), MINIMA)
            for a, b in _buckets(cols):
                i, j = bucket_pairs(n[a:b], root[a:b], marks[a:b])
                crowd = len(i) > PAIRS * (b - a)
                u, v = (node[a : a + 1],) * 2 if crowd else (node[a:b][i], node[a:b][j])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array([int(h[a]) if crowd else None] * len(u), pa.int64())], names=["u", "v", "crowd"])

    return rows.select("h", "node", "root", "n", "sketch").repartition(_parts(rows), "h").sortWithinPartitions("h").mapInArrow(meet, "u long, v long, crowd long")


def _in_crowds(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (h, node, root) of crowded buckets to pairs (u, v) that span the similar ones among their members."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in runs(batches):
            node, root = cols[1].to_numpy(), cols[2].to_numpy()
            for a, b in _buckets(cols):
                found = bucket_forest(root[a:b], [np.frombuffer(x, np.uint64) for x in cols[3].slice(a, b - a).to_pylist()])
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(node[a:b][i]), pa.array(node[a:b][j])], names=["u", "v"])

    whole = rows.join(sets, "node").select("h", "node", "root", "own")
    return materialize(whole.repartition(_parts(rows), "h").sortWithinPartitions("h").mapInArrow(meet, "u long, v long"), "crowds")


def _parts(rows: DataFrame) -> int:
    """Partitions of an exchange of the written table ``rows``: they grow with its counted rows."""
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS)


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) whose sizes and sketches allow them to be similar."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, MINIMA) for i in (2, 3))
            yield b.select(["u", "v"]).filter(pa.array((a == c).sum(axis=1) >= AGREE, pa.bool_()))

    slim = nodes.where("n > 0").select("node", "n", "sketch")
    left, right = (slim.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "uv")
    both = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(left, "u").join(right, "v")
    sized = both.where("5 * least(u_n, v_n) >= 4 * greatest(u_n, v_n)")
    return sized.select("u", "v", "u_sketch", "v_sketch").mapInArrow(hold, "u long, v long")


def _sets(named: DataFrame, texts: DataFrame, hashes: Callable[[bytes | None], np.ndarray]) -> DataFrame:
    """(node, own: its set) of the named nodes, as a written table: only sets that are asked for are made and moved."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [hashes(t).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], names=["node", "own"])

    return materialize(texts.join(named.distinct(), "node", "left_semi").select("node", "text").mapInArrow(whole, "node long, own binary"), "sets", "lz4")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(x), F.col("own").alias(x + "_own")) for x in "uv")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "u_own", "v_own")
    return materialize(both.mapInArrow(hold, "u long, v long"), "similar")


def _met(rows: DataFrame) -> DataFrame:
    """The rows (h, node, ...) of buckets with two members and more, as a written table, with their number ``m``."""
    rows = materialize(rows, "bands")
    several = materialize(rows.groupBy("h").agg(F.count("*").alias("m"), F.min("node").alias("hub")).where("m > 1"), "several")
    return materialize(rows.join(several, "h"), "met")


def _open(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (h, node, m, root) of the buckets that hold several components, as a written table."""
    rooted = materialize(met.select("h", "node", "m").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    several = materialize(rooted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h"), "open")
    return materialize(rooted.join(several, "h", "left_semi"), "mixed")


def components(nodes: DataFrame, texts: DataFrame, hashes: Callable[[bytes | None], np.ndarray], hints: DataFrame) -> DataFrame:
    """(node, root) of every node that is similar to another, with the least node it is connected with.  ``nodes``: a
    written table (node, n: size of its set, bands, sketch).  ``texts`` (node, text) holds each node once.  ``hashes``: text to
    sorted set.  ``hints``: pairs (u, v) of nodes that are likely similar."""
    met = _met(nodes.select("node", F.explode("bands").alias("h")))
    star = met.select(F.col("hub").alias("u"), F.col("node").alias("v"))
    likely = materialize(_likely(hints.select("u", "v").union(star), nodes), "likely")
    ends = lambda p: p.select(F.col("u").alias("node")).union(p.select("v"))
    links = _verified(likely, _sets(ends(likely), texts, hashes))
    roots = materialize(connected_components(links), "roots")

    for level in range(LEVELS + 1):
        mixed = _open(met, roots)
        small = mixed if level == LEVELS else mixed.where(F.col("m") <= DENSE)
        ready = materialize(small.join(nodes.where("n > 0").select("node", "n", "sketch"), "node"), "ready")
        found = materialize(_compared(ready), "pairs")
        pairs = materialize(found.where("crowd is null").select("u", "v").distinct().join(likely, ["u", "v"], "left_anti"), "pairs")
        crowds = materialize(ready.join(found.select(F.col("crowd").alias("h")).where("h is not null"), "h", "left_semi").select("h", "node", "root"), "crowds")
        sets = _sets(ends(pairs).union(crowds.select("node")), texts, hashes)
        links = links.union(_verified(pairs, sets)).union(_in_crowds(crowds, sets))
        large = mixed.where(F.col("m") > DENSE)
        if level == LEVELS or large.isEmpty():
            return connected_components(links)
        again = large.select("h", "node").join(nodes.select("node", F.explode("bands").alias("band")), "node").where("band <> h")
        met = _met(again.select("node", F.xxhash64(F.least("h", "band"), F.greatest("h", "band")).alias("h")).distinct())
    raise AssertionError("the last level returns")
