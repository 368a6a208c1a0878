"""SimHash near-dedup with deletion-variant signatures.

A document's fingerprint has bit i where over half of its 4-word shingles have bit i in their XXH64.  Two fingerprints
link at 4 or fewer differing bits.  Cut into 3 segments, two such fingerprints have a segment that differs by at most
one bit (4 bits over 3 segments leave one with 4 // 3 = 1), so they share the variant of that segment in which the
differing bit is a wildcard.  Each distinct fingerprint is indexed under its 64 one-wildcard variants, equal variants
meet, and the pairs are verified.

Only distinct fingerprints are indexed, so thousands of exact copies are one entry.  A bucket of equal variants emits
a spanning forest of its verified links, never all its pairs, which leaves the components as they are.  Buckets that may
hold more than ``DENSE`` fingerprints are found by counting, and dealt again before anything gathers them: their rows are
indexed by the same rule over their other bits, under (variant, variant of a piece of the other bits).  What is still
larger than that is indexed a third time, in its task.

Defined results: null and blank texts have fingerprint zero and link like others; rows with a null ``doc_id`` take
part, and the component's id is the smallest id that is not null (null if there is none); repeated rows share
fingerprint and component; a very long text is read whole, its shingles hashed in parts; a bit set in exactly half of the
shingles is 0; columns named like one that is added for the work are dropped, others are kept or not looked at; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.common import materialize, quoted, without
from weftwork.llm.components import connected_components
from weftwork.llm.set_similarity import components, sketch

SHINGLE = 4
MOST_BITS = 4
SEGMENTS = 3
SEED = 42
DENSE = 16_384
#: Fingerprints for each task of the exchange of variants (64 rows each).
TASK_FINGERPRINTS = 20_000
FP, UID, KEY, SIZE, BAND, MARK = "simhash_bits", "simhash_row", "simhash_key", "simhash_size", "simhash_band", "simhash_mark"


def _words(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def _hashes(words: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of ``words`` (not empty), in parts."""
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    n = len(gaps) + 1
    start = np.concatenate(([0], gaps + 1))[: max(1, n - shingle + 1)].tolist()
    end = np.concatenate((gaps, [len(words)]))[min(shingle, n) - 1 :].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(words)
    for a in range(0, len(start), 16_384):
        yield np.array([digest(view[i:j], SEED) for i, j in zip(start[a : a + 16_384], end[a : a + 16_384], strict=True)], np.uint64)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; none for a blank text."""
    words = _words(text)
    return np.unique(np.concatenate(list(_hashes(words, shingle)))) if words else np.zeros(0, np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = _words(text)
    return _majority(_hashes(words, shingle)) if words else 0


def _majority(hashes: Iterable[np.ndarray]) -> int:
    counts, m = np.zeros(64, np.int64), 0
    for h in hashes:
        m += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view(np.int64)[0])


def add_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, sketches: bool = False) -> DataFrame:
    """``docs`` with ``simhash_bits`` and ``simhash_row`` (a number of its own for each row), as a written table; with
    ``sketches`` also ``simhash_key`` (128-bit hash of the words), ``simhash_size`` (distinct shingles) and their sketch."""
    added = {FP: "long"} | ({KEY: "binary", SIZE: "int", BAND: "array<long>", MARK: "binary"} if sketches else {})
    docs = without(docs, UID, *added).select("*", F.monotonically_increasing_id().alias(UID))
    at = docs.columns.index(text)

    def of(raw: bytes | None) -> tuple:
        words = _words(raw)
        hashes = np.concatenate(list(_hashes(words, shingle))) if words else np.zeros(0, np.uint64)
        own = np.unique(hashes)
        return _majority([hashes]) if words else 0, xxhash.xxh3_128_digest(words), len(own), *sketch(own)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            own = b.column(at).cast(pa.binary()).to_pylist()
            rows = [of(x) for x in own] if sketches else [(fingerprint(x, shingle),) for x in own]
            new = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in added.items())).fields])
    return materialize(docs.mapInArrow(tag, schema), "simhash")


def _segments(bits: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of near-equal segments."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fp: str, parts: int = SEGMENTS) -> list:
    """The one-wildcard variants of each segment: segment, wildcard and masked bits packed in an int."""
    out = []
    for s, (at, width) in enumerate(_segments(64, parts)):
        part = F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        for b in range(width):
            out.append(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << b))).bitwiseOR(F.lit(s << 27 | b << 22)))
    return out


def _flat(up: np.ndarray) -> np.ndarray:
    """The root of every node."""
    while True:
        over = up[up]
        if (over == up).all():
            return up
        up = over


def forest(fps: np.ndarray, ids: np.ndarray, up: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links of ``fps[ids]`` under ``most`` differing bits that join trees of ``up`` (parents, changed in place).  All are
    compared, in blocks, but blocks whose members are all in one tree are passed over."""
    out: list[tuple[int, int]] = []
    for a in range(0, len(ids), 512):
        one = ids[a : a + 512]
        for b in range(a, len(ids), 4096):
            two = ids[b : b + 4096]
            up[:] = _flat(up)
            if (up[one] == up[one[0]]).all() and (up[two] == up[one[0]]).all():
                continue
            i, j = np.nonzero((np.bitwise_count(fps[one][:, None] ^ fps[two][None, :]) <= most) & (up[one][:, None] != up[two][None, :]))
            pair = np.unique(up[one[i]] * len(up) + up[two[j]], return_index=True)[1]
            for x, y in zip(one[i[pair]].tolist(), two[j[pair]].tolist(), strict=True):
                rx, ry = x, y
                while up[rx] != rx:
                    rx = up[rx]
                while up[ry] != ry:
                    ry = up[ry]
                if rx != ry:
                    up[max(rx, ry)] = min(rx, ry)
                    out.append((x, y))
    return out


def crowded_variants(fps: DataFrame, parts: int = SEGMENTS, dense: int = DENSE) -> DataFrame | None:
    """(variant, again), a written table: ``again`` marks variants whose bucket holds more than ``dense`` fingerprints, the
    others need no bucket.  None if no segment has a value that occurs more than dense / 2 times.

    A bucket is fed by two values of its segment, which differ in the wildcard.  Where one of them does not occur, all its
    members have equal segments and meet under the segment's first wildcard as well, so the other buckets are needless."""
    value = [F.lit(s << 27).bitwiseOR(F.shiftrightunsigned(F.col(FP), at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")) for s, (at, width) in enumerate(_segments(64, parts))]
    values = materialize(fps.select(F.explode(F.array(*value)).alias("value")).groupBy("value").agg(F.count("*").alias("n")), "values")
    often = values.where(F.col("n") > dense // 2)
    if not often.take(1):
        return None
    bit = F.call_function("shiftleft", F.lit(1), F.col("b"))
    wild = often.select("value", "n", F.explode(F.sequence(F.lit(0), F.lit(-(-64 // parts) - 1))).alias("b")).withColumn("other", F.col("value").bitwiseXOR(bit))
    both = wild.join(values.select(F.col("value").alias("other"), F.col("n").alias("n_other")), "other", "left")
    variant = F.col("value").bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.call_function("shiftleft", F.col("b"), F.lit(22)))
    needless = (F.col("b") > 0) & F.col("n_other").isNull()
    again = ~needless & (F.col("n") + F.coalesce("n_other", F.lit(0)) > dense)
    return materialize(both.where(needless | again).select(variant.alias("variant"), again.alias("again")).distinct(), "crowded")


def _pieces(segment: int, parts: int) -> list[np.ndarray]:
    """The bits outside a segment, in near-equal pieces."""
    return np.array_split(np.concatenate([np.arange(a, a + w) for i, (a, w) in enumerate(_segments(64, parts)) if i != segment]), parts)


def _dealt_again(keyed: DataFrame, parts: int) -> DataFrame:
    """Rows of crowded variants under the one-wildcard variants of the pieces of their other bits: (simhash_bits, variant,
    bit, part), where ``bit`` is the wildcard and ``part`` the rest of its piece."""
    out = None
    for s in range(parts):
        again = []
        for piece in _pieces(s, parts):
            mask = sum(1 << int(b) for b in piece)
            for b in piece.tolist():
                keep = mask & ~(1 << b)
                again.append(F.struct(F.lit(b).alias("bit"), F.col(FP).bitwiseAND(F.lit(keep - (1 << 64) if keep >> 63 else keep).cast("long")).alias("part")))
        own = keyed.where(F.shiftright("variant", 27) == s).select(FP, "variant", F.explode(F.array(*again)).alias("x")).select(FP, "variant", "x.*")
        out = own if out is None else out.union(own)
    return out


def links(fps: DataFrame, most: int = MOST_BITS, parts: int = SEGMENTS, dense: int = DENSE) -> DataFrame:
    """``fps`` (simhash_bits, distinct) to verified links (u, v) that span the components."""
    if most // parts > 1 or not 3 <= parts <= 16:
        raise ValueError(f"{parts} segments do not hold {most} bits with one at most in one of them")
    keyed = fps.select(FP, F.explode(F.array(*variants(FP, parts))).alias("variant"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            own = [c.to_numpy() for c in b.columns]
            own = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            starts = _starts(own[1:])
            cut = int(starts[-1]) if len(starts) else 0  # the last key may go on in the next batch
            yield from _bucket_links([c[:cut] for c in own], most, parts, dense)
            rest = [c[cut:] for c in own]
        if rest is not None:
            yield from _bucket_links(rest, most, parts, dense)

    def met(rows: DataFrame, n_rows: int) -> DataFrame:
        n, keys = max(least, n_rows // (64 * TASK_FINGERPRINTS)), rows.columns[1:]
        return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(meet, "u long, v long")

    least, n_fps = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), fps.count()
    crowded = crowded_variants(fps, parts, dense) if n_fps > dense else None
    if crowded is None:
        return met(keyed, 64 * n_fps)
    again = materialize(keyed.join(crowded.where("again"), "variant", "left_semi").select(FP, "variant"), "dense")
    few = keyed.join(crowded, "variant", "left_anti").select(FP, "variant")
    return met(few, 64 * n_fps).union(met(_dealt_again(again, parts), 64 * again.count()))


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _bucket_links(rows: list[np.ndarray], most: int, parts: int, dense: int) -> Iterator[pa.RecordBatch]:
    """rows: fingerprints, then their sorted keys: the variant, and of crowded ones the wildcard and part of a piece."""
    f, keys = rows[0], rows[1:]
    if len(f) < 2:
        return
    edge = np.append(_starts(keys), len(f))
    size = np.diff(edge)
    two = edge[:-1][size == 2]
    a, b = f[two], f[two + 1]
    ok = np.bitwise_count((a ^ b).view(np.uint64)) <= most
    us, vs = [a[ok]], [b[ok]]
    for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        own = f[at : at + n].view(np.uint64)
        pieces = _pieces(int(keys[0][at]) >> 27, parts)
        left = np.concatenate([p for p in pieces if len(keys) == 1 or int(keys[1][at]) not in p])
        found = bucket_forest(own, left, dense, most, parts)
        if found:
            i, j = np.array(found).T
            us.append(own[i].view(np.int64))
            vs.append(own[j].view(np.int64))
    u, v = np.concatenate(us), np.concatenate(vs)
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def bucket_forest(fps: np.ndarray, left: np.ndarray, dense: int = DENSE, most: int = MOST_BITS, parts: int = SEGMENTS) -> list[tuple[int, int]]:
    """Links that span the components of a bucket.  More than ``dense`` members are indexed again: they may differ by
    ``most`` of the bits ``left``, so of ``parts`` near-equal pieces of those bits one differs by at most one bit."""
    up, out = np.arange(len(fps)), []
    if len(fps) <= dense:
        return forest(fps, up.copy(), up, most)
    for piece in np.array_split(left, parts):
        seg = np.zeros(len(fps), np.uint64)
        for i, bit in enumerate(piece):
            seg |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)
        for i in range(len(piece)):
            key = seg & ~(np.uint64(1) << np.uint64(i))
            order = np.argsort(key, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(run) > 1:
                    out += forest(fps, run, up, most)
    return out


def roots(tagged: DataFrame) -> DataFrame:
    """(simhash_bits, root): every fingerprint of two or more that are connected, with its component's least one."""
    found = connected_components(links(materialize(tagged.select(FP).distinct(), "fingerprints")))
    return found.select(F.col("node").alias(FP), "root")


def _grouped(tagged: DataFrame, *columns: str) -> DataFrame:
    slim = tagged.select(*columns, FP)
    return slim.join(materialize(roots(tagged), "roots"), FP, "left").withColumn("root", F.coalesce("root", FP))


def near_duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach), a row for each row."""
    tagged = add_fingerprints(docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")))
    rows = _grouped(tagged, "doc_id")
    # a table of its own: a join on the exchange of its aggregation could not be split where one group is large
    least = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    return rows.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex(FP), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The row with the smallest ``doc_id`` of each component (null last, any one of rows that tie), all columns kept."""
    tagged = add_fingerprints(docs, text)
    rows = _grouped(tagged, UID, doc_id)
    kept = rows.groupBy("root").agg(F.min(F.struct(quoted(doc_id).isNull(), quoted(doc_id), F.col(UID)))[UID].alias(UID))
    return tagged.join(kept, UID, "left_semi").drop(FP, UID)


def keep_one_of_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, most: int = 7, parts: int = 4) -> DataFrame:
    """The row with the smallest ``doc_id`` (null last, any one of rows that tie) of each component of texts whose sets of
    shingles have a Jaccard similarity of 0.8 or more, all columns kept.

    The similarity decides, not the fingerprint: links of fingerprints are verified by it.  Pairs that differ in more than
    ``most`` bits (at similarity 0.8 about ten do, which no split of 64 bits finds without comparing all with all) come
    from the bands of ``set_similarity``, verified likewise.  Blank texts are alike."""
    added = (FP, UID, KEY, SIZE, BAND, MARK)
    tagged = add_fingerprints(docs, text, shingle, sketches=True)
    least = tagged.groupBy(KEY).agg(F.min(F.struct(*(F.col(c) for c in (UID, FP, SIZE, BAND, MARK)))).alias("x"))
    nodes = materialize(least.select(KEY, F.col(f"x.{UID}").alias("node"), F.col(f"x.{FP}").alias(FP), F.col(f"x.{SIZE}").alias("n"), F.col(f"x.{BAND}").alias("bands"), F.col(f"x.{MARK}").alias("sketch")), "nodes")

    # of each fingerprint one node, linked with its other nodes and with those of linked fingerprints
    one = materialize(nodes.groupBy(FP).agg(F.min("node").alias("first")), "firsts")
    own = nodes.select(FP, "node").join(one, FP).select(F.col("first").alias("u"), F.col("node").alias("v")).where("u <> v")
    far = links(one.select(FP), most, parts)
    near = far.join(one.select(F.col(FP).alias("u"), F.col("first").alias("a")), "u").join(one.select(F.col(FP).alias("v"), F.col("first").alias("b")), "v")
    hints = own.union(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    texts = tagged.select(F.col(UID).alias("node"), quoted(text).alias("text"))
    found = components(nodes.select("node", "n", "bands", "sketch"), texts, lambda t: shingle_set(t, shingle), hints)

    root = materialize(nodes.select(KEY, "node").join(found, "node", "left").select(KEY, F.coalesce("root", "node").alias("root")), "roots")
    rows = tagged.select(UID, quoted(doc_id), KEY).join(root, KEY)
    kept = rows.groupBy("root").agg(F.min(F.struct(quoted(doc_id).isNull(), quoted(doc_id), F.col(UID)))[UID].alias(UID))
    return tagged.join(kept, UID, "left_semi").drop(*added)
