"""SimHash fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import xxhash

from weftwork.llm.components import connected_components
from weftwork.llm.simhash import DENSE, FP, bucket_forest, crowded_variants, fingerprint, forest, keep_one_of_each_group, links, near_duplicate_groups


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def rows_of(seed, n=150):
    rnd = random.Random(seed)
    vocab = [f"w{i}É" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(60, 400))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "A b"), (203, "a B"), (None, "a b"), (3, rows[5][1]), (None, "só um")]
    rnd.shuffle(rows)
    return rows


def test_fingerprint():
    for _, t in rows_of(0, 20):
        assert fingerprint(None if t is None else t.encode()) & (1 << 64) - 1 == slow_fingerprint(t)


def test_groups(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted([tuple(r) for r in near_duplicate_groups(df).collect()], key=str)
    want = slow_groups(rows)
    assert got == want
    kept = keep_one_of_each_group(df).collect()
    comps = {w[2] for w in want if w[2] is not None}
    assert {r.doc_id for r in kept if r.doc_id is not None} == comps


def test_dense_bucket_keeps_components():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 62, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rnd.integers(0, 42, 30).astype(np.uint64)) for _ in range(60)]))
    low = fps & np.uint64((1 << 42) - 1)  # as in a bucket: the third segment is equal

    def parts(edges):
        up = list(range(len(low)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in edges:
            up[root(i)] = root(j)
        return len({root(i) for i in range(len(low))})

    left = np.arange(42)
    assert parts(bucket_forest(low, left, 4)) == parts(bucket_forest(low, left, 10_000))


def components_of(fps, edges):
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for u, v in edges:
        u, v = root(at[u]), root(at[v])
        up[max(u, v)] = min(u, v)
    return [root(i) for i in range(len(fps))]


def crowd(seed, n, fixed):
    """Fingerprints that share their low ``fixed`` bits; many are near others."""
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 1 << 63, n // 3, dtype=np.uint64) * np.uint64(2)
    flips = [np.uint64(1) << rnd.integers(0, 64, len(base)).astype(np.uint64) for _ in range(5)]
    all_ = np.concatenate([base, base ^ flips[0] ^ flips[1] ^ flips[2], base ^ flips[1] ^ flips[2] ^ flips[3] ^ flips[4]])
    return np.unique(all_ & ~np.uint64((1 << fixed) - 1) | np.uint64(12345))


def check_links(spark, fps, most, parts, dense):
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], f"{FP} long")
    assert crowded_variants(df, parts, dense) is not None
    got = [(r.u, r.v) for r in links(df, most, parts, dense).collect()]
    signed = fps.view(np.int64)
    want = [(int(signed[i]), int(signed[j])) for i, j in forest(fps, np.arange(len(fps)), np.arange(len(fps)), most)]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= most for u, v in got)
    assert components_of(fps, got) == components_of(fps, want)


def test_crowded_variants_are_dealt_again(spark):
    check_links(spark, crowd(1, 2 * DENSE, 21), 4, 3, DENSE)
    check_links(spark, crowd(2, 3000, 21), 4, 3, 50)
    check_links(spark, crowd(3, 3000, 36), 4, 3, 50)  # crowded in the second dealing, too
    check_links(spark, crowd(4, 3000, 16), 7, 4, 50)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_long_texts_and_clashing_names(spark):
    long = "alpha beta gamma " * 60_000
    rows = [(1, long, "x"), (2, long + "delta", "y"), (3, "other words stand here", "z"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, simhash_bits string").withColumnRenamed("simhash_bits", "SimHash_Bits")
    got = sorted([tuple(r) for r in near_duplicate_groups(df).collect()])
    assert got == slow_groups([r[:2] for r in rows])
    assert {r.doc_id for r in keep_one_of_each_group(df).collect()} == {g[2] for g in got}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_groups(df).collect() == [] and keep_one_of_each_group(df).collect() == []
