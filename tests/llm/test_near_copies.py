"""The near-dedup stage of the pipeline against brute force over five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from weftwork.llm import set_similarity


def slow_kept(rows):
    def grams(t):
        w = (t or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks alone
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def rows_of(seed, groups, copies, line):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    boiler = [rnd.choice(vocab) for _ in range(40)]
    out = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([6, 20, 60, 200, 400]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 25))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w + boiler * line))
    texts = [*out, None, "", " \n", "a b", "A  b", "a b c", out[0].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())


def test_stage_against_brute_force(spark):
    rows = rows_of(1, 20, 8, 0)
    assert kept(spark, rows) == slow_kept(rows)


def test_one_large_group_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(set_similarity, "DENSE", 5)  # buckets are dealt again
    monkeypatch.setattr(set_similarity, "PAIRS", 0)
    rows = rows_of(2, 2, 60, 0) + [(1000 + i, t) for i, t in rows_of(3, 8, 5, 1)]
    assert kept(spark, rows) == slow_kept(rows)


def test_forest_of_a_crowd():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.where(rnd.random(60) < rnd.choice([0.02, 0.08, 0.3]), rnd.integers(0, 1 << 62, 60, dtype=np.uint64), base)) for _ in range(80)]
    given = np.arange(80) // 3 * 3

    def comps(edges):
        up = list(range(80))
        for i, j in edges:
            old, new = up[i], up[j]
            up = [new if x == old else x for x in up]
        return len(set(up))

    start = [(i, int(r)) for i, r in enumerate(given)]
    want = [(i, j) for i in range(80) for j in range(i) if set_similarity.similar(sets[i], sets[j])]
    got = set_similarity.bucket_forest(given, sets)
    assert set(map(frozenset, got)) <= set(map(frozenset, want)) and comps(start + got) == comps(start + want) == comps(start) - len(got)
