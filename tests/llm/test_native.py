"""Decontamination and mixing against brute force, and their plans."""

import hashlib
import random
import re
from fractions import Fraction

from weftwork.llm import decontamination as C
from weftwork.llm import mixing as M


def words(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def shingles(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def rows_of(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rnd.choice([1, 3, 5, 6, 12, 30, 45])))) for i in range(30)] + [(90, None), (91, "..."), (92, ""), (93, "One, two?")]
    docs = []
    for i in range(120):
        w = say(rnd.randint(0, 150))
        if i % 2:
            own = words(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, 3)):
                if own:
                    own[rnd.randrange(len(own))] = "changed"
            w[len(w) // 2 : len(w) // 2] = own
        docs.append((i // 2 * 2 if i % 9 == 0 else i, (", " if i % 3 else " ").join(w).title()))
    return docs + [(None, docs[1][1]), (500, None), (501, ""), (502, "x one TWO y"), (1, docs[1][1])], items


def test_contained(spark, monkeypatch):
    docs, items = rows_of(1)
    want = set()
    for d, t in docs:
        for i, q in items:
            w = words(q)
            n = min(5, len(w))
            if n:
                own = shingles(w, n)
                shared = len(own & shingles(words(t), n))
                if shared * 5 >= len(own) * 4:
                    want.add((d, i, len(own), shared))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in C.contained(df, it).collect()} == want
    bad = {(d, t) for d, t in docs if any(d == w[0] and t and True for w in want)}
    left = C.clean(df, it)
    assert left.columns == df.columns
    kept = [tuple(r) for r in left.collect()]
    hit = {(d, t) for d, t in docs for i, q in items if (n := min(5, len(words(q)))) and len(shingles(words(q), n) & shingles(words(t), n)) * 5 >= len(shingles(words(q), n)) * 4}
    assert sorted(kept, key=str) == sorted([x for x in docs if x not in hit], key=str) and bad
    for name, value in (("BITMAP_LONGS", 64), ("BROADCAST_ROWS", 0), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(C, name, value)
        assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in C.contained(df, it).collect()} == want, name


def test_contained_empty(spark):
    none, it = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert C.contained(none, it).collect() == []
    assert C.clean(it.withColumnRenamed("item_id", "doc_id"), none.withColumnRenamed("doc_id", "item_id")).count() == 1


def test_items_without_or_with_shared_id(spark):
    long = "a b c d e f g h i j k l m n"
    items = spark.createDataFrame([(None, "p q r s t u v"), (None, long), (7, long), (7, "lone word")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x p q r s t u v y"), (2, "only a lone word here"), (3, f"x {long}"), (4, "none of it")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in C.contained(docs, items).collect()), key=str)
    assert got == [(1, None, 3, 3), (2, 7, 1, 1), (3, 7, 10, 10), (3, None, 10, 10)]
    assert [r.doc_id for r in C.clean(docs, items).collect()] == [4]


def fill(amount, kids):
    """kids: name -> (cap, weight); exact, each rounded down."""
    live, out, left = {k for k, (_, w) in kids.items() if w}, dict.fromkeys(kids, 0), amount
    while live:
        total = sum(kids[k][1] for k in live)
        full = {k for k in live if kids[k][0] <= Fraction(left * kids[k][1], total)}
        if not full:
            for k in live:
                out[k] = left * kids[k][1] // total
            break
        first = min(full, key=lambda k: (Fraction(kids[k][0], kids[k][1]), k))
        out[first] = kids[first][0]
        left -= kids[first][0]
        live.discard(first)
    return out


def slow_mix(docs, weights, percent, epochs, seed):
    leaf = {}
    for d, t, lang, src in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        num = re.search(r"\d{1,9}", src or "")
        key = (f"domain{int(num[0]) % 4}" if num else "other", lang or "none", src or "none")
        leaf.setdefault(key, []).append((d, n))
    leaf = {k: v for k, v in leaf.items() if sum(n for _, n in v)}
    weight = lambda *p: weights.get("/".join(p), 1)
    cap3 = {k: sum(n for _, n in v) * epochs * bool(weight(*k)) for k, v in leaf.items()}
    cap2, cap1 = {}, {}
    for k, c in cap3.items():
        cap2[k[:2]] = cap2.get(k[:2], 0) + c * bool(weight(*k[:2]))
    for k, c in cap2.items():
        cap1[k[:1]] = cap1.get(k[:1], 0) + c * bool(weight(*k[:1]))
    total = sum(n for v in leaf.values() for _, n in v) * percent // 100
    q1 = fill(total, {k: (c, weight(*k)) for k, c in cap1.items()})
    q2 = {}
    for p, a in q1.items():
        q2 |= fill(a, {k: (c, weight(*k)) for k, c in cap2.items() if k[:1] == p})
    q3 = {}
    for p, a in q2.items():
        q3 |= fill(a, {k: (c, weight(*k)) for k, c in cap3.items() if k[:2] == p})
    out = []
    for k, v in leaf.items():
        t = sum(n for _, n in v)
        e, rest = divmod(q3[k], t)
        order = lambda d: hashlib.md5(":".join([str(seed), str(e), *([] if d is None else [str(d)])]).encode()).hexdigest()  # noqa: E731,B023
        for d, n in v:
            upto = sum(m for x, m in v if order(x) <= order(d))
            if n and e + (upto <= rest):
                out.append((d, k[0], n, e + (upto <= rest)))
    return sorted(out, key=str), q3


def test_mix(spark, monkeypatch):
    rnd = random.Random(3)
    docs = [(i, " ".join("w" * 1 for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de", None]), rnd.choice(["src1", "src1", "src1", "src2", "src3", "web", None])) for i in range(400)]
    docs += [(7, "a b c", "en", "src1"), (7, "a b c", "en", "src1"), (None, "x y", "en", "src2"), (801, None, "en", "src9")]
    weights = {"domain1": 6, "domain2": 1, "domain3": 0, "domain1/en": 3, "other/de": 5, "domain2/en/src2": 9}
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, source string, n_copies string")
    docs += [(7, "a b c", "en", "src1")] * 6
    df = df.union(spark.createDataFrame([(*d, "clash") for d in docs[-6:]], df.schema))
    for percent, epochs, rows in ((40, 1, 100_000), (100, 2, 100_000), (300, 2, 3), (0, 2, 3), (40, 1, 1), (75, 1, 3)):
        monkeypatch.setattr(M, "CUT_ROWS", rows)  # few rows: buckets are dealt again
        got = sorted([(r.doc_id, r.mix_domain, r.n_tokens, r.n_copies) for r in M.mix(df, weights, percent, epochs, 5).collect()], key=str)
        want, quota = slow_mix(docs, weights, percent, epochs, 5)
        assert got == want, (percent, epochs)
        assert not any(k[0] == "domain3" and q for k, q in quota.items())
    assert M.mix(df.where("false"), weights, 50).collect() == []


def test_native_plans(spark):
    docs, items = rows_of(2)
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for out in (C.clean(df, it), M.mix(df.selectExpr("*", "cast(doc_id % 3 as string) lang", "concat('s', doc_id % 5) source"), {}, 50)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
