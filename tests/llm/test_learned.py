"""Learned operators: held-out accuracy, exact statistics, edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftwork.llm import decision_rules as D
from weftwork.llm import language_id as L
from weftwork.llm import quality_ranker as Q
from weftwork.llm import queries
from weftwork.llm.common import fold, table

ODD = [(1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "12 34 !!", "en"), (5, "the cat " * 40_000, "en"), (6, "Überraschung", "de"), (6, "Überraschung", "de"), (None, "le chat", "fr"), (7, "word " * 60, "en")]


def odd(spark):
    return spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, text string, lang string, score string")


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_language_id(spark, sf).join(table(spark, sf, "documents"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_language_edges(spark):
    net = L.fit(odd(spark), F.lit(True))
    rows = L.predict(odd(spark), net).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert all(by[i] == [("und", 0.0)] for i in (1, 2, 3, 4)) and by[6][0] == by[6][1]
    assert all(0 <= s <= 1 for v in by.values() for _, s in v)
    empty = odd(spark).where("false")
    assert L.fit(empty, F.lit(True)) is None and L.predict(empty, None).collect() == []
    assert {r.lang_pred for r in L.predict(odd(spark), None).collect()} == {"und"}


def test_language_pooling_forms_agree():
    rnd = np.random.default_rng(1)
    net = L.train(rnd.integers(97, 122, (40, L.WINDOW)).astype(np.uint8), ["a", "b"] * 20, epochs=1)
    x = rnd.integers(0, 255, (7, L.WINDOW)).astype(np.uint8)
    assert np.allclose(net.pooled(x)[0], net.maxima(x))


def test_numerals_are_no_letters(spark):
    odd_ones = ["½", "²", "①", "Ⅷ", "12 ² ½", "٣", "_", "\u0301"]
    rows = [(i, t) for i, t in enumerate(odd_ones)] + [(50, "ª"), (51, "ʰ"), (52, "日本")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(df, L.fit(odd(spark), F.lit(True))).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(len(odd_ones))) and all(got[i][0] != "und" for i in (50, 51, 52))
    only = spark.createDataFrame([(1, "Ⅷ ½", "xx"), (2, "word", "en")], "doc_id long, text string, lang string")
    assert L.fit(only, F.lit(True)).languages == ["en"]


def naive_prediction(net, text):
    """One text at a time, one window at a time, one filter at a time."""
    raw = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    raw += [32] * (-len(raw) % L.WINDOW)
    total = np.zeros(len(net.languages))
    for at in range(0, len(raw), L.WINDOW):
        own, best = raw[at : at + L.WINDOW], []
        for w, bias in zip(net.filters, net.bias, strict=True):
            for f in range(L.FILTERS):
                best.append(max(0.0, max(sum(float(w[j, own[i + j], f]) for j in range(len(w))) for i in range(L.WINDOW - len(w) + 1)) + float(bias[f])))
        z = np.array(best) @ net.dense + net.offset
        total += z - z.max() - np.log(np.exp(z - z.max()).sum())
    p = np.exp(total / (len(raw) // L.WINDOW))
    return net.languages[int(p.argmax())], float((p / p.sum()).max())


def test_predictions_equal_a_naive_pass(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    net = L.fit(docs, F.lit(True))
    long = " ".join(r.text for r in docs.orderBy("doc_id").limit(4).collect())
    some = docs.orderBy(F.length("text"), "doc_id").limit(25).select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in some] + [(-1, long), (-2, "é"), (-3, "x" * L.WINDOW), (-4, "Y" * (L.WINDOW + 1))]
    for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string"), net).collect():
        text = dict(rows)[r.doc_id]
        if r.lang_pred != "und":
            want = naive_prediction(net, text)
            assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-4


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    rows = got.select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    good = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(good) > 0.95


def slow_score(ranker, text):
    """A quality score from counts made one at a time, and plain sums."""
    text = text or ""
    raw = text.encode()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, c = max(1, len(words)), max(1, len(raw))
    share = lambda chars: sum(text.count(x) for x in chars) / c
    sym, up = share("#*$%&|<>{}[]\\^~_=+@/"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    kinds = len(set(words)) / n
    x = [
        math.log(1 + len(words)), min(len(words), 30) / 30, sym**0.5, sym, up**0.5, up, share("0123456789"), share(".,;:"), share("!?"), share([chr(i) for i in range(32)]),
        kinds, 1 - kinds if len(words) > 20 else 0.0, (again / n) ** 0.5, 1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w.encode()) == 1 for w in words) / n, c / n / 10, float(not words),
    ]
    z = [min(4.0, max(-4.0, (a - m) / s)) for a, m, s in zip(x, ranker.mean, ranker.scale, strict=True)]
    raw_score = sum(a * w for a, w in zip(z + [a * a for a in z], ranker.weights, strict=True))
    return 1 / (1 + math.exp(-min(40.0, max(-40.0, ranker.slope * (raw_score - ranker.threshold) + math.log(0.3 / 0.7)))))


def test_quality_scores_equal_a_naive_pass(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    ranker = queries.quality_of(spark, docs, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op6_quality_classifier(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = slow_score(ranker, texts[r.doc_id])
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.3)
    odd_ones = [None, "", " \n", "A A A", "é" * 200, "# $ %", "word " * 100_000, "one\ntwo\none\n\n"]
    df = spark.createDataFrame(list(enumerate(odd_ones)), "doc_id long, text string")
    for r in Q.score(df, ranker).collect():
        assert abs(r.quality_score - slow_score(ranker, odd_ones[r.doc_id])) < 1e-9


def test_verdicts_of_rules_equal_a_naive_pass(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    rules = D.fit(docs, table(spark, sf, "labels"))
    assert rules
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, sf).collect()}
    assert len(got) == docs.count()
    for d, text in texts.items():
        n, chars, symbols, dup, repeat = slow_statistics(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        x = {
            "symbols per word": symbols / max(n, 1), "characters per word": chars / max(n, 1), "share of words in repeated windows": repeat / max(n, 1),
            "share of repeated lines": dup / max(lines, 1), "share of upper case": sum("A" <= c <= "Z" for c in text or "") / max(chars, 1),
            "share of words like the one before": sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n, 1), "words per line": n / max(lines, 1),
        }
        hit = any(all(x[c.test] > c.limit if c.above else x[c.test] <= c.limit for c in rule) for rule in rules)
        failed = n < 50 or 100 * repeat > 50 * n
        assert (got[d].base_failed, got[d].kept) == (failed, not failed and not hit)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(5, 1), (6, 1), (4, 0), (7, 0), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    ranker = Q.fit(odd(spark), labels, F.lit(True))
    rows = Q.score(odd(spark), ranker, to="score").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert Q.fit(odd(spark), labels.where("false"), F.lit(True)) is None
    assert {r.score for r in Q.score(odd(spark), None, to="score").collect()} == {1.0}
    assert Q.score(odd(spark).where("false"), ranker).collect() == []
    assert Q.accepted(odd(spark), None).columns == odd(spark).columns


def test_pairs_order_the_scores():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(400, Q.FEATURES))
    y = (x[:, 0] - x[:, 3] + rnd.normal(0, 0.1, 400) > -1).astype(int)
    r = Q.train(x, y)
    s = r.score(x)
    assert ((s >= Q.AT) == y).mean() > 0.9 and abs((s < Q.AT).mean() - (y == 0).mean()) < 0.02


def test_weights_are_the_minimum_over_all_pairs():
    """Against the list of all pairs; scores of the second setting span many panels."""
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(500, Q.FEATURES))
    x[400:] = x[:100]  # ties
    y = (x[:, 0] - x[:, 3] + rnd.normal(0, 0.1, 500) > -1).astype(int)
    y[400:] = y[:100]
    for l2 in (1e-3, 1e-6):
        r = Q.train(x, y, l2=l2)
        s, z = r.raw(x), Q._wide(x, x.mean(axis=0), x.std(axis=0) + 1e-6)
        lost = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None]))
        slope = (z[y == 0].T @ lost.sum(axis=0) - z[y == 1].T @ lost.sum(axis=1)) / lost.size + l2 * r.weights
        assert np.abs(slope).max() < 1e-11
        assert abs(r.threshold - np.quantile(s, (y == 0).mean())) < 1e-12
        assert l2 == 1e-3 or np.ptp(s) > 40


def test_quality_learns_from_every_labelled_row(spark):
    """7000 labels and four documents of each: all 28,000 are in the mean, and the ranker is that of all rows at hand."""
    def text(i):
        return " ".join(f"w{i % 7}{j}" if i % 3 else "A #" for j in range(1 + i * 7919 % 13)) + "!" * (i % 5)

    docs = spark.range(7000).collect()
    docs = spark.createDataFrame([(r.id, text(r.id + 7000 * k)) for r in docs for k in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i * 31 % 100 < 60 + 30 * (i % 3 > 0))) for i in range(7000)], "doc_id long, quality int")
    rows = docs.join(labels, "doc_id").collect()
    x, y = Q.feature_rows([r.text.encode() for r in rows]), np.array([r.quality for r in rows])
    got, want = Q.fit(docs, labels, F.lit(True)), Q.train(x, y)
    assert len(rows) == 28_000 and np.allclose(got.mean, x.mean(axis=0), rtol=1e-12, atol=1e-12)
    assert np.allclose(got.weights, want.weights, atol=1e-9) and abs(got.slope - want.slope) < 1e-9
    assert abs(got.threshold - np.quantile(want.raw(x), (y == 0).mean())) < 1e-9


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, repeat = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            repeat.update((i, i + 1, i + 2))
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


def test_statistics():
    rnd = random.Random(6)
    bits = ["a", "b", "é", "中", " ", "\n", "\t", "#", "|", "A", "\u00a0", "\x0b", "\n\n", "a b c "]
    for _ in range(300):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))
        assert D.statistics(text.encode())[:5] == slow_statistics(text)
    assert D.statistics(None)[:5] == (0, 0, 0, 0, 0)


def test_rules(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98
    for r in queries.op9_quality_rules(spark, "/root/testdata/sf0.001").join(table(spark, "/root/testdata/sf0.001", "documents"), "doc_id").collect():
        want = slow_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_rule_learning():
    rnd = np.random.default_rng(8)
    x = {"symbols per word": rnd.random(600), "words per line": rnd.random(600)}
    bad = ((x["symbols per word"] > 0.8) & (x["words per line"] <= 0.5)) | (x["words per line"] > 0.9)
    rules = D.learn(x, bad)
    hit = np.zeros(600, bool)
    for rule in rules:
        hit |= D.covers(rule, x)
    assert (hit == bad).mean() > 0.95
    assert D.learn(x, np.zeros(600, bool)) == []


def test_rules_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert D.fit(odd(spark), labels) == []
    rows = {r.doc_id: r for r in D.judge(odd(spark), []).collect()}
    assert rows[1].base_failed and not rows[5].kept and D.judge(odd(spark).where("false"), []).collect() == []


def test_folds(spark):
    import zlib

    got = [r[0] for r in spark.range(50).select(fold(F.col("id"), 4)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]
