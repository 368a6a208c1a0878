"""The stages of the corpus pipeline, one on the other."""

import corpus_pipeline
import regex
from test_learned import slow_score
from test_native import slow_mix
from test_near_copies import slow_kept
from weftwork.llm import queries
from weftwork.llm.common import table

SF = "/root/testdata/sf0.001"


def slow_passages(rows):
    """(doc_id, text) less each byte under a 100-byte string that starts earlier; whole characters only."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        raw = text.encode()
        gone = [False] * (len(raw) + 1)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(raw[i : i + 100])
        at, kept = 0, []
        for c in text:  # a character goes if all its bytes do
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[d] = "".join(kept)
    return out


def slow_clean(rows, items):
    def words(t):
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]

    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    wanted = [(min(5, len(w)), grams(w, min(5, len(w)))) for w in map(words, items) if w]
    out = set()
    for d, text in rows:
        w = words(text)
        own = {n: grams(w, n) for n in range(1, 6)}
        if not any(5 * len(g & own[n]) >= 4 * len(g) for n, g in wanted):
            out.add(d)
    return out


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept, row for row; the fixture has copies, repeats and benchmark passages."""
    docs = table(spark, SF, "documents")
    ranker = queries.quality_of(spark, docs, SF)
    given = docs.collect()
    assert len({r.doc_id for r in given}) == len(given)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "stage")
        kept.append({r.doc_id: r for r in docs.collect()})
    quality, single, passages, clean = kept

    scores = {r.doc_id: slow_score(ranker, r.text) for r in given}
    assert set(quality) == {d for d, s in scores.items() if s >= 0.3} and len(quality) < len(given)
    assert all(tuple(quality[r.doc_id]) == tuple(r) for r in given if r.doc_id in quality)

    assert sorted(single) == slow_kept([(d, r.text) for d, r in quality.items()]) and len(single) < len(quality)

    want = slow_passages([(d, r.text) for d, r in single.items()])
    assert {d: r.text for d, r in passages.items()} == want and any(want[d] != r.text for d, r in single.items())
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (single[d].lang, single[d].source) for d, r in passages.items())

    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert set(clean) == slow_clean(want.items(), items) and len(clean) < len(passages)
    assert all(tuple(clean[d]) == tuple(passages[d]) for d in clean)

    rows = [(d, r.text, r.lang, r.source) for d, r in clean.items()]
    mix, _ = slow_mix(rows, queries.MIX_WEIGHTS, 80, queries.MIX_EPOCHS, queries.MIX_SEED)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted([(r.doc_id, r.mix_domain, r.n_tokens, r.n_copies) for r in last], key=str) == mix
    assert sorted([(r.doc_id, r.n_copies) for r in corpus_pipeline.run(spark, SF).collect()]) == sorted([(r.doc_id, r.n_copies) for r in last])


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, null ids, an extra column and an empty table."""
    long = "the cat sat on the mat " * 20_000
    rows = [(None, None, None, None, None), (1, "", "en", "s1", 0), (1, "x", None, None, 1), (2, "the cat sat on the mat " * 30, "en", "s2", 1), (2, "the cat sat on the mat " * 30, "en", "s2", 1), (5, long, "en", "s1", len(long))]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, quality_score string")
    stages = dict(corpus_pipeline.STAGES)
    for d in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.materialize(stage(spark, d, SF), "odd")
            assert out.columns == docs.columns and out.count() <= d.count()
            d = out
        assert stages["mixing to target weights"](spark, d, SF).count() <= d.count()
    alike = stages["SimHash near-dedup"](spark, docs, SF).collect()
    # blank texts are alike, equal rows are one, and so is a text whose set of shingles equals a longer one's
    assert sorted((r.doc_id, len(r.text or "")) for r in alike) == [(1, 0), (1, 1), (2, 690)]
    cut = stages["suffix-array dedup"](spark, docs, SF).collect()
    assert len(cut) == len(rows) and {r.quality_score for r in cut} == {"clash"}
    assert sorted(len(r.text) for r in cut if r.doc_id == 2)[0] < 100 and [r.text for r in cut if r.doc_id is None] == [None]
    assert stages["benchmark decontamination"](spark, docs, SF).count() == len(rows)
    taken = stages["mixing to target weights"](spark, docs, SF).collect()
    assert all(r.n_tokens > 0 for r in taken)
