"""Both repeat operators against brute force over windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from weftwork.llm import _repeats as R
from weftwork.llm import substring_dedup, suffix_repeats
from weftwork.llm.substring_dedup import copied_words_digest, remove_copied_words
from weftwork.llm.suffix_repeats import lcp_intervals, remove_repeats, repeat_digest


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passages = [say(k) for k in (12, 13, 14, 30, 80)]
    out = []
    for i in range(n):
        kind = rnd.randint(0, 5)
        text = say(rnd.randint(0, 90))
        if kind == 0 and out:
            text = rnd.choice(out)[1] or ""
        elif kind == 1 and out:
            w = (rnd.choice(out)[1] or "").split()
            for _ in range(2):
                if w:
                    w[rnd.randrange(len(w))] = "changed"
            text = "\n".join([" ".join(w), say(3)])
        elif kind in (2, 3):
            text = say(rnd.randint(0, 9)) + "  " + rnd.choice(passages) + "\t" + say(rnd.randint(0, 9))
        elif kind == 4:
            text = "ab " * rnd.randint(0, 200)
        out.append((i * 3 % n if i % 7 else i, text))
    out += [(None, passages[4]), (5, None), (6, ""), (7, "x"), (4, passages[3] * 3)]
    rnd.shuffle(out)
    return out


def brute_words(rows, w=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [R.LAST if i is None else i for i, _ in rows]
    least = {}
    for i, words in zip(ids, split, strict=True):
        for a in range(len(words) - w + 1):
            k = tuple(words[a : a + w])
            least[k] = min(least.get(k, i), i)
    out = []
    for (doc, _), i, words in zip(rows, ids, split, strict=True):
        gone = set()
        for a in range(len(words) - w + 1):
            if least[tuple(words[a : a + w])] < i:
                gone.update(range(a, a + w))
        kept = [x for a, x in enumerate(words) if a not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, w=100):
    rows = sorted(rows, key=lambda r: R.LAST if r[0] is None else r[0])
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for a in range(len(raw) - w + 1):
            if raw[a : a + w] in seen:
                cover[a : a + w] = b"\1" * w
            seen.add(raw[a : a + w])
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        out.append((doc, len(raw), len(raw) - len(kept), sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [1, 2, 512])
def test_words(spark, seed, hot):
    rows = corpus(seed)
    got = sorted([tuple(r) for r in copied_words_digest(frame(spark, rows), hot=hot).collect()], key=str)
    assert got == brute_words(rows)


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("hot", [1, 2, 512])
def test_bytes(spark, seed, hot):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(seed))]
    got = sorted([tuple(r) for r in repeat_digest(frame(spark, rows), hot=hot).collect()], key=str)
    assert got == brute_bytes(rows)


def test_long_row_in_pieces(monkeypatch):
    rnd = random.Random(5)
    from weftwork.llm.suffix_repeats import shape

    text = bytes(rnd.choice(b"abc ") for _ in range(5000))
    whole = R.anchors(shape(100), [text])
    monkeypatch.setattr(R, "BLOCK", 700)
    pieces = R.anchors(shape(100), [text])
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_equal_rows_and_columns(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, text + " é", "b"), (None, None, "c")], "doc_id long, text string, repeat_spans string")
    out = remove_repeats(df).collect()
    assert sorted(len(r.text or "") for r in out) == [0, 0, 3 - 1, len(text)] or sorted(len(r.text or "") for r in out)[-1] == len(text)
    words = {(r.doc_id, r.text) for r in remove_copied_words(df).collect()}
    assert words == {(1, text), (2, "é"), (None, None)}
    assert "repeat_spans" in remove_copied_words(df).columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeat_digest(df).collect() == [] and copied_words_digest(df).collect() == []


def test_nothing_repeats(spark):
    """No gram occurs twice, so no bucket has a verdict to send back; short and null texts have no gram."""
    rows = [(i, " ".join(f"{i}w{j}x" for j in range(80))) for i in range(6)] + [(9, None), (10, "a b")]
    assert {r.n_removed for r in copied_words_digest(frame(spark, rows)).collect()} == {0}
    assert {r.n_removed for r in repeat_digest(frame(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("digest, module", [(copied_words_digest, substring_dedup), (repeat_digest, suffix_repeats)])
def test_every_removal_comes_from_the_index(spark, monkeypatch, digest, module):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(7))]
    assert sum(r.n_removed for r in digest(frame(spark, rows)).collect()) > 100
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(module, "compare", lambda s, c: (none, none, none))
    assert {r.n_removed for r in digest(frame(spark, rows)).collect()} == {0}
    assert {r.n_removed for r in digest(frame(spark, rows), hot=1).collect()} == {0}


def test_words_with_one_polynomial_hash(spark):
    """A Thue-Morse word and its complement have the same polynomial hash modulo 2**64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}")]
    assert {r.doc_id: r.n_removed for r in copied_words_digest(frame(spark, rows)).collect()} == {1: 0, 2: 0, 3: 13}


def test_word_tokens_tell_words_apart():
    rnd = random.Random(3)
    words = {"".join(rnd.choice("aé0") for _ in range(n)) for n in range(1, 24) for _ in range(200)} | {"a\0", "a", "a\0\0", "\0"}
    tokens = substring_dedup.word_tokens(" \n".join(words).encode())
    assert len(set(tokens.tolist())) == len(words) == len(tokens)
    assert substring_dedup.word_tokens(b"x abcdefgh").tolist()[1:] == substring_dedup.word_tokens(b"abcdefgh yy").tolist()[:1]


def test_a_gram_with_many_contexts(spark):
    """One 40-byte passage in thousands of different surroundings, some of which repeat."""
    rnd = random.Random(9)
    say = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(90, 130)))
    own = [say() for _ in range(900)]
    rows = [(i, rnd.choice(own) + " the very same passage in all of the rows! " + rnd.choice(own)) for i in range(1500)]
    assert sorted([tuple(r) for r in repeat_digest(frame(spark, rows, 6)).collect()], key=str) == brute_bytes(rows)
    for hot in (2, 50, 500):  # cut into one part a window, into eight, into two
        assert sorted([tuple(r) for r in repeat_digest(frame(spark, rows, 6), hot=hot).collect()], key=str) == brute_bytes(rows)
    assert sorted([tuple(r) for r in copied_words_digest(frame(spark, rows, 6)).collect()], key=str) == brute_words(rows)
    words = [(i, t.replace("e", "e ").replace("a", " a ")) for i, t in rows]
    for hot in (2, 50, 500):
        assert sorted([tuple(r) for r in copied_words_digest(frame(spark, words, 6), hot=hot).collect()], key=str) == brute_words(words)


def test_few_contexts_held_at_a_time(spark, monkeypatch):
    """Parts of one row's neighbouring anchors are cut in different turns; none is taken for its own copy."""
    monkeypatch.setattr(R, "HELD", 3)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(11, 30))]
    assert sorted([tuple(r) for r in repeat_digest(frame(spark, rows), hot=1).collect()], key=str) == brute_bytes(rows)


def test_intervals():
    assert list(lcp_intervals([0, 3, 1, 2])) == [(3, 0, 1), (2, 2, 3), (1, 0, 3)]
