"""URL rules against a scan of all rules, and WARC round trips."""

import io
import random
import zlib

import pytest

from weftwork.llm import url_rules as U
from weftwork.llm import warc as W
from weftwork.llm.queries import URL_RULES

ODD_URLS = [None, "", "no scheme", "http://", "http://NET", "http://a.net", "http://A.NET/x?y#z", "http://x.example.net/en/1", "http://example.net/en", "http://example.net/en/?q", "https://notexample.net/en/", "ftp://org/fr/a#b/c", "http://a.org?x=/fr/", "http://a.b.example.com/de/x://y", "://example.com/de/", "http://é.example.com/de/ü", "http://a..net/"]


def slow(rules, url):
    host, path = U.split_url(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(ODD_URLS)), "page_id long, url string")
    rows = {r.page_id: r for r in U.judge_urls(df, URL_RULES).collect()}
    for i, u in enumerate(ODD_URLS):
        assert (rows[i].rule, rows[i].verdict) == slow(URL_RULES, u), u
    assert (rows[0].host, rows[0].path) == ("", "") and rows[6].host == "a.net" and rows[6].path == "/x"
    assert rows[13].path == "/de/x://y" and U.judge_urls(df.where("false"), URL_RULES).collect() == []


def test_random_rules():
    rnd = random.Random(1)
    hosts = [".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    paths = ["", "/", *["/" + "/".join(rnd.choice(["x", "y", "xy", ""]) for _ in range(rnd.randint(1, 3))) for _ in range(20)]]
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in ((rnd.choice(hosts), rnd.choice(paths)) for _ in range(150))}.values())
    trie = U.UrlTrie(rules)
    for _ in range(3000):
        url = f"http://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', 'x', '/x'])}"
        assert (trie.match(*U.split_url(url)) or (None, "allow")) == slow(rules, url)


PAGES = [(1, "http://a/ b", "same"), (5, "u", "same"), (5, "u", "same"), (2, None, None), (3, "u", ""), (None, "u", "same"), (None, None, "alone é\r\n\r\n"), (9, "u", "x" * 300_000), (4, "u", "WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least, told", [(0, 200_000), (4, 200_000), (5, 0)])
def test_round_trip(spark, tmp_path, monkeypatch, least, told):
    monkeypatch.setattr(W, "BROADCAST_ROWS", told)
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    got = W.read_archives(W.write_archives(df, f"file://{tmp_path}/w", least), f"file://{tmp_path}/w").collect()
    want = []
    for pid, _, html in PAGES:
        body = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = max(same, default=None) if len(body) >= least and sum((h or "") == (html or "") for _, _, h in PAGES) > 1 else None
        refers = first if first != pid else None
        want.append((pid, len(body), W.base32_sha1(body), "revisit" if refers is not None else "response", refers, body if refers is None else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got], key=str) == sorted(want, key=str)


def test_urls_come_back(spark, tmp_path):
    urls = [None, "", " ", "http://a/ b", "http://a/%20b", "http://a/ %20", "http://é.example/ü?q=日本", "a\r\nWARC-Type: revisit", "\thttp://x\t", "http://[::1]/~a|b^c`{}\"<>", "x" * 5000]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.read_archives(W.write_archives(df, f"file://{tmp_path}/w"), f"file://{tmp_path}/w").collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == rows
    for u in urls[1:]:
        field = dict(W._uri_fields(u))["WARC-Target-URI"]
        assert field.isascii() and not any(c.isspace() for c in field)


def test_file_systems(monkeypatch):
    asked = []
    monkeypatch.setattr(W.pyarrow.fs, "FileSystem", type("Any", (), {"from_uri": staticmethod(lambda uri: (asked.append(uri), ""))}))
    for uri in ("s3a://bucket/x", "s3n://bucket/x", "file:///x", "hdfs://h/s3a://"):
        W.file_system(uri)
    assert asked == ["s3://bucket/x", "s3://bucket/x", "file:///x", "hdfs://h/s3a://"]


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_reader(block):
    raw = b"".join(W.record(i, "u", b"p" * i * 100, None if i % 2 else i + 1) for i in range(6))
    got = list(W.WarcReader(io.BytesIO(raw), block))
    assert [r.page("WARC-Record-ID") for r in got] == list(range(6)) and got[3].payload == b"p" * 300 and got[2].payload == b""


def test_reader_finds_damage():
    good = W.record(1, "u", b"payload", None)
    with pytest.raises(W.WarcError):
        list(W.WarcReader(io.BytesIO(good[:-9])))
    plain = zlib.decompress(good, 31)
    for bad in (plain.replace(b"payload", b"paYload"), plain.replace(b"WARC/1.1", b"WERC/1.1"), plain[:-2], plain + b"x"):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(W.WarcError):
            list(W.WarcReader(io.BytesIO(z.compress(bad) + z.flush())))
