"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import decision_rules, decontamination, language_id, mixing, quality_ranker, simhash, substring_dedup, suffix_repeats, url_rules, warc
from weftwork.llm.common import fold, table

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIX_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1, "domain0/en": 3, "domain0/de": 2, "domain1/fr": 4, "domain2/es": 5, "domain3/en": 0}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 17


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs, fold(F.col("doc_id"), 4) != 2)
    found = language_id.predict(docs, net)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.copied_words_digest(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"), "containment")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)
    return out.select("doc_id", "mix_domain", "lang", "source", "n_tokens", F.col("n_copies").cast("long").alias("n_copies"))


def quality_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_ranker.Ranker | None:
    return quality_ranker.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_ranker.score(docs, quality_of(spark, docs, sf_dir), to="score")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.repeat_digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_rules.fit(docs, table(spark, sf_dir, "labels"))
    return decision_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_simhash, op3_substring_dedup, op4_decontamination, op5_mixing, op6_quality_classifier, op7_url_filter, op8_suffix_array_dedup, op9_quality_rules, op10_warc)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM s),
f AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + j AS i FROM k JOIN f USING (k), range(0, 13) t(j) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
g AS (SELECT p.doc_id, count(r.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (r.i IS NULL) AS kept
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

_OP4 = r"""
WITH i0 AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM i0 WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d0 AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d0 WHERE len(w) >= 5),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item::DOUBLE AS containment FROM m JOIN n USING (item_id) WHERE n_shared * 5 >= n_item * 4
"""


def _weight(level: int, path: str) -> str:
    cases = "".join(f" WHEN '{k}' THEN {w}" for k, w in sorted(MIX_WEIGHTS.items()) if k.count("/") == level)
    return f"(CASE {path}{cases} ELSE 1 END)::HUGEINT" if cases else "1::HUGEINT"


def _fill(name: str, source: str, parent: str, by: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_1 AS (SELECT *, cap * sum(weight) OVER ({part} ORDER BY cap::DOUBLE / weight::DOUBLE, {by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
   <= (amount - coalesce(sum(cap) OVER ({part} ORDER BY cap::DOUBLE / weight::DOUBLE, {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS filled FROM {source}),
{name} AS (SELECT * EXCLUDE (amount), (CASE WHEN filled THEN cap ELSE
   ((amount - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({part}), 0)) * weight) // sum(CASE WHEN NOT filled THEN weight END) OVER ({part}) END)::HUGEINT AS quota FROM {name}_1)"""


_OP5 = rf"""
WITH p AS (SELECT doc_id, lang, source, coalesce(CASE WHEN regexp_extract(source, '(\d{{1,9}})', 1) <> '' THEN 'domain' || (regexp_extract(source, '(\d{{1,9}})', 1)::BIGINT % 4) ELSE 'other' END, 'other') AS d,
  coalesce(lang, 'none') AS l, coalesce(source, 'none') AS s, len({_WORDS})::BIGINT AS n_tokens FROM documents),
leaf0 AS (SELECT d, l, s, sum(n_tokens)::HUGEINT AS tokens FROM p GROUP BY ALL HAVING sum(n_tokens) > 0),
leaf AS (SELECT *, tokens * {MIX_EPOCHS} AS cap0, {_weight(2, "concat_ws('/', d, l, s)")} AS w0 FROM leaf0),
leafc AS (SELECT d, l, s, tokens, CASE WHEN w0 > 0 THEN cap0 ELSE 0 END AS cap, greatest(w0, 1) AS weight FROM leaf),
lang0 AS (SELECT d, l, sum(cap)::HUGEINT AS cap0, {_weight(1, "concat_ws('/', d, l)")} AS w0 FROM leafc GROUP BY d, l),
langc AS (SELECT d, l, CASE WHEN w0 > 0 THEN cap0 ELSE 0 END AS cap, greatest(w0, 1) AS weight FROM lang0),
dom0 AS (SELECT d, sum(cap)::HUGEINT AS cap0, {_weight(0, "d")} AS w0 FROM langc GROUP BY d),
domc AS (SELECT d, CASE WHEN w0 > 0 THEN cap0 ELSE 0 END AS cap, greatest(w0, 1) AS weight, ((SELECT sum(tokens) FROM leaf0) * {MIX_PERCENT} // 100)::HUGEINT AS amount FROM dom0),
{_fill("dq", "domc", "", "d")},
langa AS (SELECT langc.*, dq.quota AS amount FROM langc JOIN dq USING (d)),
{_fill("lq", "langa", "d", "l")},
leafa AS (SELECT leafc.*, lq.quota AS amount FROM leafc JOIN lq USING (d, l)),
{_fill("sq", "leafa", "d, l", "s")},
plan AS (SELECT d, l, s, quota // tokens AS epochs, quota % tokens AS rest FROM sq),
o AS (SELECT p.*, epochs, rest, md5(concat_ws(':', '{MIX_SEED}', epochs::VARCHAR, doc_id::VARCHAR)) AS k FROM p JOIN plan USING (d, l, s) WHERE n_tokens > 0),
c AS (SELECT *, epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY d, l, s ORDER BY k) <= rest THEN 1 ELSE 0 END AS n_copies FROM o)
SELECT doc_id, d AS mix_domain, lang, source, n_tokens, n_copies::BIGINT AS n_copies FROM c WHERE n_copies > 0
"""

_OP7 = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN lower(regexp_extract(url, '://([^/?#]*)', 1)) ELSE '' END AS host,
  CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""

_OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
f AS (SELECT k, min((doc_id, i)) AS first FROM k GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k JOIN f USING (k) WHERE (doc_id, i) <> first),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, run),
p AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS beg FROM (SELECT * FROM s UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d)),
t AS (SELECT p.doc_id, string_agg(substr(h, 2 * beg + 1, 2 * (lo - beg)), '' ORDER BY lo) AS kept FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, ((length(h) - length(kept)) // 2)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t ON d.doc_id = t.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

_OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p),
c AS (SELECT *, list_transform(range(0, 32), lambda i: (('0x' || h[5 * (i // 4) + 1 : 5 * (i // 4) + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31) AS q FROM g)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, array_to_string(list_transform(q, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": _OP3, "op4_decontamination": _OP4, "op5_mixing": _OP5, "op7_url_filter": _OP7, "op8_suffix_array_dedup": _OP8, "op10_warc": _OP10}
