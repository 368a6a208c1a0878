"""Text normalisation, scopes and similarity as Spark columns.

All but the longest common subsequence are built-in expressions.  That one is a dynamic program, so it runs in Arrow
batches, a bit for each token (``weftwork.functions.js.lcs_length``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions import js

_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{js.BLANKS}]+|[{js.BLANKS}]+\z", "")


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{js.BLANKS}]+", "")


def utf16_length(c: Column) -> Column:
    return F.length(c) + F.regexp_count(c, F.lit(_ASTRAL))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{js.BLANKS}]+", " "))


def normalize(c: Column) -> Column:
    """Lower case; all but letters, digits and blanks is a blank; blanks collapse."""
    return collapse(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}{js.BLANKS}]+", " "))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either side is null."""
    return pd.Series([None if x is None or y is None else js.lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def overlap(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(lcs_length(a, b) / longest)


def fast_similarity(left: Column, right: Column) -> Column:
    """Of normalised texts."""
    a, b = tokens(left), tokens(right)
    return F.when(left == right, 1.0).otherwise(F.greatest(jaccard(a, b), overlap(a, b)))


def bigrams(t: Column) -> Column:
    """Neighbouring tokens, joined by a bar that no token holds."""
    return F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda x, y: F.concat(x, F.lit("|"), y)))


def utf16_units(c: Column) -> Column:
    """The text's UTF-16 units, each as a string: a character of the basic plane as itself, another as the four hexadecimal
    digits of either half (upper case, so that no unit of a lower-case text is taken for one)."""
    halves = lambda x: F.hex(F.encode(x, "UTF-16BE"))
    pair = lambda x: F.when(F.rlike(x, F.lit(_ASTRAL)), F.array(F.substring(halves(x), 1, 4), F.substring(halves(x), 5, 4))).otherwise(F.array(x))
    return F.when(F.rlike(c, F.lit(_ASTRAL)), F.flatten(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), pair))).otherwise(F.split(c, ""))


def trigrams(normal: Column) -> Column:
    """Three UTF-16 units each, by joining the text's units with those after them: taking substrings would walk the text for
    each."""
    n, chars = utf16_length(normal) - 2, utf16_units(normal)
    part = lambda i: F.slice(chars, F.lit(i), n)
    three = F.zip_with(F.zip_with(part(1), part(2), lambda x, y: F.concat(x, y)), part(3), lambda x, y: F.concat(x, y))
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(three)


def dice(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def content_words(t: Column) -> Column:
    return F.array_except(t, F.array(*map(F.lit, js.STOP_WORDS)))


def content_recall(a: Column, b: Column, fast: Column) -> Column:
    x, y = content_words(a), content_words(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), fast).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.least(both / F.size(x), both / F.size(y)))


def detailed_similarity(left: Column, right: Column, fast: Column) -> Column:
    """Of normalised texts and their fast similarity (pass a computed column: it is used three times)."""
    a, b = tokens(left), tokens(right)
    mixed = 0.35 * fast + 0.25 * dice(bigrams(a), bigrams(b)) + 0.2 * dice(trigrams(left), trigrams(right)) + 0.2 * content_recall(a, b, fast)
    return F.when(fast == 1.0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)))


def with_detailed_similarity(df: DataFrame, left: str, right: str, to: str) -> DataFrame:
    """``df`` with the detailed similarity of two columns of normalised text.  Every set is a column of its own before it
    is used, so that it is built once a row; as one nested expression each would be built for every mention."""
    c = F.col
    out = df.withColumns({"_ta": tokens(c(left)), "_tb": tokens(c(right))})
    out = out.withColumns({"_ba": F.array_distinct(bigrams(c("_ta"))), "_bb": F.array_distinct(bigrams(c("_tb"))), "_ca": F.array_distinct(trigrams(c(left))), "_cb": F.array_distinct(trigrams(c(right))), "_wa": content_words(c("_ta")), "_wb": content_words(c("_tb"))})
    pairs = {"_b": ("_ba", "_bb"), "_c": ("_ca", "_cb"), "_w": ("_wa", "_wb"), "_t": ("_ta", "_tb")}
    out = out.withColumns({k: F.size(F.array_intersect(a, b)) for k, (a, b) in pairs.items()} | {"_u": F.size(F.array_union("_ta", "_tb")), "_l": lcs_length("_ta", "_tb")})
    n = lambda x: F.size(c(x))

    def ratio(k: str, whole: Column, empty: Column | float, scale: int = 1) -> Column:
        a, b = pairs[k]
        return F.when((n(a) == 0) & (n(b) == 0), empty).when((n(a) == 0) | (n(b) == 0), 0.0).otherwise(scale * c(k) / whole)

    longest = F.greatest(n("_ta"), n("_tb"))
    out = out.withColumn("_f", F.when(c(left) == c(right), 1.0).otherwise(F.greatest(ratio("_t", c("_u"), 1.0), F.when(longest == 0, 1.0).otherwise(c("_l") / longest))))
    recall = F.when((n("_wa") == 0) & (n("_wb") == 0), c("_f")).when((n("_wa") == 0) | (n("_wb") == 0), 0.0).otherwise(F.least(c("_w") / n("_wa"), c("_w") / n("_wb")))
    mixed = 0.35 * c("_f") + 0.25 * ratio("_b", n("_ba") + n("_bb"), 1.0, 2) + 0.2 * ratio("_c", n("_ca") + n("_cb"), 1.0, 2) + 0.2 * recall
    score = F.when(c("_f") == 1.0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)))
    return out.withColumn(to, score).drop("_ta", "_tb", "_ba", "_bb", "_ca", "_cb", "_wa", "_wb", *pairs, "_u", "_l", "_f")


def similarity(left: Column, right: Column, mode: str = "fast") -> Column:
    """Of raw texts."""
    left, right = normalize(left), normalize(right)
    fast = fast_similarity(left, right)
    return detailed_similarity(left, right, fast) if mode == "detailed" else fast


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(c, F.lit(js.java_pattern(pattern, flags)))


def scoped(c: Column, scope: dict | None) -> tuple[Column, Column]:
    """(text that the scope leaves, issue kind or null).  Raises PatternError while the plan is made."""
    if not scope:
        return c, F.lit(None).cast("string")
    no_match = F.lit(False)
    if include := scope.get("includePattern"):
        found = F.filter(F.regexp_extract_all(c, F.lit(js.java_pattern(include["pattern"], include.get("flags", ""))), F.lit(0)), lambda x: x != "")
        no_match = F.size(found) == 0
        c = F.array_join(found, " ")
    for exclude in scope.get("excludePatterns") or ():
        c = F.regexp_replace(c, js.java_pattern(exclude["pattern"], exclude.get("flags", "")), " ")
    c = collapse(c)
    return c, F.when(no_match, "scope_no_match").when(c == "", "scope_empty")
