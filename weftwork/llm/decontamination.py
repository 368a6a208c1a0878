"""Benchmark decontamination: bottom-k MinHash containment search, verified by exact shingle containment.

A document is contaminated by an item if it holds at least 0.8 of the item's distinct five-word shingles.  Documents
are far longer than items, so their Jaccard similarity says little; what counts is containment.  An item of n shingles may miss at most
``n - ceil(0.8 n)`` of them, so of its ``n - ceil(0.8 n) + SPARE`` smallest hashes (its bottom-k MinHash) a
contaminated document holds at least SPARE; that makes the search complete rather than probable.

Items are parted by size: a class holds the items of one gram length and of 2**c to 2**(c+1) - 1 shingles, and has its own
cut, the largest value in its sketches.  A document is searched for a class only if it has shingles enough to hold 0.8 of the
class's smallest item, and only its hashes up to the class's cut meet the class's sketches, by (class, hash).  Before
that, hashes that are in no sketch are dropped by a bitmap of all sketch values, a literal of at most BITMAP_LONGS numbers
(where the sketches have more than BROADCAST_ROWS rows there is none, and the cuts alone hold).
Candidates are then verified by the shingles' words.

All of it is built-in expressions.  The sketches are broadcast only when their counted rows are below BROADCAST_ROWS, the
items' shingles only when their counted bytes are below BROADCAST_BYTES; whether candidates are broadcast is left to
Spark, which knows the size of the table they were written to.

Words are runs of letters and digits of the lower-cased text.  Defined results: items of 1 to 4 words are one shingle
of all their words; items and documents without words match nothing; null texts count as empty; rows that repeat a
(doc_id, text) are reported once; items with a null ``item_id`` are searched for like others, and texts that share an
``item_id`` are each an item of their own; a very long text is searched whole; of items that tie each is reported; an empty
table gives an empty table; columns of ``docs`` are never looked at but ``text`` and ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import materialize, quoted

SHINGLE = 5
LEAST = 0.8
SPARE = 3
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
BITMAP_LONGS = 1 << 16


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(w: str, n: int, make: object) -> Column:
    """``make(words)`` for each n consecutive words of the array column ``w``."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: make(*[F.get(F.col(w), i + j) for j in range(n)]))


def _say(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def item_shingles(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, item_key, n, gram, shingles, hashes): distinct shingles of each item that has words; n of them.
    item_key: hash of id and words, which tells texts of one id and items without id apart."""
    own = items.select(quoted(item_id).alias("item_id"), words(quoted(text)).alias("w")).where("size(w) > 0").distinct().withColumn("item_key", F.xxhash64("item_id", "w"))
    per = [own.where(F.least(F.size("w"), F.lit(SHINGLE)) == g).select("item_id", "item_key", F.lit(g).alias("gram"), F.array_distinct(_grams("w", g, _say)).alias("shingles"), F.array_distinct(_grams("w", g, F.xxhash64)).alias("hashes")) for g in range(1, SHINGLE + 1)]
    out = per[0]
    for x in per[1:]:
        out = out.union(x)
    return out.withColumn("n", F.size("shingles"))


def sketches(shingles: DataFrame) -> DataFrame:
    """(item_key, gram, size_class, hash, need): each item's bottom-k hashes and how many of them a match holds."""
    missing = (F.col("n") - F.ceil(F.col("n") * F.lit(LEAST).cast("decimal(3,2)"))).cast("int")
    k = F.least(F.col("n"), F.col("missing") + F.lit(SPARE))
    return (
        shingles.withColumn("missing", missing)
        .withColumn("size_class", F.floor(F.log2("n")).cast("int"))
        .select("item_key", "gram", "size_class", (k - F.col("missing")).alias("need"), F.explode(F.slice(F.array_sort("hashes"), F.lit(1), k)).alias("hash"))
    )


def _bitmap(sketch: DataFrame, rows: int) -> Column | None:
    """An array literal of numbers whose bits say which values the sketches may hold; None where they are too many."""
    if rows > BROADCAST_ROWS:
        return None
    longs = _longs(rows)
    places = sketch.select(_place(F.col("hash"), longs).alias("at"), _bit(F.col("hash")).alias("bit"))
    held = dict(places.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect())  # at most BITMAP_LONGS rows
    return F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(longs))), ",").cast("array<long>")


def _longs(rows: int) -> int:
    """A power of two: some 128 bits for each row, up to the bound."""
    return min(BITMAP_LONGS, 1 << max(6, (2 * rows).bit_length()))


def _place(h: Column, longs: int) -> Column:
    return F.shiftrightunsigned(h, 64 - longs.bit_length() + 1).cast("int")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def contained(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, item_id, n_item, n_shared, containment) of every document that holds LEAST of an item.
    text_key: hash of the text, which tells rows of one doc_id apart."""
    spark = docs.sparkSession
    found = materialize(item_shingles(items), "items")
    sketch = materialize(sketches(found), "sketches")
    classes = sketch.groupBy("gram", "size_class").agg(F.max("hash").alias("top"), F.count("*").alias("rows")).orderBy("gram", "size_class").collect()  # at most 5 * 31 rows
    if not classes:
        return spark.createDataFrame([], "doc_id long, text_key long, item_id long, n_item int, n_shared int, containment double")
    total = sum(c.rows for c in classes)
    probe = F.broadcast(sketch) if total <= BROADCAST_ROWS else sketch
    bits = _bitmap(sketch, total)

    def met(hashes: Column, top: int) -> Column:
        """The hashes up to ``top`` that a sketch may hold."""
        if bits is None:
            return F.filter(hashes, lambda h: h <= F.lit(top))
        return F.filter(hashes, lambda h: (h <= F.lit(top)) & (F.get(bits, _place(h, _longs(total))).bitwiseAND(_bit(h)) != 0))

    def of_class(low: Column, gram: int, size_class: int, top: int) -> Column:
        own = F.filter(F.array_distinct(low), lambda h: h <= F.lit(top))
        return F.transform(own, lambda h: F.struct(F.lit(gram).alias("gram"), F.lit(size_class).alias("size_class"), h.alias("hash")))

    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).where("text is not null")
    split = rows.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    grams = sorted({c.gram for c in classes})
    low = [met(_grams("w", g, F.xxhash64), max(c.top for c in classes if c.gram == g)).alias(f"low{g}") for g in grams]
    lows = split.select("doc_id", "text_key", F.size("w").alias("n_words"), *low)
    dealt = []
    for c in classes:
        least = -(-4 * (1 << c.size_class) // 5) + c.gram - 1  # words of a document that may hold one of the class
        own = of_class(F.col(f"low{c.gram}"), c.gram, c.size_class, c.top)
        dealt.append(F.when(F.col("n_words") >= least, own).otherwise(F.array().cast("array<struct<gram:int,size_class:int,hash:bigint>>")))
    # no filter on the columns of lows: it would be pushed below them and split the text again for each shingle
    seen = lows.select("doc_id", "text_key", F.explode(F.concat(*dealt)).alias("x")).select("doc_id", "text_key", "x.*")
    hits = seen.join(probe, ["gram", "size_class", "hash"]).groupBy("doc_id", "text_key", "item_key").agg(F.countDistinct("hash").alias("hits"), F.max("need").alias("need"))
    pairs = materialize(hits.where("hits >= need").select("doc_id", "text_key", "item_key"), "pairs")

    both = pairs.alias("p").join(rows.withColumn("text_key", F.xxhash64("text")).alias("d"), (F.col("p.text_key") == F.col("d.text_key")) & F.col("p.doc_id").eqNullSafe(F.col("d.doc_id")))
    texts = both.select("p.doc_id", "p.text_key", "p.item_key", words(F.col("d.text")).alias("w"))
    small = found.select("item_key", "item_id", "gram", "shingles", "n")
    size = found.agg(F.sum(F.length(F.concat_ws(" ", "shingles")) + 16 * F.col("n"))).first()[0] or 0
    checked = texts.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, "item_key")
    own = F.lit(None).cast("array<string>")
    for g in grams:
        own = F.when(F.col("gram") == g, _grams("w", g, _say)).otherwise(own)
    counted = checked.select("doc_id", "text_key", "item_id", F.col("n").alias("n_item"), F.size(F.array_intersect("shingles", own)).alias("n_shared"))
    return counted.where(F.col("n_shared") * 5 >= F.col("n_item") * 4).withColumn("containment", F.col("n_shared") / F.col("n_item")).distinct()


def clean(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item, columns unchanged."""
    bad = materialize(contained(docs, items, text, doc_id).select("doc_id", "text_key").distinct(), "contaminated")
    same = F.col(f"left_side.`{doc_id}`").cast("long").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64(F.col(f"left_side.`{text}`")) == F.col("bad.text_key"))
    return docs.alias("left_side").join(bad.alias("bad"), same, "left_anti")
