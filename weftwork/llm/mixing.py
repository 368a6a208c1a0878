"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on the leaves of a tree domain / language / source.  A token budget is passed down: at each node it is
dealt among the children by weight, no child beyond what its documents can give in ``max_epochs`` passes.  What a short
child leaves goes to its siblings by weight (water filling); only when a whole node is short does its parent's level
deal the rest, so shortages are made up among siblings before ancestors.  All amounts are whole tokens and are computed
in decimals, so the result is the same everywhere.

A leaf with quota q of T tokens gives every document q div T times, and once more the documents in the prefix of a
seeded order (of that epoch) whose tokens sum to at most q mod T.  The prefix is found without sorting a leaf: rows are
dealt by the first two digits of the order's hash, the sums are combined before the shuffle, and the one bucket per leaf
in which the prefix ends is dealt again by the next two digits until it holds at most CUT_ROWS rows.  Only that is sorted.

All of it is built-in expressions.  Tokens are words.  Defined results: null language or source is the node ``none``;
documents without tokens are never taken; weights that are not given are 1, a weight of 0 gives nothing; rows of equal
doc_id stand at one place of the order and are in the prefix together; very long texts are split whole; an empty table
gives an empty table; columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.llm.common import WORD, materialize, quoted, without

LEVELS = ("mix_domain", "mix_lang", "mix_source")
BUCKET_DIGITS = 2
ORDER_DIGITS = 32
#: More rows of a leaf than these are not sorted in one window but dealt into buckets again.
CUT_ROWS = 100_000
BIG = "decimal(38,0)"


def source_domain(source: Column) -> Column:
    """The domain of a source: ``domain0`` to ``domain3`` by the number in its name, ``other`` without one."""
    number = F.regexp_extract(source, r"(\d{1,9})", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string"))).otherwise(F.lit("other"))


def weight_of(level: int, weights: Mapping[str, int]) -> Column:
    """The weight of the node at ``level`` whose path, joined by slashes, is looked up; 1 if it is not given."""
    path = F.concat_ws("/", *LEVELS[: level + 1])
    out = F
    for k, w in sorted(weights.items()):
        if k.count("/") == level:
            out = out.when(path == k, F.lit(int(w)))
    return out.otherwise(F.lit(1)).cast(BIG) if out is not F else F.lit(1).cast(BIG)


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (cap, weight, amount of the parent) with ``quota``: the parent's amount dealt among them."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy()
    order = group.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = children.withColumn("full", F.col("cap") * onward <= (F.col("amount") - before) * F.col("weight"))
    rest = F.col("amount") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))
    share = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    out = full.withColumn("rest", rest.cast(BIG)).withColumn("share", share.cast(BIG))
    dealt = F.expr("cast((rest * weight) div share as decimal(38,0))")
    return out.withColumn("quota", F.when(F.col("full"), F.col("cap")).otherwise(dealt)).drop("full", "rest", "share", "amount")


def quotas(leaves: DataFrame, budget: int, max_epochs: int, weights: Mapping[str, int]) -> DataFrame:
    """``leaves`` (LEVELS, tokens) to the same with ``quota``; one row a leaf."""
    leaf = leaves.withColumn("weight", weight_of(2, weights)).withColumn("cap", (F.col("tokens") * max_epochs).cast(BIG))
    nodes = [leaf]
    for level in (1, 0):
        up = nodes[0].withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0).cast(BIG)))
        nodes.insert(0, up.groupBy(*LEVELS[: level + 1]).agg(F.sum("cap").cast(BIG).alias("cap")).withColumn("weight", weight_of(level, weights)))
    amount = None
    for level, node in enumerate(nodes):
        node = node.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0).cast(BIG))).withColumn("weight", F.greatest("weight", F.lit(1).cast(BIG)))
        keys = list(LEVELS[:level])
        node = node.withColumn("amount", F.lit(budget).cast(BIG)) if amount is None else node.join(amount, keys)
        dealt = fill(node, keys, LEVELS[level])
        amount = dealt.select(*LEVELS[: level + 1], F.col("quota").alias("amount"))
    return dealt.select(*LEVELS, "tokens", "quota")


def _cut(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``rows`` (LEVELS, n_tokens, rest, mix_order) the bucket of each leaf in which its prefix ends, as (LEVELS,
    cut, before: the leaf's tokens ahead of it, ...), and the rows in it.  Places of the order that many rows share
    cannot be parted and need not be."""
    rows = rows.withColumn("before", F.lit(0).cast("long"))
    for digits in range(BUCKET_DIGITS, ORDER_DIGITS + 1, BUCKET_DIGITS):
        name = F.substring("mix_order", 1, digits)
        sums = rows.groupBy(*LEVELS, name.alias("cut")).agg(
            F.sum("n_tokens").alias("own"), F.first("rest").alias("rest"), F.first("before").alias("ahead"),
            F.count("*").alias("n"), F.min("mix_order").alias("least"), F.max("mix_order").alias("most"),
        )
        ahead = F.col("ahead") + F.sum("own").over(Window.partitionBy(*LEVELS).orderBy("cut"))
        beyond = sums.withColumn("upto", ahead).where("upto > rest").withColumn("before", F.col("upto") - F.col("own"))
        first = beyond.groupBy(*LEVELS).agg(F.min(F.struct("cut", "before", ((F.col("n") > CUT_ROWS) & (F.col("least") < F.col("most"))).alias("large"))).alias("c"))
        cut = materialize(first.select(*LEVELS, "c.*"), "cuts")
        rows = rows.drop("before").join(cut.drop("large"), list(LEVELS)).where(name == F.col("cut")).drop("cut")
        if digits == ORDER_DIGITS or cut.where("large").isEmpty():
            break
        rows = materialize(rows, "inside")
    return cut, rows


def mix(docs: DataFrame, weights: Mapping[str, int], budget_percent: int, max_epochs: int = 2, seed: int = 17, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", domain: Column | None = None) -> DataFrame:
    """``docs`` that are taken, with mix_domain, n_tokens and n_copies (1 or more).  budget_percent: of all tokens."""
    docs = without(docs, *LEVELS, "n_tokens", "n_copies", "mix_order", "epochs", "rest", "cut", "last")
    at = source_domain(quoted(source)) if domain is None else domain
    placed = docs.select("*", F.coalesce(at, F.lit("other")).alias(LEVELS[0]), F.coalesce(quoted(lang), F.lit("none")).alias(LEVELS[1]), F.coalesce(quoted(source), F.lit("none")).alias(LEVELS[2]), F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    slim = materialize(placed.where("n_tokens > 0").select(*LEVELS, "n_tokens", quoted(doc_id).alias("mix_id")), "tokens")
    leaves = materialize(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = quotas(leaves, total * budget_percent // 100, max_epochs, weights)
    plan = materialize(plan.select(*LEVELS, F.expr("cast(quota div tokens as int)").alias("epochs"), F.expr("cast(quota % tokens as long)").alias("rest")), "quotas")

    def ordered(rows: DataFrame, by: Column) -> DataFrame:
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), by.cast("string")).cast("binary"))
        return rows.join(plan, list(LEVELS)).withColumn("mix_order", order)

    cut, inside = _cut(ordered(slim, F.col("mix_id")))
    places = inside.groupBy(*LEVELS, "mix_order").agg(F.sum("n_tokens").alias("own"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("own").over(Window.partitionBy(*LEVELS).orderBy("mix_order"))
    ends = places.withColumn("upto", upto).where("upto <= rest").groupBy(*LEVELS).agg(F.max("mix_order").alias("last"))
    ends = materialize(cut.join(ends, list(LEVELS), "left").select(*LEVELS, "cut", F.coalesce("last", F.lit("")).alias("last")), "ends")
    told = ordered(placed.where("n_tokens > 0"), quoted(doc_id)).join(ends, list(LEVELS))
    again = (F.col("mix_order") < F.col("cut")) | (F.col("mix_order") <= F.col("last"))  # a bucket's name is a prefix
    taken = told.withColumn("n_copies", F.col("epochs") + F.when(again, 1).otherwise(0)).where("n_copies > 0")
    return taken.select(*[quoted(c) for c in docs.columns], LEVELS[0], "n_tokens", "n_copies")
