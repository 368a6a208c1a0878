"""Connected components of an undirected graph of 64-bit nodes, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours.  The minimum is combined before the shuffle, and the join
    back is one against many, which Spark may split where a hub has most of the edges."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(found.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (u long, v long) to (node, root): every linked node with the least node it reaches.  Self links and
    repeated links are harmless; an empty input gives no rows.  Raises if the rounds run out (they double the reach)."""
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
