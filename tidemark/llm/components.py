"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of those neighbours (edges have src > dst)."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    hung = edges.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return hung.unionByName(least.select("src", F.col("m").alias("dst")))


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``edges`` (src, dst) to (node, root): root is the smallest node of the component.

    Minima are aggregated before each shuffle and joins are plain equi-joins, so a node with very many
    neighbours is split like any skewed key. Every round is written to the shared folder, and the one before removed. Self edges and
    repeated edges have no effect; an empty table gives an empty result. Only counters reach the driver.
    """
    now, seen = durable(_distinct(edges), "edges"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
                now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
            )
        seen, before = tuple(state), now
        now = durable(_distinct(_small_star(_distinct(_large_star(now)))), "edges")
        discard(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
