"""Connected components by alternating large-star and small-star steps, in DataFrame operations.

Every step keeps the components and brings each node nearer to the smallest node of its component. A node's smallest
neighbour is an aggregate that combines before its shuffle, and goes back to the links by a join that Spark can split
at a hot node; no neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import checkpointed

#: rounds before giving up; each roughly halves the distance to the smallest node
ROUNDS = 40
#: links up to which a graph (16 bytes a link) is one partition, so that its steps need no shuffle
FEW_LINKS = 100_000


def large_star(links: DataFrame, dealt) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = dealt(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def small_star(links: DataFrame, dealt) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the smallest of them. Links go down, a > b."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return dealt(moved.unionByName(least.select("a", F.col("m").alias("b")))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links (a, b)``; a component is named by its smallest node.

    Nulls and loops are left out, repeated links count once; without a link the result is empty. A graph within ``FEW_LINKS`` is
    worked on in one partition, any larger one in as many as shuffles have; both ways take the same steps.
    """
    now = checkpointed(links.select("a", "b").where("a <> b").distinct())
    few = now.count() <= FEW_LINKS
    dealt = lambda df: df.coalesce(1) if few else df
    now = dealt(now)
    for _ in range(ROUNDS):
        now = checkpointed(small_star(large_star(now, dealt), dealt))
        # done when no node is both above and below another and none is below two: every link then leads to its component's smallest node
        now = dealt(now)
        middle = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        twice = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        if middle.select("a").unionByName(twice).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle within {ROUNDS} rounds")
    return dealt(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")))).distinct()
