"""Groups that links form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.storage import durable


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every end of an edge (``a``, ``b``).

    Each round gives every node's root the smallest root among the node's
    neighbours and then shortens the paths, so the number of rounds grows with
    the logarithm of the longest path. Sums and minima are combined before any
    shuffle; tables are keyed by unique nodes and checkpointed, so a crowded
    root can be split by the adaptive join.
    """
    edges = durable(edges.where("a <> b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root")
    ))
    for _ in range(rounds):
        root_of = state.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        own = state.select(F.col("node").alias("a"), F.col("root").alias("own"))
        # The smallest root next to a root's members becomes that root's new root.
        offers = (
            both.join(root_of, "b").select("a", "seen").groupBy("a").agg(F.min("seen").alias("seen"))
            .join(own, "a").where("seen < own").select(F.col("own").alias("node"), F.col("seen").alias("offer"))
            .groupBy("node").agg(F.min("offer").alias("offer"))
        )
        changed = durable(offers)
        if changed.isEmpty():
            return state
        state = durable(
            state.join(changed, "node", "left").select("node", F.least("root", "offer").alias("root"))
        )
        while True:
            above = state.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            moved = state.join(above, "root").select("node", F.col("higher").alias("root"), (F.col("higher") < F.col("root")).alias("moved"))
            state = durable(moved)
            if state.where("moved").isEmpty():
                state = state.drop("moved")
                break
            state = state.drop("moved")
    raise RuntimeError(f"groups did not settle in {rounds} rounds")
