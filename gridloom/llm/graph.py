"""Connected components over an edge table, by minimum labels with pointer jumping.

Nothing is collected: each round is joins and min-aggregates (partial before the shuffle, so a hub costs one row for each
task), the state is written to the shared folder, and rounds grow as the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges(a, b). Self-loops are allowed."""
    e = edges.select("a", "b")
    both = scratch.table(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(most_rounds):
        near = (
            both.join(state.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        )
        low = state.join(near, state.node == near.a, "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        # hook the old root too, then jump: the label of one's label
        hooked = low.groupBy(F.col("was").alias("root")).agg(F.min("c").alias("best"))
        after = scratch.table(
            low.join(hooked, low.was == hooked.root, "left")
            .select("node", "was", F.least("c", F.coalesce("best", "c")).alias("component"))
        )
        up = after.select(F.col("node").alias("p"), F.col("component").alias("top"))
        jumped = scratch.table(
            after.join(up, after.component == up.p, "left")
            .select("node", "was", F.least("component", F.coalesce("top", "component")).alias("component"))
        )
        scratch.drop(after)
        scratch.drop(state)
        state = jumped.select("node", "component")
        state._gridloom_path = jumped._gridloom_path
        if not jumped.where("component <> was").limit(1).count():
            return state
    raise RuntimeError("components did not settle")
