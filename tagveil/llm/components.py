"""Connected components of a large graph by contraction with pointer jumping, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import dropped, stored

#: Rounds after which something must be wrong (each at least halves a component's nodes).
MOST_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root), root being the least node of each component.

    Nodes without a link do not occur. Every round moves each node to the least among its
    neighbours and itself, then on to where that one went, and draws the links between where
    their ends are now; links that have become loops or repeat others go, so rounds shrink.
    Linked nodes stay linked or meet, and the least node never moves, so each component ends
    in it. Minima are taken map-side first, so a hub's many links are no burden, and every
    round is cut into the shared checkpoint folder, where the links before it go.
    """
    links = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    moves = []
    for _ in range(MOST_ROUNDS):
        if moves and links.isEmpty():
            dropped(links)
            break
        near = stored(links.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
        moved = stored(near.join(near.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", F.col("further").alias("root")))
        dropped(near)
        moves.append(moved)
        at = [moved.select(F.col("node").alias(x), F.col("root").alias(f"new_{x}")) for x in ("a", "b")]
        drawn = links.join(at[0], "a").join(at[1], "b").where("new_a != new_b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).distinct()
        before, links = links, stored(drawn)
        dropped(before)
    else:
        raise RuntimeError("the components did not settle")
    # the last rounds are the smallest, so they are put together first
    whole = moves[-1]
    for earlier in reversed(moves[:-1]):
        later = whole.select(F.col("node").alias("root"), F.col("root").alias("further"))
        whole = earlier.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return stored(whole)
