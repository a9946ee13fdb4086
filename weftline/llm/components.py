"""Connected components of a graph that no single machine has to hold.

Each round every node is merged into the least of itself and its neighbours, in
an order that a hash shuffles anew each round, so that long chains shrink by a
constant factor. Edges are renamed, loops and repeats go, and the next round
works on what is left. The mappings of the rounds are joined back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.common import is_empty
from weftline.session import cut


def _rank(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), node.alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; nodes of one component share their root.

    Loops, repeated edges and edges with a null end say nothing and are ignored.
    An empty graph has no rows. Each round is written to the checkpoint folder:
    lost executors cost one round at most, and the hash makes reruns agree.
    """
    edges = edges.select("a", "b").where("a <> b")
    maps = []
    while True:
        turn = len(maps)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_rank(F.col("b"), turn)).alias("n"))
        own = _rank(F.col("a"), turn)
        step = cut(least.select(F.col("a").alias("node"), F.least(own, F.col("n"))["id"].alias("root")))
        if is_empty(step):
            break
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        renamed = edges.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = cut(renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not maps:
        return step
    found = maps.pop()
    while maps:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = maps.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return found
