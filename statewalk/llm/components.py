"""Connected components of a graph given as edges, by rounds of grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import checkpointed

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for each node of an edge (a, b); nodes without an edge are not returned.

    Alternating rounds of large and small stars: every node first links its greater neighbours, then its smaller ones, to
    the smallest neighbour, until nothing changes; the depth halves with each round. Neighbourhoods are only reduced to their
    minimum, never gathered, so a node with very many edges costs a partial aggregate and a join that can be split. Each
    round's edges are written to the checkpoint folder. Null nodes and self-links are passed by; repeated edges are harmless.
    """
    pairs = edges.select("a", "b").where("a <> b")
    current = checkpointed(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(ROUNDS):
        # large star: each neighbour above a node goes to the least of the node and its neighbours
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        grown = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        # small star: each neighbour below a node, and the node, go to the least of them
        grown = grown.distinct()
        least = grown.groupBy("a").agg(F.min("b").alias("least"))
        joined = grown.join(least, "a")
        shrunk = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(joined.select("a", F.col("least").alias("b")))
        current = checkpointed(shrunk.where("a <> b").distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components did not settle in {ROUNDS} rounds")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component"))).distinct()
