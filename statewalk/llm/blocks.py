"""Groups of any size as bounded pieces of work: a large group is dealt to blocks, and each pair of blocks is a piece."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import checkpointed

#: A group of more members than this is worked on in pairs of blocks.
BLOCK = 2048
#: Large groups that are broadcast, at most: some 40 bytes each. Beyond that they are joined.
BROADCAST_GROUPS = 1 << 18


def large_groups(rows: DataFrame, group: list[str], block: int = BLOCK) -> DataFrame:
    """The groups of rows with more than `block` members: group, _n. Only the group's columns are read; written once."""
    return checkpointed(rows.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > block))


def dealt(rows: DataFrame, group: list[str], member: Column, block: int = BLOCK, keys: DataFrame | None = None) -> DataFrame:
    """rows with left, right (int) and side: members of small groups have (0, 0) and side 0.

    A larger group is dealt to n blocks by a hash of the member. A member of block i is in the pieces (i, j) and (j, i), i.e.
    (min, max), for every j, and side tells which of the two blocks it is in. In a piece with left = right all pairs are
    compared, else only pairs of different sides, so each pair of the group meets in exactly one piece. The groups' sizes are
    counted first, from `keys` (rows with the group's columns alone) where given; as long as there are few large groups, rows
    aren't moved to learn their group's size.
    """
    sizes = large_groups(rows if keys is None else keys, group, block)
    many = sizes.count()
    if not many:
        return rows.select(*rows.columns, *[F.lit(0).alias(c) for c in ("left", "right", "side")])
    n = F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / F.lit(float(block))).cast("int")
    placed = rows.join(F.broadcast(sizes) if many <= BROADCAST_GROUPS else sizes, group, "left").withColumn("_blocks", n).withColumn("_own", F.pmod(F.xxhash64(F.lit(7), member), F.col("_blocks")).cast("int"))
    out = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return out.select(
        *rows.columns,
        F.least("_own", "_other").alias("left"),
        F.greatest("_own", "_other").alias("right"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
    )


class Forest:
    """Union-find over 0..n-1 by arrays: joins whole arrays of pairs, keeps the least index as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            up = p[p]
            if np.array_equal(up, p):
                break
            p = up
        self.parent = p
        return p[x]


def star(forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """The forest as pairs (member, root), roots left out."""
    roots = forest.roots(np.arange(len(forest.parent)))
    inner = np.flatnonzero(roots != np.arange(len(roots)))
    return inner, roots[inner]
