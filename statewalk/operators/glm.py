"""Permutation tests of a linear model on every parcel: a given design and contrast, permuted or sign-flipped within blocks.

The contrast's column is parted from the others, whose fit is taken out of the values once; a permutation then deals the rest
anew over the subjects of a block, and the statistic comes from sums of products with the designs of the subjects dealt. Only
such sums are shuffled. The greatest statistic of each permutation gives family-wise p.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.functions.expressions import total
from statewalk.operators.numbering import places, settled
from statewalk.operators.permutations import dealt_places
from statewalk.operators.statistics import ROUNDING

#: Rows of a design that are broadcast, at most; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1 << 18


def parted(design: DataFrame, columns: Sequence[str], contrast: Sequence[float]) -> DataFrame:
    """sid, block, x (the contrast's regressor) and z (array of the others): the same model, in which x has the contrast's value
    as its coefficient."""
    lead = next((i for i, c in enumerate(contrast) if c), None)
    if lead is None or len(contrast) != len(columns):
        raise ValueError("the contrast has to weigh the design's columns, at least one of them")
    own = F.col(f"`{columns[lead]}`").cast("double") / float(contrast[lead])
    rest = [F.col(f"`{c}`").cast("double") - own * float(w) for i, (c, w) in enumerate(zip(columns, contrast)) if i != lead]
    block = F.col("block") if "block" in design.columns else F.lit(0)
    return design.select("sid", block.alias("block"), own.alias("x"), F.array(*rest).cast("array<double>").alias("z"))


def inverse(q: int):
    """The pseudo-inverse of the symmetric q x q matrices of an array column."""

    def solve(cells: pd.Series) -> pd.Series:
        if not len(cells) or not q:
            return pd.Series([[] for _ in range(len(cells))])
        m = np.stack(cells).reshape(-1, q, q)
        return pd.Series(list(np.linalg.pinv(m, rcond=1e-10, hermitian=True).reshape(-1, q * q)))

    return F.pandas_udf(solve, "array<double>")


def times(m: str, v: Column | str, q: int) -> list[Column]:
    """The product of the matrix in an array column and a vector."""
    v = F.col(v) if isinstance(v, str) else v
    return [total([F.col(m)[i * q + j] * v[j] for j in range(q)]) for i in range(q)]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return total([x * y for x, y in zip(a, b)]) if a else F.lit(0.0)


def cells(column: str, q: int) -> list[Column]:
    return [F.col(column)[i] for i in range(q)]


def parcel_design_test(
    stack: DataFrame, design: DataFrame, columns: Sequence[str], contrast: Sequence[float], n_perm: int, by: tuple[str, ...] = (), flip: bool = False, two_tailed: bool = True, seed: str = "42"
) -> DataFrame:
    """by, p, t, p_fwe of stack (by, sid, p, value): t of the contrast in each parcel's model of the design (sid, columns, and block
    where subjects are exchanged only within one), and its family-wise p by the greatest |t|, or t where not two_tailed.

    Subjects of a family are those with both a value and a row of the design. A parcel that lacks some of them, or has a null
    value, has no t. With flip signs are turned by md5(seed, i, sid) instead of dealing subjects anew. A subject listed twice
    in the design is an error of the design: its rows count as subjects of their own. An empty stack has no rows.
    """
    by, q = list(by), len(columns) - 1
    z = cells("z", q)
    rows = stack.select(*by, "sid", "p", "value").where(F.col("value").isNotNull())
    subjects = rows.select(*by, "sid").distinct().join(parted(design, columns, contrast), "sid")
    placed = places(subjects, ["sid"], [*by, "block"], "_place")
    one = F.lit(0).alias("_one")  # a key for no families
    key = by or ["_one"]

    def keyed(df: DataFrame) -> DataFrame:
        return df if by else df.withColumn("_one", one)

    placed = keyed(placed)
    sizes = placed.groupBy(*key, "block").agg(F.count("*").alias("_size"))
    products = F.array(*[F.sum(z[i] * z[j]) for i in range(q) for j in range(q)]).cast("array<double>")
    model = placed.groupBy(*key).agg(F.count("*").alias("_n"), products.alias("_zz"), F.array(*[F.sum(c * F.col("x")) for c in z]).cast("array<double>").alias("_zx"), F.sum(F.col("x") * F.col("x")).alias("_xx"))
    model = model.withColumn("_inv", inverse(q)("_zz")).withColumn("_bx", F.array(*times("_inv", "_zx", q)).cast("array<double>"))
    model = settled(model.withColumn("_sxx", F.col("_xx") - dot(cells("_zx", q), cells("_bx", q))).select(*key, "_n", "_inv", "_bx", "_sxx", "_xx"))
    own = settled(placed.join(sizes, [*key, "block"]).join(F.broadcast(model) if not by else model, key).withColumn("xt", F.col("x") - dot(z, cells("_bx", q))).select(*key, "sid", "block", "_place", "_size", "z", "xt"))

    # values less the fit of the other columns
    values = keyed(rows).join(own, [*key, "sid"])
    fits = values.groupBy(*key, "p").agg(F.count("*").alias("_have"), F.array(*[F.sum(c * F.col("value")) for c in z]).cast("array<double>").alias("_zy")).join(model, key).where("_have = _n")
    fits = fits.withColumn("_b", F.array(*times("_inv", "_zy", q)).cast("array<double>")).select(*key, "p", "_b")
    left = values.join(fits, [*key, "p"]).withColumn("r", F.col("value") - dot(z, cells("_b", q)))

    dealt = left.select(*key, "sid", "p", "r", "block", "_place", "_size", "z", "xt").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm))))
    if flip:
        turned = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "perm", "sid").cast("binary")), 1, 1) < "8"
        dealt = dealt.withColumn("r", F.when((F.col("perm") > 0) & turned, -F.col("r")).otherwise(F.col("r")))
    else:
        dealt = dealt_places(dealt.drop("z", "xt"), "_place", "_size", "perm", seed, "_dealt")
        looked = own.select(*[F.col(c).alias(f"_k_{c}") for c in (*key, "block")], F.col("_place").alias("_k__dealt"), "z", "xt")
        # null-safe, as else a filter on the dealt place is pushed through its rounds, each of which it would repeat
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*key, "block", "_dealt")]
        dealt = dealt.join(F.broadcast(looked) if own.count() <= BROADCAST_ROWS else looked, same)
    sums = dealt.groupBy(*key, "perm", "p").agg(F.sum(F.col("xt") * F.col("r")).alias("_xr"), F.array(*[F.sum(c * F.col("r")) for c in z]).cast("array<double>").alias("_zr"), F.sum(F.col("r") * F.col("r")).alias("_rr")).join(model, key)
    slope = F.col("_xr") / F.when(F.col("_sxx") > 1e-12 * F.col("_xx"), F.col("_sxx"))
    rss = F.col("_rr") - dot(cells("_zr", q), times("_inv", "_zr", q)) - slope * F.col("_xr")
    den = F.col("_n") - F.lit(q + 1)
    t = slope * F.sqrt("_sxx") / F.when((den > 0) & (rss > 0), F.sqrt(rss / F.when(den > 0, den)))
    stats = settled(sums.select(*key, "perm", "p", t.alias("t"), (F.abs(t) if two_tailed else t).alias("_u")))
    seen = stats.where("perm = 0").select(*key, "p", "t", "_u")
    most = stats.where("perm > 0").groupBy(*key, "perm").agg(F.max("_u").alias("_most"))
    reached = F.col("_most") >= F.col("_u") - F.abs("_u") * ROUNDING
    hits = seen.join(most, key, "left").groupBy(*key, "p", "t").agg(F.sum(reached.cast("long")).alias("_hits"), F.count("_most").alias("_times"))
    found = hits.select(*key, "p", "t", F.when(F.col("t").isNotNull(), (F.coalesce("_hits", F.lit(0)) + 1) / (F.col("_times") + 1)).alias("p_fwe"))
    # parcels that lack subjects have neither
    every = keyed(rows.select(*by, "p").distinct())
    return every.join(found, [*key, "p"], "left").select(*by, "p", "t", "p_fwe")
