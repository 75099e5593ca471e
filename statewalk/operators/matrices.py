"""Feature matrices in long form: z-scores, weighted state means, pattern correlations, state maps, group summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from statewalk.functions.expressions import safe_corr


def zscore(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """rows with z: the value less its group's mean over its sample deviation; a deviation of 0 (or of one row) counts as 1."""
    w = W.partitionBy(*group)
    sd = F.stddev_samp(value).over(w)
    return rows.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd).otherwise(1.0))


def mean_patterns(rows: DataFrame) -> DataFrame:
    """s, p, mean of rows (s, p, x)."""
    return rows.groupBy("s", "p").agg(F.avg("x").alias("mean"))


def weighted_moments(rows: DataFrame, floor: float = 1e-6) -> DataFrame:
    """s, p, mean, var of rows (s, p, g, x) weighted by g: var is E[x*x] - mean**2, at least floor; no weight divides by 1."""
    sums = rows.groupBy("s", "p").agg(F.sum("g").alias("w"), F.sum(F.col("g") * F.col("x")).alias("wx"), F.sum(F.col("g") * F.col("x") * F.col("x")).alias("wxx"))
    w = F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)
    out = sums.select("s", "p", (F.col("wx") / w).alias("mean"), (F.col("wxx") / w).alias("square"))
    return out.select("s", "p", "mean", F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(floor)).alias("var"))


def pattern_correlations(patterns: DataFrame) -> DataFrame:
    """s_i, s_j, corr for i < j of patterns (s, p, mean), clipped to [-1, 1]; null for a constant pattern."""
    a, b = patterns.alias("a"), patterns.alias("b")
    both = a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.s") < F.col("b.s")))
    r = safe_corr(F.col("a.mean"), F.col("b.mean"))
    return both.groupBy(F.col("a.s").alias("s_i"), F.col("b.s").alias("s_j")).agg(F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("corr"))


def clone_pairs(patterns: DataFrame, threshold: float = 0.9) -> DataFrame:
    return pattern_correlations(patterns).where(F.col("corr") >= threshold)


def beta_maps_hard(rows: DataFrame) -> DataFrame:
    """s, p, beta of rows (sid, s, p, x) with one state a step: group means, centred by the states' shares of steps."""
    by = rows.groupBy("s", "p").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    w = W.partitionBy("p")
    centre = F.sum(F.col("mean") * F.col("n")).over(w) / F.sum("n").over(w)
    return by.select("s", "p", (F.col("mean") - centre).alias("beta"))


#: Steps of a sequence that are factored together.
FACTOR_STEPS = 4096


def factor(g: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[R, Q'y] of the factorisation g = QR: at most as many rows as g has columns, from which any rows on can be added."""
    q, r = np.linalg.qr(g)
    return np.concatenate([r, q.T @ y], axis=1)


def beta_of_factors(factors: np.ndarray, mean: np.ndarray, rcond: float) -> np.ndarray:
    """The regression of all steps from the stacked factors of its parts, each feature centred by the mean probabilities."""
    k = len(mean)
    whole = factor(factors[:, :k], factors[:, k:])
    b = np.linalg.pinv(whole[:, :k], rcond=rcond) @ whole[:, k:]
    return b - mean @ b


def beta_maps_soft(rows: DataFrame, rcond: float = 1e-6, chunk: int = FACTOR_STEPS) -> DataFrame:
    """sid, s, p, beta of rows (sid, t, g array, y array): each feature's regression on the state probabilities, without an
    intercept, less its value at the mean probabilities.

    A tall, narrow least-squares problem in parts: each chunk of steps becomes a factor of as many rows as states, and the
    factors of a sequence, one a chunk, are factored again. Singular values are those of all steps together, so the cut at
    rcond is too. Ids may be of any type.
    """
    sid = rows.schema["sid"].dataType.simpleString()

    def matrix(x: pa.ChunkedArray, n: int) -> np.ndarray:
        return np.asarray(x.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)

    def one(values: np.ndarray) -> pa.Array:
        return pa.array([values.ravel()], pa.list_(pa.float64()))

    def reduce(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["t"].to_numpy(), kind="stable")
        g, y = matrix(rows["g"], len(order))[order], matrix(rows["y"], len(order))[order]
        return pa.table({"sid": rows["sid"][:1], "c": rows["c"][:1], "n": pa.array([len(g)], pa.int64()), "mass": one(g.sum(0)), "cells": one(factor(g, y))})

    def solve(parts: pa.Table) -> pa.Table:
        order, n = np.argsort(parts["c"].to_numpy()), parts["n"].to_numpy()
        masses = matrix(parts["mass"], len(n))
        mass, k = masses.sum(0), masses.shape[1]
        # a factor has as many rows as its steps, up to k
        each = [np.asarray(parts["cells"][int(i)].values.to_numpy()).reshape(min(int(n[i]), k), -1) for i in order]
        b = beta_of_factors(np.concatenate(each), mass / n.sum(), rcond)
        s, p = np.indices(b.shape, np.int32)
        sid = parts["sid"].combine_chunks().take(pa.array(np.zeros(b.size, np.int64)))
        return pa.table({"sid": sid, "s": pa.array(s.ravel()), "p": pa.array(p.ravel()), "beta": pa.array(b.ravel())})

    c = F.floor(F.col("t") / chunk).cast("long")
    factors = rows.select("sid", c.alias("c"), "t", "g", "y").groupBy("sid", "c").applyInArrow(reduce, f"sid {sid}, c long, n long, mass array<double>, cells array<double>")
    return factors.groupBy("sid").applyInArrow(solve, f"sid {sid}, s int, p int, beta double")


def group_mean_sd(stack: DataFrame) -> DataFrame:
    """s, p, n, mean, sd over sequences of stack (sid, s, p, value)."""
    return stack.groupBy("s", "p").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def parcel_summary(stack: DataFrame) -> DataFrame:
    """s, p, n, mean, sd, mean_m, mean_f of stack (sid, s, p, value, sex)."""
    return stack.groupBy("s", "p").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.avg(F.when(F.col("sex") == "M", F.col("value"))).alias("mean_m"),
        F.avg(F.when(F.col("sex") == "F", F.col("value"))).alias("mean_f"),
    )


def parcel_wide(stack: DataFrame, states: list[int]) -> DataFrame:
    """p and one column of means for each state: the states are given, so that no pass is spent on finding them."""
    return stack.groupBy("p").agg(*[F.avg(F.when(F.col("s") == s, F.col("value"))).alias(f"state{s}") for s in states])


def parcellate(dense: DataFrame, atlas: DataFrame, method: str = "MEAN") -> DataFrame:
    """sid, t, label, value: dense (sid, t, elem, value) reduced over the elements of each label of atlas (elem, label).

    Elements without a label, or with label 0 or null, are left out. The join is left to the optimizer, which broadcasts the
    atlas while its size allows.
    """
    by = {"MEAN": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "MEDIAN": lambda c: F.percentile(c, F.lit(0.5)), "STDEV": F.stddev_pop, "SAMPSTDEV": F.stddev_samp}
    if method.upper() not in by:
        raise ValueError(f"unknown reduction {method}; known: {', '.join(by)}")
    return dense.join(atlas, "elem").groupBy("sid", "t", "label").agg(by[method.upper()]("value").alias("value"))


def paint(elements: DataFrame, values: DataFrame) -> DataFrame:
    """elem, s, value: each element (elem, label) gets its label's value in each state; 0 where the label has none."""
    states = values.select("s").distinct()
    grid = elements.crossJoin(F.broadcast(states))  # as many rows as there are states, a small number set by the model
    return grid.join(values, ["label", "s"], "left").select("elem", "s", F.coalesce("value", F.lit(0.0)).alias("value"))


def network_fingerprint(patterns: DataFrame, names: DataFrame, tokens: DataFrame) -> DataFrame:
    """s, network, value: mean of patterns (s, p, mean) over features whose name holds one of a network's tokens, once each."""
    hit = names.join(F.broadcast(tokens), F.lower("name").contains(F.lower("token"))).select("p", "network").distinct()
    return patterns.join(hit, "p").groupBy("s", "network").agg(F.avg("mean").alias("value"))


def beta_distance(series: DataFrame, maps: DataFrame) -> DataFrame:
    """sid, s, distance: the root of the mean squared difference of a sequence's features (sid, s, p, x) to its state's map
    (s, p, beta)."""
    both = series.join(maps.select("s", "p", "beta"), ["s", "p"])
    return both.groupBy("sid", "s").agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("beta"), 2))).alias("distance"))
