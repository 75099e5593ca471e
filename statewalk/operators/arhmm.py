"""Autoregressive hidden Markov model with diagonal Gaussian emissions, fitted by expectation-maximisation on Spark.

A row is a whole sequence: (sid, x) with x the array of steps, each an array of d features. A fit packs the sequences into
blocks of plain numbers once. An iteration takes the parameters along, reduces each partition's blocks to one row of statistics
of a size set by the model, and the driver sums those rows for the closed-form update; if they are large, a tree of grouped
sums comes before.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger("statewalk")
FLOOR, RIDGE = 1e-6, 1e-5
#: Steps whose pairs are summed at once, and cells of steps and features that are worked on together.
PAIR_STEPS, PORTION = 1 << 14, 1 << 18
#: Least transition, and least weight of a first step, with which the recursions need no logarithms.
STEADY, SEEN = 1e-100, 1e-200


@dataclass
class Parameters:
    start: np.ndarray  # k
    trans: np.ndarray  # k, k
    weights: np.ndarray  # k, d * order + 1, d
    var: np.ndarray  # k, d
    means: np.ndarray  # k, d
    order: int
    loglik: float = float("nan")


def log_sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def lagged(y: np.ndarray, order: int) -> np.ndarray:
    """The order lags of each step and a constant; the first steps' missing lags are the first observation."""
    t = np.arange(len(y))
    return np.concatenate([y[np.maximum(t - lag, 0)] if lag <= len(y) else y for lag in range(1, order + 1)] + [np.ones((len(y), 1))], axis=1) if order > 0 else np.ones((len(y), 1))


def all_lagged(y: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """`lagged` of sequences one after another."""
    at = np.arange(len(y))
    t, n = at - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(lengths, lengths)
    return np.concatenate([y[np.where(lag <= n, at - np.minimum(t, lag), at)] for lag in range(1, order + 1)] + [np.ones((len(y), 1))], axis=1)


def emission(y: np.ndarray, x: np.ndarray, p: Parameters) -> np.ndarray:
    """Log density of each step under each state."""
    var = np.maximum(p.var, FLOOR)
    miss = y[None] - x @ p.weights
    return -0.5 * ((miss**2 / var[:, None]).sum(2) + np.log(2 * np.pi * var).sum(1)[:, None]).T


def recursions(log_b: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each sequence's log-likelihood, the state probabilities of each step, and the sum of all pairs' probabilities.

    log_b holds the sequences one after another. A step of the recursions is taken for all sequences that have it at once.
    """
    found = scaled(log_b, lengths, start, trans) if trans.min() >= STEADY and np.isfinite(log_b.max(1)).all() else None
    return logarithmic(log_b, lengths, start, trans) if found is None else found


def scaled(log_b: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """`recursions` by weights that sum to 1 at each step, held step by step for all sequences.

    As every state is entered from every other with at least STEADY, and the likeliest state of a step weighs 1, what underflows
    is below 1e-100 of a step's weights, there and at all later steps. Only a first step may weigh nothing: then there is no result.
    """
    k, begin = log_b.shape[1], np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, size = begin[order], lengths[order]
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # how many sequences have more than t steps
    off = np.concatenate([[0], np.cumsum(active)])
    t = np.repeat(np.arange(len(active)), active)
    at = first[np.arange(len(t)) - off[t]] + t
    top = log_b.max(1)
    e = np.ascontiguousarray(np.exp(log_b - top[:, None])[at].T)
    alpha, beta, mass, xi = np.empty_like(e), np.ones_like(e), np.empty(len(at)), np.zeros((k, k))
    for t in range(len(active)):
        lo, hi = off[t], off[t + 1]
        weight = (trans.T @ alpha[:, off[t - 1] : off[t - 1] + hi - lo] if t else start[:, None]) * e[:, lo:hi]
        mass[lo:hi] = weight.sum(0)
        if t == 0 and mass[:hi].min() < SEEN:
            return None
        alpha[:, lo:hi] = weight / mass[lo:hi]
    for t in range(len(active) - 1, 0, -1):
        lo, hi = off[t], off[t + 1]
        before, weight = slice(off[t - 1], off[t - 1] + hi - lo), e[:, lo:hi] * beta[:, lo:hi] / mass[lo:hi]
        beta[:, before] = trans @ weight
        xi += alpha[:, before] @ weight.T
    alpha *= beta
    alpha /= alpha.sum(0)
    gamma, steps = np.empty_like(log_b), np.empty(len(at))
    gamma[at], steps[at] = alpha.T, np.log(mass)
    return np.add.reduceat(steps + top, begin), gamma, xi * trans


def logarithmic(log_b: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`recursions` on the log scale, for any parameters."""
    k, begin = log_b.shape[1], np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, size = begin[order], lengths[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")  # how many sequences have more than t steps
    with np.errstate(divide="ignore"):
        log_a, log_start = np.log(trans), np.log(start)
    alpha, beta = np.empty_like(log_b), np.zeros_like(log_b)
    alpha[first] = log_start + log_b[first]
    for t in range(1, int(size[0])):
        at = first[: active[t]] + t
        alpha[at] = log_b[at] + log_sum_exp(alpha[at - 1][:, :, None] + log_a, 1)
    for t in range(int(size[0]) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        beta[at] = log_sum_exp(log_a + (log_b[at + 1] + beta[at + 1])[:, None, :], 2)
    total = log_sum_exp(alpha[begin + lengths - 1], 1)
    each = np.repeat(total, lengths)
    gamma = np.exp(alpha + beta - each[:, None])
    gamma /= gamma.sum(1, keepdims=True)
    xi, inner = np.zeros((k, k)), np.ones(len(log_b), bool)
    inner[begin + lengths - 1] = False
    inner = np.flatnonzero(inner)
    for lo in range(0, len(inner), PAIR_STEPS):
        at = inner[lo : lo + PAIR_STEPS]
        xi += np.exp(alpha[at][:, :, None] + log_a + (log_b[at + 1] + beta[at + 1])[:, None, :] - each[at][:, None, None]).sum(0)
    return total, gamma, xi


def best_paths(log_b: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The likeliest path of each sequence, one after another as log_b is; ties go to the lowest state."""
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, size = begin[order], lengths[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")
    with np.errstate(divide="ignore"):
        log_a, score = np.log(trans), np.log(start) + log_b[first]
    back, path = np.zeros(log_b.shape, np.int32), np.empty(len(log_b), np.int64)
    for t in range(1, int(size[0])):
        n = active[t]
        each = score[:n, :, None] + log_a
        back[first[:n] + t] = each.argmax(1)
        score[:n] = each.max(1) + log_b[first[:n] + t]
    path[first + size - 1] = score.argmax(1)
    for t in range(int(size[0]) - 1, 0, -1):
        at = first[: active[t]] + t
        path[at - 1] = back[at, path[at]]
    return path


def forward_backward(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """`recursions` of one sequence."""
    total, gamma, xi = recursions(log_b, np.array([len(log_b)]), start, trans)
    return float(total[0]), gamma, xi


def viterbi(log_b: np.ndarray, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """`best_paths` of one sequence."""
    return best_paths(log_b, np.array([len(log_b)]), start, trans)


def portions(x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sequences of an Arrow array together, up to PORTION cells of steps and features: first one's place, steps and lengths."""
    lengths, inner = np.diff(x.offsets.to_numpy()), x.flatten()
    d = len(inner[0]) if len(inner) else 1
    y = np.asarray(inner.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        begin = ends[at] - lengths[at]
        stop = max(at + 1, int(np.searchsorted(ends, begin + PORTION // d, "right")))
        yield at, y[begin : ends[stop - 1]], lengths[at:stop].astype(np.int64)
        at = stop


def sequences(steps: DataFrame) -> DataFrame:
    """(sid, x) from rows (sid, t, y): one row for each sequence, its steps in order. A sequence has to fit a task's memory."""
    rows = steps.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("rows"))
    return rows.select("sid", F.transform("rows", lambda r: r["y"]).alias("x"))


def blocks(seqs: DataFrame) -> DataFrame:
    """lengths and cells: sequences (x) one after another as plain numbers, up to PORTION of them a row. Sequences that are such
    already stay."""
    if "cells" in seqs.columns:
        return seqs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, y, lengths in portions(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"lengths": pa.array([lengths.tobytes()], pa.binary()), "cells": pa.array([y.tobytes()], pa.binary())})

    return seqs.select("x").mapInArrow(run, "lengths binary, cells binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Steps and lengths of each block."""
    for batch in batches:
        for lengths, cells in zip(batch.column(0), batch.column(1)):
            n = np.frombuffer(lengths.as_buffer(), np.int64)
            yield np.frombuffer(cells.as_buffer(), np.float64).reshape(int(n.sum()), -1), n


#: Figures of all partitions' statistics that the driver sums itself.
FEW_FIGURES = 1 << 20
#: Cells of a partition from which it is worth a task of its own, and to which a task may grow before there are more of them.
FEW_CELLS, MANY_CELLS = 1 << 16, 1 << 22


def shapes_of(p: Parameters) -> list[tuple[int, ...]]:
    """Of log-likelihood, first steps, all steps, pairs, and the weighted sums of y, y * y, lags by lags and lags by y."""
    k, d = p.var.shape
    m = d * p.order + 1
    return [(1,), (k,), (k,), (k, k), (k, d), (k, d), (k, m, m), (k, m, d)]


def weighted_moments(y: np.ndarray, z: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sums over steps that each state's probabilities weigh."""
    weighted = [z.T * g[:, s] for s in range(g.shape[1])]
    return g.sum(0), g.T @ y, g.T @ (y * y), np.stack([w @ z for w in weighted]), np.stack([w @ y for w in weighted])


def packed(moments: tuple[np.ndarray, ...], loglik: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """All statistics in one array, in the order of shapes_of."""
    mass, *rest = moments
    return np.concatenate([v.ravel() for v in (loglik, first, mass, pairs, *rest)])


def statistics(seqs: DataFrame, p: Parameters, parts: int | None = None) -> list[np.ndarray]:
    """Log-likelihood, sums of first-step and all-step probabilities, pairs, and weighted moments, over all sequences or blocks.

    parts: the rows' partitions, where known; as many rows as these are summed on the driver if they hold few figures.
    """
    shapes = shapes_of(p)
    sizes = [int(np.prod(s)) for s in shapes]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes))
        for y, lengths in unpacked(batches):
            z = all_lagged(y, lengths, p.order)
            ll, g, xi = recursions(emission(y, z, p), lengths, p.start, p.trans)
            total += packed(weighted_moments(y, z, g), np.array([ll.sum()]), g[np.cumsum(lengths) - lengths].sum(0), xi)
        yield pa.RecordBatch.from_pydict({"stats": pa.array([total], pa.list_(pa.float64()))})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stats": [np.stack(pdf["stats"]).sum(0).tolist()]})

    partial = blocks(seqs).mapInArrow(reduce, "stats array<double>")
    if parts is None or parts * sum(sizes) > FEW_FIGURES:
        partial = partial.withColumn("salt", F.spark_partition_id() % 16).groupBy("salt").applyInPandas(add, "stats array<double>")
    rows = partial.collect()  # at most 16, or parts, rows
    total = np.sum([r["stats"] for r in rows], axis=0) if rows else np.zeros(sum(sizes))
    return [v.reshape(s) for v, s in zip(np.split(total, np.cumsum(sizes)[:-1]), shapes)]


@contextmanager
def kept(seqs: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """The sequences' blocks, persisted meanwhile, and their partitions: as many as can run at once if each has FEW_CELLS, more if
    one had over MANY_CELLS. An iteration over few steps takes as long as its tasks take to start."""
    held = blocks(seqs).persist()
    try:
        cells = (held.agg(F.sum(F.octet_length("cells"))).first()[0] or 0) // 8
        most = held.rdd.getNumPartitions()
        parts = max(1, min(most, cells // FEW_CELLS, max(seqs.sparkSession.sparkContext.defaultParallelism, cells // MANY_CELLS)))
        yield held.coalesce(parts), parts
    finally:
        held.unpersist()


def initial(seqs: DataFrame, k: int, order: int, seed: int) -> Parameters:
    """Uniform start and transitions, small random weights, and the grand mean and variance for every state."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, _ in unpacked(batches):
            yield pa.RecordBatch.from_pydict({"p": pa.array(range(y.shape[1]), pa.int32()), "n": pa.array([len(y)] * y.shape[1], pa.int64()), "v": pa.array(y.sum(0)), "q": pa.array((y * y).sum(0))})

    sums = blocks(seqs).mapInArrow(moments, "p int, n long, v double, q double").groupBy("p")
    rows = sums.agg((F.sum("v") / F.sum("n")).alias("m"), (F.sum("q") / F.sum("n")).alias("q")).orderBy("p").collect()
    mean = np.array([r["m"] for r in rows])
    var = np.maximum(np.array([r["q"] for r in rows]) - mean**2, FLOOR)
    d = len(mean)
    weights = np.random.default_rng(seed).normal(0.0, 0.01, (k, d * order + 1, d))
    return Parameters(np.full(k, 1 / k), np.full((k, k), 1 / k), weights, np.tile(var, (k, 1)), np.tile(mean, (k, 1)), order)


def update(stats: list[np.ndarray], p: Parameters) -> Parameters:
    """The closed-form step: ridge on the weights only; the variance is of the residual without the ridge."""
    ll, first, mass, xi, gy, gyy, zz, zy = stats
    k, d = p.var.shape
    rows = xi.sum(1, keepdims=True)
    trans = np.where(rows > 0, xi / np.where(rows > 0, rows, 1), 1 / k)
    weights, var = np.empty_like(p.weights), np.empty_like(p.var)
    safe = np.maximum(mass, 1e-12)
    for s in range(k):
        a = zz[s] + RIDGE * np.eye(len(zz[s]))
        try:
            w = np.linalg.solve(a, zy[s])
        except np.linalg.LinAlgError:
            w = np.linalg.lstsq(a, zy[s], rcond=None)[0]
        left = gyy[s] - 2 * (w * zy[s]).sum(0) + np.einsum("md,mn,nd->d", w, zz[s], w)
        weights[s], var[s] = w, np.maximum(left / safe[s], FLOOR)
    return Parameters(first / max(first.sum(), 1e-12), trans, weights, var, gy / safe[:, None], p.order, float(ll[0]))


def fit(seqs: DataFrame, k: int, order: int = 1, max_iter: int = 100, seed: int = 42, tol: float | None = None) -> Parameters:
    """A fixed number of iterations, or fewer with a tolerance on the log-likelihood's relative gain.

    The log-likelihood kept is of the parameters before the last update. The sequences' blocks are persisted while it runs.
    """
    with kept(seqs) as (held, parts):
        p = initial(held, k, order, seed)
        for _ in range(max_iter):
            new = update(statistics(held, p, parts), p)
            LOG.info("iteration: log-likelihood %.6f, gain %.6g", new.loglik, new.loglik - p.loglik)
            done = tol is not None and abs(new.loglik - p.loglik) <= tol * max(1.0, abs(new.loglik))
            p = new
            if done:
                break
        return p


def score(seqs: DataFrame, p: Parameters) -> float:
    """Sum of the sequences' log-likelihoods."""
    return float(statistics(seqs, p)[0][0])


def decode(seqs: DataFrame, p: Parameters) -> DataFrame:
    """sid, t, s (likeliest path), g (probabilities), loglik (of the sequence): all of a sequence in one pass."""
    shared = seqs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for at, y, lengths in portions(batch.column(1)):
                log_b = emission(y, all_lagged(y, lengths, p.order), p)
                ll, g, _ = recursions(log_b, lengths, p.start, p.trans)
                own = np.repeat(np.arange(len(lengths)), lengths)
                t = np.arange(len(y)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                path = best_paths(log_b, lengths, p.start, p.trans)
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * g.shape[1]), pa.array(g.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + own)), pa.array(t.astype(np.int32)), pa.array(path.astype(np.int32)), each, pa.array(ll[own])], ["sid", "t", "s", "g", "loglik"])

    return seqs.select("sid", "x").mapInArrow(run, f"sid {seqs.schema['sid'].dataType.simpleString()}, t int, s int, g array<double>, loglik double")


def aligned(a: np.ndarray, b: np.ndarray) -> list[int]:
    """For each state of b its partner in a: greedy by distance of their means, each used once."""
    cost = ((a[:, None] - b[None]) ** 2).sum(2)
    out = [-1] * len(b)
    for i, j in sorted(np.ndindex(*cost.shape), key=lambda ij: cost[ij]):
        if out[j] < 0 and i not in out:
            out[j] = i
    return out


class SwitchingLinear:
    """The second backend's interface; as yet it has no implementation."""

    def fit(self, *_args, **_how):
        raise NotImplementedError("the switching linear model is not implemented")

    score = predict = predict_proba = fit


BACKENDS = {"arhmm": fit, "slds": SwitchingLinear().fit}


def backend(name: str):
    """The fitting function of a backend, by name in any case, with - or _."""
    key = name.lower().replace("-", "_")
    if key not in BACKENDS:
        raise ValueError(f"unknown backend {name}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[key]
