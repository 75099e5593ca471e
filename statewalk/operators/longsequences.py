"""Hidden Markov recursions over sequences of any length: chunks of steps in many tasks, joined by an associative scan.

A chunk of steps is, for the recursions, a matrix of k x k log weights from the state before it to its last state: products by
log-sum-exp for the probabilities, by the maximum for the likeliest path. These summaries are multiplied in order, one small
row a chunk, which gives the vector that enters each chunk and the one that leaves it. With these a chunk's own recursions run
by themselves. The path needs one more exchange: with the entering scores each chunk says which state it would be entered from
for each state it may end in, and these maps are followed back from the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.operators.arhmm import Parameters, emission, lagged, log_sum_exp, packed, shapes_of, update, weighted_moments

#: Steps of a chunk.
CHUNK = 4096
#: log densities (steps, k) of a chunk's own steps from its steps with those before it, and how many these are.
Emit = Callable[[np.ndarray, int], np.ndarray]


def chunks(steps: DataFrame, order: int = 1, size: int = CHUNK) -> DataFrame:
    """sid, c, t0 (of the chunk's first own step), halo (steps before it that the lags need) and x (halo and own steps) of rows
    (sid, t, y), whose t count from 0 without gaps. A sequence is as many rows as it has chunks."""
    if size < max(order, 1):
        raise ValueError("a chunk has to hold the lags")
    c = F.floor(F.col("t") / size).cast("long")
    both = F.when(F.col("t") % size >= size - order, F.array(c, c + 1)).otherwise(F.array(c))
    rows = steps.select("sid", "t", "y", F.explode(both).alias("c"))
    own = F.col("t") >= F.col("c") * size
    out = rows.groupBy("sid", "c").agg(F.count(F.when(own, 1)).alias("_own"), F.count(F.when(~own, 1)).cast("int").alias("halo"), F.sort_array(F.collect_list(F.struct("t", "y"))).alias("rows"))
    return out.where("_own > 0").select("sid", "c", (F.col("c") * size).alias("t0"), "halo", F.transform("rows", lambda r: r["y"]).alias("x"))


def autoregressive(p: Parameters) -> Emit:
    """The densities of a fitted model."""

    def emit(x: np.ndarray, halo: int) -> np.ndarray:
        return emission(x[halo:], lagged(x, p.order)[halo:], p)

    return emit


def _logs(p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        return np.log(p.start), np.log(p.trans)


def _matrix(x) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64).reshape(-1) for v in x])


class Batch:
    """Chunks of one Arrow batch, worked on in step: log densities (chunks, steps, k), padded, and lengths."""

    def __init__(self, pdf: pd.DataFrame, emit: Emit):
        each = [emit(_matrix(x), int(h)) for x, h in zip(pdf["x"], pdf["halo"])]
        self.lengths = np.array([len(b) for b in each])
        self.first = pdf["c"].to_numpy() == 0
        self.log_b = np.zeros((len(each), int(self.lengths.max()), each[0].shape[1]))
        for i, b in enumerate(each):
            self.log_b[i, : len(b)] = b

    def active(self, t: int) -> np.ndarray:
        return np.flatnonzero(self.lengths > t)


def _products(b: Batch, log_start: np.ndarray, log_a: np.ndarray, join) -> np.ndarray:
    """The weights from the state before each chunk to its last state. join: sum or maximum of logs along an axis."""
    out = np.where(b.first[:, None, None], log_start[None, None], log_a[None]) + b.log_b[:, 0][:, None, :]
    for t in range(1, b.log_b.shape[1]):
        at = b.active(t)
        out[at] = join(out[at][:, :, :, None] + log_a, 2) + b.log_b[at, t][:, None, :]
    return out


def _greatest(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis)


def summaries(parts: DataFrame, p: Parameters, emit: Emit) -> DataFrame:
    """sid, c, total and best: the two k x k products of each chunk."""
    log_start, log_a = _logs(p)
    sid = parts.schema["sid"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = Batch(pdf, emit)
                total, best = (_products(b, log_start, log_a, join).reshape(len(pdf), -1) for join in (log_sum_exp, _greatest))
                yield pd.DataFrame({"sid": pdf["sid"], "c": pdf["c"], "total": list(total), "best": list(best)})

    return parts.mapInPandas(run, f"sid {sid}, c long, total array<double>, best array<double>")


def borders(summary: DataFrame, k: int) -> DataFrame:
    """sid, c, enter (log weights of the states before the chunk), leave (of what follows it, by its last state), score (of the
    best paths before it) and, the same for all chunks of a sequence, loglik and last (the path's last state).

    The summaries of a sequence are one group: as many rows as it has chunks.
    """
    sid = summary.schema["sid"].dataType.simpleString()

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        total, best = (np.stack(pdf[x]).reshape(-1, k, k) for x in ("total", "best"))
        n = len(pdf)
        enter, score, leave = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf), np.zeros((n, k))
        enter[0, 0] = score[0, 0] = 0.0  # the first chunk's weights are the same from every state
        for i in range(n):
            enter[i + 1] = log_sum_exp(enter[i][:, None] + total[i], 0)
            score[i + 1] = (score[i][:, None] + best[i]).max(0)
        for i in range(n - 1, 0, -1):
            leave[i - 1] = log_sum_exp(total[i] + leave[i][None], 1)
        return pd.DataFrame({"sid": pdf["sid"], "c": pdf["c"], "enter": list(enter[:-1]), "leave": list(leave), "score": list(score[:-1]), "loglik": float(log_sum_exp(enter[-1], 0)), "last": int(score[-1].argmax())})

    return summary.groupBy("sid").applyInPandas(scan, f"sid {sid}, c long, enter array<double>, leave array<double>, score array<double>, loglik double, last int")


def _back(b: Batch, log_start: np.ndarray, log_a: np.ndarray, score: np.ndarray) -> np.ndarray:
    """At each own step, for each state, the state before it on the best path (chunks, steps, k); ties go to the lowest."""
    back = np.zeros(b.log_b.shape, np.int32)
    for t in range(b.log_b.shape[1]):
        at = b.active(t)
        each = score[at][:, :, None] + (np.where(b.first[at][:, None, None], log_start[None, None], log_a[None]) if t == 0 else log_a)
        back[at, t] = each.argmax(1)
        score[at] = each.max(1) + b.log_b[at, t]
    return back


def _followed(b: Batch, back: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The path that ends in `last` through each chunk, and the state before the chunk."""
    n, steps, _ = back.shape
    path, state, rows = np.zeros((n, steps), np.int32), last.copy(), np.arange(n)
    for t in range(steps - 1, -1, -1):
        on = b.lengths > t
        path[on, t] = state[on]
        state = np.where(on, back[rows, t, state], state)
    return path, state


def entrances(parts: DataFrame, p: Parameters, emit: Emit) -> DataFrame:
    """sid, c, last and from (k states): the state before the chunk on the best path, for each state it may end in. parts: chunks
    with their borders."""
    log_start, log_a = _logs(p)
    k = len(p.start)
    sid = parts.schema["sid"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = Batch(pdf, emit)
                back = _back(b, log_start, log_a, np.stack(pdf["score"]).copy())
                origin = np.stack([_followed(b, back, np.full(len(pdf), s))[1] for s in range(k)], 1)
                yield pd.DataFrame({"sid": pdf["sid"], "c": pdf["c"], "last": pdf["last"], "origin": list(origin)})

    return parts.mapInPandas(run, f"sid {sid}, c long, last int, origin array<int>")


def endings(maps: DataFrame) -> DataFrame:
    """sid, c, ends: the state in which the best path leaves each chunk, from the maps of all, followed from the last one back."""
    sid = maps.schema["sid"].dataType.simpleString()

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        origin, ends, state = np.stack(pdf["origin"]), np.zeros(len(pdf), np.int32), int(pdf["last"].iloc[0])
        for i in range(len(pdf) - 1, -1, -1):
            ends[i] = state
            state = int(origin[i, state])
        return pd.DataFrame({"sid": pdf["sid"], "c": pdf["c"], "ends": ends})

    return maps.groupBy("sid").applyInPandas(scan, f"sid {sid}, c long, ends int")


def _probabilities(b: Batch, pdf: pd.DataFrame, log_start: np.ndarray, log_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alpha, beta and g (chunks, steps, k) of the own steps, from the vectors that enter and leave."""
    n, steps, k = b.log_b.shape
    alpha, beta = np.full((n, steps, k), -np.inf), np.full((n, steps, k), -np.inf)
    enter, leave, total = np.stack(pdf["enter"]), np.stack(pdf["leave"]), pdf["loglik"].to_numpy()
    alpha[:, 0] = log_sum_exp(enter[:, :, None] + np.where(b.first[:, None, None], log_start[None, None], log_a[None]), 1) + b.log_b[:, 0]
    for t in range(1, steps):
        at = b.active(t)
        alpha[at, t] = log_sum_exp(alpha[at, t - 1][:, :, None] + log_a, 1) + b.log_b[at, t]
    beta[np.arange(n), b.lengths - 1] = leave
    for t in range(steps - 2, -1, -1):
        at = b.active(t + 1)
        beta[at, t] = log_sum_exp(log_a + (b.log_b[at, t + 1] + beta[at, t + 1])[:, None, :], 2)
    g = np.exp(alpha + beta - total[:, None, None])
    mass = g.sum(2, keepdims=True)
    return alpha, beta, g / np.where(mass > 0, mass, 1)


def decode(parts: DataFrame, p: Parameters, emit: Emit | None = None) -> DataFrame:
    """sid, t, s (likeliest path), g (probabilities), loglik (of the sequence) of chunks: `arhmm.decode` for any length.

    The chunks are read three times: for their summaries, their maps, and the result.
    """
    emit = emit or autoregressive(p)
    log_start, log_a = _logs(p)
    sid = parts.schema["sid"].dataType.simpleString()
    bordered = parts.join(borders(summaries(parts, p, emit), len(p.start)), ["sid", "c"])
    whole = bordered.join(endings(entrances(bordered, p, emit)), ["sid", "c"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = Batch(pdf, emit)
                _, _, g = _probabilities(b, pdf, log_start, log_a)
                path, _ = _followed(b, _back(b, log_start, log_a, np.stack(pdf["score"]).copy()), pdf["ends"].to_numpy().astype(np.int64))
                for i, n in enumerate(b.lengths.tolist()):
                    yield pd.DataFrame({"sid": [pdf["sid"].iloc[i]] * n, "t": pdf["t0"].iloc[i] + np.arange(n), "s": path[i, :n], "g": list(g[i, :n]), "loglik": pdf["loglik"].iloc[i]})

    return whole.mapInPandas(run, f"sid {sid}, t long, s int, g array<double>, loglik double")


def statistics(parts: DataFrame, p: Parameters) -> list[np.ndarray]:
    """`arhmm.statistics` of chunks: a pair of steps belongs to the chunk of the later one."""
    emit = autoregressive(p)
    log_start, log_a = _logs(p)
    bordered = parts.join(borders(summaries(parts, p, emit), len(p.start)), ["sid", "c"])
    shapes = shapes_of(p)
    size = sum(int(np.prod(s)) for s in shapes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size)
        for pdf in batches:
            if not len(pdf):
                continue
            b = Batch(pdf, emit)
            alpha, beta, g = _probabilities(b, pdf, log_start, log_a)
            enter, total = np.stack(pdf["enter"]), pdf["loglik"].to_numpy()
            xi = np.zeros_like(log_a)
            for t in range(b.log_b.shape[1]):
                at = b.active(t) if t else np.flatnonzero(~b.first)
                before = alpha[at, t - 1] if t else enter[at]
                xi += np.exp(before[:, :, None] + log_a + (b.log_b[at, t] + beta[at, t])[:, None, :] - total[at][:, None, None]).sum(0)
            ll, first = np.array([total[b.first].sum()]), g[b.first, 0].sum(0)
            for i, (x, halo) in enumerate(zip(pdf["x"], pdf["halo"])):
                y = _matrix(x)
                sums += packed(weighted_moments(y[halo:], lagged(y, p.order)[halo:], g[i, : b.lengths[i]]), ll if i == 0 else ll * 0, first if i == 0 else first * 0, xi if i == 0 else xi * 0)
        yield pd.DataFrame({"i": np.arange(size), "v": sums})

    rows = bordered.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many as the model has figures
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return [v.reshape(s) for v, s in zip(np.split(out, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes)]


def fit(parts: DataFrame, initial: Parameters, max_iter: int = 100) -> Parameters:
    """A fixed number of iterations over chunks, from given parameters. The chunks are persisted meanwhile."""
    parts = parts.persist()
    try:
        p = initial
        for _ in range(max_iter):
            p = update(statistics(parts, p), p)
        return p
    finally:
        parts.unpersist()
