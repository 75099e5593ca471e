"""Occupancy of a stream of state steps, and forward-filtered state probabilities, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from statewalk.operators.arhmm import Parameters, emission, log_sum_exp


def windowed_occupancy(steps: DataFrame, window: str, late: str) -> DataFrame:
    """start, s, n of steps (ts, s): counts by tumbling event-time window; rows later than `late` are dropped."""
    return steps.withWatermark("ts", late).groupBy(F.window("ts", window), "s").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "s", "n")


def filtered(steps: DataFrame, p: Parameters) -> DataFrame:
    """sid, t, g for each step of a stream (sid, t, y): the state probabilities given the steps so far.

    A sequence's state is its last observations and its normalised log weights, of a size set by the model. Within a batch
    steps are put in order; a step that comes after a later one of its sequence was handled is passed by.
    """
    k, order = len(p.start), p.order

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, weights, memory = state.get if state.exists else (-1, [], [])
        past = [np.array(m) for m in (memory[i : i + len(memory) // order] for i in range(0, len(memory), len(memory) // order))] if memory and order else []
        rows = pd.concat(list(batches)).sort_values("t")
        times, out = [], []
        for t, y in zip(rows["t"], rows["y"]):
            if t <= last:
                continue
            y = np.asarray(y, np.float64)
            past = past or [y] * order
            x = np.concatenate([*past, np.ones(1)]) if order else np.ones(1)
            log_b = emission(y[None], x[None], p)[0]
            with np.errstate(divide="ignore"):
                prior = log_sum_exp(np.array(weights)[:, None] + np.log(p.trans), 0) if weights else np.log(p.start)
            w = prior + log_b
            w -= log_sum_exp(w, 0)
            weights, last = w.tolist(), int(t)
            past = ([y] + past)[:order] if order else []
            times.append(int(t))
            out.append(np.exp(w).tolist())
        state.update((last, weights, [float(v) for m in past for v in m]))
        yield pd.DataFrame({"sid": [key[0]] * len(times), "t": times, "g": out})

    assert k > 0
    return steps.groupBy("sid").applyInPandasWithState(step, "sid long, t int, g array<double>", "last long, weights array<double>, past array<double>", "append", GroupStateTimeout.NoTimeout)
