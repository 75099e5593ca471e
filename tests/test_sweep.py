"""Fits of a sweep run beside one another."""

from __future__ import annotations

import threading

import numpy as np

from statewalk.operators import arhmm
from statewalk.plans import selection


def test_fits_meet(spark):
    """Two fits reach a detector that waits for both; the scorecard keeps the order of k and seed."""
    rng, both = np.random.default_rng(0), threading.Barrier(2)
    seqs = arhmm.sequences(spark.createDataFrame([(i, t, [float(v)]) for i in range(4) for t, v in enumerate(rng.normal(size=9))], "sid long, t int, y array<double>"))

    def meet(fit, _settings):
        both.wait(120)
        return selection.Found("met", {"seed": float(fit.seed)})

    rows = selection.sweep(seqs, [2], [2, 1], (meet,), max_iter=2).collect()
    assert [(r["k"], r["seed"], r["met__seed"]) for r in rows] == [(2, 1, 1), (2, 2, 2)]
