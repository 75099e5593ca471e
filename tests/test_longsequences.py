"""Chunked recursions and segment summaries against the forms that hold a sequence in one place."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.operators import arhmm, longsequences, sequences


def model(order: int, k: int = 3, d: int = 2) -> arhmm.Parameters:
    rng = np.random.default_rng(order)
    trans = rng.random((k, k)) + 0.2
    trans[0, 2] = 0.0  # a step that can't be
    return arhmm.Parameters(np.array([0.7, 0.3, 0.0]), trans / trans.sum(1, keepdims=True), rng.normal(0, 0.4, (k, d * order + 1, d)), rng.random((k, d)) + 0.3, rng.normal(size=(k, d)), order)


def data(lengths: dict, d: int = 2):
    rng = np.random.default_rng(1)
    return [(sid, t, rng.normal(size=d).tolist()) for sid, n in lengths.items() for t in range(n)]


@pytest.mark.parametrize(("order", "size"), [(1, 7), (2, 10), (0, 5), (1, 1000), (3, 3)])
def test_decoding_in_chunks(spark, order, size):
    p = model(order)
    steps = spark.createDataFrame(data({"sub-01": 100, "sub-02": 1, "sub-03": 21, "sub-04": 70}), "sid string, t int, y array<double>").repartition(5)
    want = {(r["sid"], r["t"]): r for r in arhmm.decode(arhmm.sequences(steps), p).collect()}
    got = {(r["sid"], r["t"]): r for r in longsequences.decode(longsequences.chunks(steps, order, size), p).collect()}
    assert set(got) == set(want)
    for key, r in want.items():
        assert got[key]["s"] == r["s"] and got[key]["loglik"] == pytest.approx(r["loglik"], abs=1e-9)
        np.testing.assert_allclose(got[key]["g"], r["g"], atol=1e-9)


def test_ties_go_to_the_lowest_state(spark):
    p = arhmm.Parameters(np.full(2, 0.5), np.full((2, 2), 0.5), np.zeros((2, 2, 1)), np.ones((2, 1)), np.zeros((2, 1)), 1)
    steps = spark.createDataFrame(data({"a": 23}, 1), "sid string, t int, y array<double>")
    assert {r["s"] for r in longsequences.decode(longsequences.chunks(steps, 1, 4), p).collect()} == {0}


@pytest.mark.parametrize("size", [6, 500])
def test_statistics_and_fit_in_chunks(spark, size):
    p = model(1)
    steps = spark.createDataFrame(data({1: 60, 2: 3, 3: 31}), "sid long, t int, y array<double>")
    parts = longsequences.chunks(steps, 1, size)
    for a, b in zip(longsequences.statistics(parts, p), arhmm.statistics(arhmm.sequences(steps), p)):
        np.testing.assert_allclose(a, b, atol=1e-8)
    seqs = arhmm.sequences(steps)
    want = arhmm.fit(seqs, 2, 1, 3, seed=5)
    got = longsequences.fit(parts, arhmm.initial(seqs, 2, 1, 5), 3)
    np.testing.assert_allclose(got.weights, want.weights, atol=1e-7)
    assert got.loglik == pytest.approx(want.loglik)


def test_a_million_steps_are_many_tasks(spark):
    """A sequence of 10**6 steps in chunks of 1,000: likelihood by the one-row recursion, no row over a chunk."""
    p = arhmm.Parameters(np.array([0.6, 0.4]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[[0.3], [0.0]], [[0.3], [2.0]]]), np.ones((2, 1)), np.zeros((2, 1)), 1)
    n = 1_000_000
    steps = spark.range(n).select(F.lit("a").alias("sid"), F.col("id").alias("t"), F.array((F.pmod(F.col("id") * 7919, F.lit(1009)) / 300.0)).alias("y"))
    parts = longsequences.chunks(steps, 1, 1000)
    assert parts.count() == 1000 and parts.agg(F.max(F.size("x"))).first()[0] == 1001
    found = longsequences.borders(longsequences.summaries(parts, p, longsequences.autoregressive(p)), 2).select("loglik").distinct().collect()
    y = ((np.arange(n) * 7919) % 1009 / 300.0)[:, None]
    log_b = arhmm.emission(y, arhmm.lagged(y, 1), p)
    a, alpha = np.log(p.trans), np.log(p.start) + log_b[0]
    for row in log_b[1:]:
        x = alpha[:, None] + a
        top = x.max(0)
        alpha = top + np.log(np.exp(x - top).sum(0)) + row
    assert found[0]["loglik"] == pytest.approx(np.logaddexp(*alpha), rel=1e-11)


def hot(spark):
    """Nine of ten steps are of one sequence, which has long runs over several chunks."""
    rng = np.random.default_rng(2)
    rows = []
    for sid, n in (("big", 900), ("one", 1), ("small", 60), ("flat", 39)):
        s = np.repeat(rng.integers(0, 3, n), rng.integers(1, 40, n))[:n] if sid != "flat" else np.zeros(n, int)
        rows += [(sid, t, int(x)) for t, x in enumerate(s)]
    return spark.createDataFrame(rows, "sid string, t int, s int").repartition(6)


@pytest.mark.parametrize("chunk", [1, 7, 16])
def test_segments_of_a_hot_sequence(spark, chunk):
    seq = hot(spark)

    def rows(df):
        return sorted(map(tuple, df.collect()))

    assert rows(sequences.runs(seq, chunk)) == rows(sequences.runs(seq))
    assert rows(sequences.dwell(seq, 3, chunk)) == rows(sequences.dwell(seq, 3))
    assert rows(sequences.transition_counts(seq, 3, chunk)) == rows(sequences.transition_counts(seq, 3))
    assert rows(sequences.switch_global(seq, chunk)) == rows(sequences.switch_global(seq))
    for name, f in (("previous", sequences.with_previous), ("next", sequences.with_next)):
        assert rows(f(seq, "s", name, chunk)) == rows(f(seq, "s", name))


def test_runs_by_definition(spark):
    seq = hot(spark)
    want = []
    for sid, part in (lambda all_: {s: sorted((t, x) for ss, t, x in all_ if ss == s) for s in {a for a, _, _ in all_}})([tuple(r) for r in seq.collect()]).items():
        start = 0
        for t in range(1, len(part) + 1):
            if t == len(part) or part[t][1] != part[start][1]:
                want.append((sid, part[start][1], start, t - start))
                start = t
    assert sorted(map(tuple, sequences.runs(seq, 16).select("sid", "s", "t0", "length").collect())) == sorted(want)


def test_no_window_holds_the_hot_sequence(spark):
    """The most rows that a window's partition holds are those of a chunk and its border."""
    held = sequences.beside_borders(hot(spark), 16).groupBy("sid", "_c").count().agg(F.max("count")).first()[0]
    assert held == 17
