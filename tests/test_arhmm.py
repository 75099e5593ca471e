"""The model against enumeration of all paths, and invariants of its fit."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

from statewalk.operators import arhmm


def model(k=2, d=1, order=1, seed=0):
    rng = np.random.default_rng(seed)
    trans = rng.dirichlet(np.ones(k), k)
    return arhmm.Parameters(rng.dirichlet(np.ones(k)), trans, rng.normal(size=(k, d * order + 1, d)), rng.uniform(0.5, 2, (k, d)), np.zeros((k, d)), order)


@pytest.mark.parametrize("k, n", [(2, 6), (3, 5), (2, 1)])
def test_against_all_paths(k, n):
    p = model(k)
    y = np.random.default_rng(n).normal(size=(n, 1))
    log_b = arhmm.emission(y, arhmm.lagged(y, 1), p)
    paths = list(itertools.product(range(k), repeat=n))
    score = np.array([np.log(p.start[s[0]]) + sum(log_b[t, s[t]] for t in range(n)) + sum(np.log(p.trans[a, b]) for a, b in zip(s, s[1:])) for s in paths])
    ll, gamma, xi = arhmm.forward_backward(log_b, p.start, p.trans)
    assert ll == pytest.approx(np.log(np.exp(score).sum()))
    weight = np.exp(score - ll)
    assert gamma == pytest.approx(np.array([[sum(w for w, s in zip(weight, paths) if s[t] == i) for i in range(k)] for t in range(n)]))
    assert xi.sum() == pytest.approx(n - 1)
    assert tuple(arhmm.viterbi(log_b, p.start, p.trans)) == paths[int(score.argmax())]


def test_lags_repeat_the_first_observation():
    y = np.arange(4.0)[:, None]
    assert arhmm.lagged(y, 2)[:, :2].tolist() == [[0, 0], [0, 0], [1, 0], [2, 1]]
    assert arhmm.lagged(y, 0).tolist() == [[1]] * 4


def test_fit_climbs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, t, [float(v)]) for i in range(6) for t, v in enumerate(np.repeat(rng.choice([-3.0, 3.0], 5), 6) + rng.normal(size=30) * 0.3)]
    seqs = arhmm.sequences(spark.createDataFrame(rows, "sid long, t int, y array<double>")).cache()
    p, seen = arhmm.initial(seqs, 2, 1, 7), []
    for _ in range(6):
        p = arhmm.update(arhmm.statistics(seqs, p), p)
        seen.append(p.loglik)
    assert all(b >= a - 1e-3 for a, b in zip(seen, seen[1:])) and p.trans.sum(1) == pytest.approx([1, 1])
    assert arhmm.score(seqs, p) >= seen[-1] - 1e-3
    out = arhmm.decode(seqs, p)
    assert out.count() == 180
    assert all(sum(r["g"]) == pytest.approx(1) for r in out.limit(5).collect())


def test_backends():
    assert arhmm.backend("AR-HMM".replace("-", "", 1)) is arhmm.fit
    with pytest.raises(NotImplementedError):
        arhmm.backend("slds")()
    with pytest.raises(ValueError):
        arhmm.backend("other")


@pytest.mark.parametrize("order", [0, 1, 3])
def test_lags_of_many_sequences(order):
    y, lengths = np.random.default_rng(0).normal(size=(15, 2)), np.array([6, 1, 2, 4, 2])
    want = np.concatenate([arhmm.lagged(x, order) for x in np.split(y, np.cumsum(lengths)[:-1])])
    assert (arhmm.all_lagged(y, lengths, order) == want).all()


@pytest.mark.parametrize("far", [1.0, 60.0])
def test_recursions_without_logarithms(far):
    """Steps of which a state underflows are those of the log scale, and a first step that can't be isn't taken."""
    p, rng = model(3, seed=4), np.random.default_rng(5)
    lengths = np.array([7, 30, 1, 12, 30])
    log_b = rng.normal(size=(lengths.sum(), 3)) * far**2
    for a, b in zip(arhmm.scaled(log_b, lengths, p.start, p.trans), arhmm.logarithmic(log_b, lengths, p.start, p.trans)):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    log_b[0] = [0.0, -900.0, -900.0]
    start = np.array([0.0, 0.5, 0.5])
    assert arhmm.scaled(log_b, lengths, start, p.trans) is None
    assert np.isfinite(arhmm.recursions(log_b, lengths, start, p.trans)[0]).all()


def test_a_fit_keeps_plain_blocks(spark):
    """Of 40 sequences an iteration reads blocks of plain numbers, no row or array a step."""
    rng = np.random.default_rng(1)
    rows = [(i, t, rng.normal(size=2).tolist()) for i in range(40) for t in range(5 + i % 7)]
    seqs = arhmm.sequences(spark.createDataFrame(rows, "sid long, t int, y array<double>")).cache()
    held = arhmm.blocks(seqs)
    found = held.collect()
    assert held.columns == ["lengths", "cells"] and len(found) <= 4 and sum(len(r["cells"]) // 16 for r in found) == len(rows)
    p = arhmm.initial(held, 2, 1, 3)
    for a, b in zip(arhmm.statistics(held, p), arhmm.statistics(seqs, p, 4)):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_portions_are_cut_by_size(monkeypatch):
    monkeypatch.setattr(arhmm, "PORTION", 64)
    lengths = [5, 30, 2, 100, 1, 31, 32]
    x = pa.array([np.random.default_rng(n).normal(size=(n, 2)).tolist() for n in lengths])[1:]
    found = list(arhmm.portions(x))
    assert [n.tolist() for _, _, n in found] == [[30, 2], [100], [1, 31], [32]] and [at for at, _, _ in found] == [0, 2, 3, 5]
    assert np.concatenate([y for _, y, _ in found]).tolist() == [v for s in x.to_pylist() for v in s]


def test_few_steps_are_few_tasks(spark):
    """What is kept for iterations has no more partitions than its steps are worth, however many the sequences have."""
    rows = [(i, t, [float(t)]) for i in range(40) for t in range(5)]
    seqs = arhmm.sequences(spark.createDataFrame(rows, "sid long, t int, y array<double>")).repartition(8)
    with arhmm.kept(seqs) as (held, parts):
        assert parts == held.rdd.getNumPartitions() == 1 and sum(len(r["cells"]) for r in held.collect()) == 8 * len(rows)
