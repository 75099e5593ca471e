"""Exact quantiles in shared passes against sorting; soft maps in parts against the pseudo-inverse."""

from __future__ import annotations

import numpy as np
import pytest

from statewalk.operators import matrices, posterior, quantiles


@pytest.mark.parametrize("kind", ["even", "skewed", "alike", "extreme", "close", "tiny"])
def test_quantiles(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "BINS", 8)
    monkeypatch.setattr(quantiles, "FETCHED", 5)
    rng = np.random.default_rng(4)
    values = {
        "even": lambda n: rng.random(n),
        "skewed": lambda n: np.exp(rng.normal(size=n) * 12),
        "alike": lambda n: rng.integers(0, 3, n).astype(float),
        "extreme": lambda n: rng.choice([-1.7e308, 1.7e308, 0.0, -1e-300, 5.0], n),
        "close": lambda n: 1.0 + rng.integers(0, 4, n) * 2.0**-52,
        "tiny": lambda n: rng.integers(0, 4, n) * 5e-324,
    }[kind]
    groups = {("a", 1): values(300), ("a", None): values(1), (None, 2): values(57)}
    rows = [(*g, float(v)) for g, x in groups.items() for v in x] + [("a", 1, None), ("a", 1, float("nan")), ("none", 9, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(3)
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["h"]): r["q"] for r in quantiles.quantiles(df, ["g", "h"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        x = sorted(x)
        for share, q in zip(shares, got[g]):
            place = share * (len(x) - 1)
            low, high = x[int(np.floor(place))], x[int(np.ceil(place))]
            assert q == pytest.approx(low + (high - low) * (place - np.floor(place)), rel=1e-12, abs=5e-324, nan_ok=True)


def test_quantiles_of_nothing(spark):
    assert quantiles.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0
    none = posterior.sharpness(spark.createDataFrame([], "sid string, t int, g array<double>"), 2).first()
    assert none["steps"] == 0 and none["median"] is None


def test_passes_dont_grow_with_the_ranks(spark, monkeypatch):
    calls = []
    refine = quantiles._refine
    monkeypatch.setattr(quantiles, "_refine", lambda *a: (calls.append(1), refine(*a))[1])
    df = spark.range(20_000).selectExpr("id % 4 as g", "id * 0.37 as v")
    quantiles.quantiles(df, ["g"], "v", [i / 20 for i in range(21)])
    assert len(calls) == 1


@pytest.mark.parametrize("chunk", [3, 10, 4096])
@pytest.mark.parametrize("near", [False, True])
def test_soft_maps(spark, chunk, near):
    """Ids of any text; a posterior in which one state follows from the others has the pseudo-inverse's answer."""
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for sid, n in (("sub-01", 40), ("007", 7), ("x", 2)):
        g = rng.dirichlet(np.ones(3), n)
        if near:
            g[:, 2] = g[:, 0] * (1 + 1e-12)
        y = rng.normal(size=(n, 4))
        b = np.linalg.pinv(g, rcond=1e-6) @ y
        want[sid] = b - g.mean(0) @ b
        rows += [(sid, t, g[t].tolist(), y[t].tolist()) for t in range(n)]
    got: dict = {s: np.zeros((3, 4)) for s in want}
    for r in matrices.beta_maps_soft(spark.createDataFrame(rows, "sid string, t int, g array<double>, y array<double>").repartition(4), chunk=chunk).collect():
        got[r["sid"]][r["s"], r["p"]] = r["beta"]
    for sid, b in want.items():
        np.testing.assert_allclose(got[sid], b, atol=1e-8)


def test_soft_maps_take_arrow_groups(spark):
    """A group's numbers reach the factorisation without an object for each step."""
    df = spark.createDataFrame([("a", t, [0.5, 0.5], [float(t)]) for t in range(4)], "sid string, t int, g array<double>, y array<double>")
    plan = matrices.beta_maps_soft(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and "InPandas" not in plan
