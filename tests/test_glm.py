"""The permutation model of parcels against least squares with every permutation written out."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from statewalk.operators import glm
from tests.test_permutations import plain

COLUMNS = ["intercept", "age", "sex"]


def fixture(n=17, parcels=4, seed=3):
    rng = np.random.default_rng(seed)
    design = {f"s{i:02d}": (1.0, float(rng.normal()), float(i % 2), int(i % 3)) for i in range(n)}
    rows = [(f, sid, f"p{p}", float(rng.normal() + 0.8 * x[2] * (p == 1) + x[1])) for f in (0, 1) for i, (sid, x) in enumerate(design.items()) if not (f == 1 and i == 4) for p in range(parcels)]
    rows = [r for r in rows if not (r[0] == 0 and r[1] == "s06" and r[2] == "p3")]  # a parcel that a subject lacks
    return rows, design


def brute(rows, design, contrast, n_perm, blocked, flip, two_tailed):
    out = {}
    for family in sorted({r[0] for r in rows}):
        sids = sorted({r[1] for r in rows if r[0] == family})
        x = np.array([design[s][:3] for s in sids])
        blocks = [design[s][3] if blocked else 0 for s in sids]
        value = {(r[1], r[2]): r[3] for r in rows if r[0] == family}
        parcels = sorted({r[2] for r in rows if r[0] == family})
        whole = [p for p in parcels if all((s, p) in value for s in sids)]
        y = np.array([[value[s, p] for p in whole] for s in sids])
        c = np.array(contrast, float)
        lead = np.flatnonzero(c)[0]
        others = np.delete(x - np.outer(x[:, lead], c / c[lead]), lead, 1)  # columns with no value of the contrast
        fit = others @ np.linalg.lstsq(others, y, rcond=None)[0]
        left = y - fit

        def t_of(y):
            beta, *_ = np.linalg.lstsq(x, y, rcond=None)
            rss = ((y - x @ beta) ** 2).sum(0) / (len(x) - x.shape[1])
            return c @ beta / np.sqrt(rss * (c @ np.linalg.inv(x.T @ x) @ c))

        ts = []
        for perm in range(n_perm + 1):
            moved = left.copy()
            if flip:
                for i, s in enumerate(sids):
                    if perm and hashlib.md5(f"42:{perm}:{s}".encode()).hexdigest()[0] < "8":
                        moved[i] = -left[i]
            else:
                for b in set(blocks):
                    at = [i for i, own in enumerate(blocks) if own == b]
                    for j, i in enumerate(at):
                        moved[at[plain(j, len(at), perm)]] = left[i]
            ts.append(t_of(fit + moved))
        most = [np.abs(t).max() if two_tailed else t.max() for t in ts[1:]]
        for i, p in enumerate(whole):
            own = abs(ts[0][i]) if two_tailed else ts[0][i]
            out[family, p] = (ts[0][i], (sum(m >= own - abs(own) * 1e-9 for m in most) + 1) / (n_perm + 1))
        out |= {(family, p): (None, None) for p in parcels if p not in whole}
    return out


@pytest.mark.parametrize(("contrast", "blocked", "flip", "two_tailed"), [((0, 0, 1), True, False, True), ((0, 1, -2), False, False, False), ((1, 0, 0), False, True, False), ((0.5, 0, 1), True, False, True)])
def test_design_test(spark, contrast, blocked, flip, two_tailed):
    rows, design = fixture()
    stack = spark.createDataFrame(rows, "f int, sid string, p string, value double").repartition(5)
    table = spark.createDataFrame([(s, *x) for s, x in design.items()] + [("nobody", 1.0, 2.0, 1.0, 0)], "sid string, intercept double, age double, sex double, block int")
    got = glm.parcel_design_test(stack, table if blocked else table.drop("block"), COLUMNS, contrast, 15, ("f",), flip, two_tailed).collect()
    want = brute(rows, design, contrast, 15, blocked, flip, two_tailed)
    assert {(r["f"], r["p"]) for r in got} == set(want)
    for r in got:
        t, p = want[r["f"], r["p"]]
        assert (r["t"], r["p_fwe"]) == ((None, None) if t is None else (pytest.approx(t), pytest.approx(p)))


def test_without_families_and_joined(spark, monkeypatch):
    rows, design = fixture()
    rows = [r for r in rows if r[0] == 1]
    table = spark.createDataFrame([(s, *x) for s, x in design.items()], "sid string, intercept double, age double, sex double, block int")
    stack = spark.createDataFrame([r[1:] for r in rows], "sid string, p string, value double")
    one = sorted(map(tuple, glm.parcel_design_test(stack, table, COLUMNS, (0, 0, 1), 7).collect()))
    monkeypatch.setattr(glm, "BROADCAST_ROWS", 0)
    two = sorted(map(tuple, glm.parcel_design_test(stack, table, COLUMNS, (0, 0, 1), 7).collect()))
    want = brute(rows, design, (0, 0, 1), 7, True, False, True)
    for a, b in zip(one, two):
        assert a == pytest.approx(b) and a[1:] == pytest.approx(want[1, a[0]])


def test_awkward_designs(spark):
    rows, design = fixture()
    stack = spark.createDataFrame(rows, "f int, sid string, p string, value double")
    table = spark.createDataFrame([(s, 1.0, 2.0, x[2]) for s, x in design.items()], "sid string, intercept double, age double, sex double")
    same = glm.parcel_design_test(stack, table, COLUMNS, (0, 1, 0), 3, ("f",)).collect()  # age is a multiple of the intercept
    assert all(r["t"] is None and r["p_fwe"] is None for r in same) and len(same) == 8
    assert glm.parcel_design_test(stack.limit(0), table, COLUMNS, (0, 0, 1), 3, ("f",)).count() == 0
    alone = glm.parcel_design_test(stack, table, ["sex"], [1], 3, ("f",)).collect()  # nothing beside the tested column
    assert len(alone) == 8
    with pytest.raises(ValueError, match="contrast"):
        glm.parcel_design_test(stack, table, COLUMNS, (0, 0, 0), 3)
