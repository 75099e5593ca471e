"""Statistics against direct computation."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.operators import design, posterior, statistics
from tests import nested


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.20, None])], "i int, p double")
    q = {r["i"]: r["q_bh"] for r in statistics.benjamini_hochberg(df, "p", ["i"]).collect()}
    assert [q[i] for i in range(4)] == pytest.approx([0.04, 0.053333, 0.053333, 0.20], abs=1e-6)
    assert q[4] is None


def test_state_effect_equals_nested_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = [(i, s, float(rng.normal() + s)) for i in range(12) for s in range(4)]
    got = statistics.rm_state_f(spark.createDataFrame(rows, "sid int, s int, y double"), [], 4).first()
    sid, s, y = (np.array(c) for c in zip(*rows))
    none = np.array(["F"] * len(y))
    full = nested.design_columns(sid, s, 4, np.zeros(len(y)), none, none, {"Subject", "State"})
    less = nested.design_columns(sid, s, 4, np.zeros(len(y)), none, none, {"Subject"})
    f, _, den, eta = nested.nested_f(y, less, full)
    assert got["partial_eta2"] == pytest.approx(eta)
    assert got["df_den"] == den - 1  # the nuisance constant within a sid counts as a column
    assert got["f_obs"] == pytest.approx(f * got["df_den"] / den)


def test_interaction_equals_nested_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(i, s, float(rng.normal() + s * (i % 3)), "abc"[i % 3]) for i in range(14) for s in range(4)]
    got = statistics.rm_interaction_f(spark.createDataFrame(rows, "sid int, s int, y double, grp string"), [], 4).first()
    sid, s, y, age = (np.array(c) for c in zip(*rows))
    fd, sex, main = rng.normal(size=14)[sid], np.array(["F"] * len(y)), {"Subject", "State", "FD", "AgeGroup"}
    full = nested.design_columns(sid, s, 4, fd, sex, age, main | {"AgeGroup:State"})
    f, num, den, eta = nested.nested_f(y, nested.design_columns(sid, s, 4, fd, sex, age, main), full)
    assert (got["df_num"], got["df_den"]) == (num, den)
    assert (got["f_obs"], got["partial_eta2"]) == pytest.approx((f, eta))


def test_collinear_terms_have_no_f():
    sid, s = np.repeat(np.arange(6), 3), np.tile(np.arange(3), 6)
    sex = np.where(sid % 2 == 0, "M", "F")
    full = nested.design_columns(sid, s, 3, np.zeros(18), sex, sex, {"Subject", "State", "Sex"})
    less = nested.design_columns(sid, s, 3, np.zeros(18), sex, sex, {"Subject", "State"})
    assert np.isnan(nested.nested_f(np.random.default_rng(0).normal(size=18), less, full)[0])


def test_permutations_keep_the_labels(spark):
    df = spark.createDataFrame([(i, float(i), "M" if i % 3 else "F") for i in range(20)], "sid int, r double, grp string")
    got = statistics.permuted(df, 5).groupBy("perm", "grp").count().collect()
    assert {(r["perm"], r["grp"]): r["count"] for r in got} == {(p, g): n for p in range(6) for g, n in (("M", 13), ("F", 7))}


def test_soft_metrics(spark):
    rows = [("a", t, [p, 1 - p]) for t, p in enumerate([0.9, 0.6, 0.2, 0.5])]
    gamma = spark.createDataFrame(rows, "sid string, t int, g array<double>")
    got = {r["s"]: r for r in posterior.soft_metrics(gamma, 2).collect()}
    assert [got[s]["fo"] for s in (0, 1)] == pytest.approx([0.55, 0.45])
    assert [got[s]["dt_mean"] for s in (0, 1)] == pytest.approx([1.808511, 2.407407], abs=1e-6)
    assert [got[s]["n_visits"] for s in (0, 1)] == pytest.approx([1.44, 1.04])
    c = posterior.asymmetry(gamma, 2).first()
    assert (c["asym_raw"], c["asym_norm"]) == pytest.approx((0.137557, 0.142056), abs=1e-5)
    assert posterior.soft_switch(gamma).first()["switch_rate_soft"] == pytest.approx(0.493333, abs=1e-6)


def test_contrast():
    names = ["intercept", "age_1", "sex", "fd", "state_1", "state_2"]
    assert design.contrast(names) == [0, 0, 0, 0, 0, 1]
    assert design.contrast(names[:4]) == [0, 0, 1, 0]
    assert design.contrast(names, "fd") == [0, 0, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        design.contrast(names, "nothing")


def test_covariates(spark):
    raw = spark.createDataFrame([("a_1", "m", "1", "x"), ("b_1", " Female ", "2", "0.5"), ("c", "", None, None), ("d", None, "1", "1")], "sid string, sex string, age_group string, fd string")
    got = {r["sid"]: r for r in design.normalized_covariates(raw).collect()}
    assert [got[s]["sex"] for s in ("a_1", "b_1", "c", "d")] == ["M", "F", "", None]
    assert got["a_1"]["fd"] is None and got["b_1"]["uid"] == "b"
    files = spark.createDataFrame([("a_task.x",), ("a_REST1.x",), ("a_abc.x",), ("b_z.x",), ("b_c.x",)], "name string")
    assert {r["sid"]: r["name"] for r in design.preferred_files(files).collect()} == {"a": "a_REST1.x", "b": "b_c.x"}


def test_omnibus_of_incomplete_blocks(spark):
    """Each term against nested least squares with the sids' columns written out; sids lack states, one has a single one."""
    rng = np.random.default_rng(8)
    k, rows = 4, []
    for i in range(18):
        states = [s for s in range(k) if rng.random() < 0.7] or [1]
        states = [2] if i == 5 else states
        rows += [("m", i, s, float(rng.normal() + s * (i % 3)), "MF"[i % 2], "abc"[i % 3]) for s in states]
    got = {r["term"]: r for r in statistics.rm_omnibus(spark.createDataFrame(rows, "metric string, sid int, s int, y double, sex string, age string").repartition(4), k, 9).collect()}
    _, sid, s, y, sex, age = (np.array(c) for c in zip(*rows))
    fd = rng.normal(size=18)[sid]
    base = {"Subject", "FD"}
    for term, less, more in (("State", base, {"State"}), ("AgeGroup:State", base | {"State", "AgeGroup"}, {"AgeGroup:State"}), ("Sex:State", base | {"State", "Sex"}, {"Sex:State"})):
        full, small = (nested.design_columns(sid, s, k, fd, sex, age, t) for t in (less | more, less))
        f, num, den, eta = nested.nested_f(y, small, full)
        assert (got[term]["df_num"], got[term]["df_den"]) == (num, den)
        assert (got[term]["f_obs"], got[term]["partial_eta2"]) == pytest.approx((f, eta)), term
        assert 0.1 <= got[term]["p_perm"] <= 1
    for term, factor in (("AgeGroup", {"AgeGroup"}), ("Sex", {"Sex"})):
        full, small = (nested.design_columns(sid, s, k, fd, sex, age, base | {"State"} | t) for t in (factor, set()))
        assert (got[term]["df_num"], got[term]["df_den"], got[term]["f_obs"]) == (full.shape[1] - small.shape[1], len(y) - full.shape[1], None)


def test_states_are_dealt_where_they_are(spark):
    """Neither a function over arrays nor an exchange by sid and permutation: one of sids, one of sums by permutation."""
    rows = [(i, s, float((i * 7 + s * s) % 11)) for i in range(30) for s in range(3)]
    df = spark.createDataFrame(rows, "sid int, s int, y double")
    ranked = statistics.ranked_within(df.groupBy("sid").agg(F.sort_array(F.collect_list("s")).alias("own")), [F.lit(True)] * 3, [F.get("own", F.lit(i)) for i in range(3)], 4, "42")
    found = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in found
    for r in ranked.collect():
        order = sorted(range(3), key=lambda s: hashlib.md5(f"42:{r['perm']}:{r['sid']}:{s}".encode()).hexdigest()) if r["perm"] else [0, 1, 2]
        assert [r[f"_h{s}"] for s in range(3)] == [order.index(s) for s in range(3)]
    got = statistics.rm_state_test(df, 3, 20).first()
    assert got["stat"] == pytest.approx(statistics.rm_state_f(df, [], 3).first()["f_obs"]) and got["n_perm"] == 20
