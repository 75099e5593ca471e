"""Golden vectors and edge cases of the hard-sequence metrics."""

from __future__ import annotations

import math

import pytest

from statewalk.operators import chain, sequences

HARD = [0, 0, 1, 1, 1, 0, 2, 2, 0, 0]


@pytest.fixture(scope="module")
def seq(spark):
    rows = [("a", t, s) for t, s in enumerate(HARD)] + [("one", 0, 1)]
    return spark.createDataFrame(rows, "sid string, t int, s int").cache()


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_dwell_and_visits(seq):
    got = rows(sequences.dwell(seq, 3), "sid", "s")
    a = got["a", 0]
    assert (a["dt_mean"], a["dt_median"], a["dt_var"]) == pytest.approx((5 / 3, 2, 1 / 3))
    assert (a["n_visits"], a["iv_mean"]) == (3, 4)
    assert tuple(got["a", 1])[2:] == (3.0, 3.0, 0.0, 1, 0.0)
    assert tuple(got["one", 0])[2:] == (0.0, 0.0, 0.0, 0, 0.0)  # never visited


def test_occupancy_sums_to_one(seq):
    got = rows(sequences.occupancy(seq, 3), "sid", "s")
    assert [got["a", s]["fo"] for s in range(3)] == pytest.approx([0.5, 0.3, 0.2])
    assert sum(got["one", s]["fo"] for s in range(3)) == 1


def test_transitions_and_entropy(seq):
    got = rows(sequences.transition_probs(seq, 3), "sid", "from_s", "to_s")
    assert [got["a", 0, j]["p"] for j in range(3)] == pytest.approx([3 / 7, 2 / 7, 2 / 7])
    assert [got["one", 1, j]["p"] for j in range(3)] == pytest.approx([1 / 3] * 3)
    h = rows(sequences.row_entropy(sequences.transition_probs(seq, 3)), "sid", "s")
    assert [h["a", s]["row_entropy_bits"] for s in range(3)] == pytest.approx([1.556657, 1.459148, 1.521928], abs=1e-6)


def test_switching(seq):
    got = rows(sequences.switch_global(seq), "sid")
    assert got["a",]["sr_global"] == pytest.approx(4 / 9) and got["one",]["sr_global"] == 0
    by = rows(sequences.switch_state(seq, 3), "sid", "s")
    assert [by["a", s]["sr_state"] for s in range(3)] == pytest.approx([4 / 9, 2 / 9, 2 / 9])
    assert sum(by["a", s]["sr_state"] for s in range(3)) == pytest.approx(2 * got["a",]["sr_global"])


def test_global_metrics(seq):
    got = rows(chain.global_metrics(seq, 3), "sid")["a",]
    assert got["occ_entropy_bits"] == pytest.approx(1.4854752972273344, abs=1e-9)
    assert got["entropy_rate_bits"] == pytest.approx(1.514507, abs=1e-5)
    assert got["mean_self_transition"] == pytest.approx(0.442857, abs=1e-6)
    assert got["spectral_gap"] == pytest.approx(0.723002, abs=1e-5)
    assert got["lzc_switches"] == pytest.approx(6 / (9 / math.log2(9)))


def test_closed_forms_agree_with_the_general_solution(seq):
    probs = sequences.transition_probs(seq, 3)
    pi = {(r["sid"], r["s"]): r["pi"] for r in chain.stationary_k3(probs).collect()}
    gap = {r["sid"]: r["spectral_gap"] for r in chain.gap_k3(probs).collect()}
    for r in chain.chain_general(probs, 3).collect():
        assert [pi[r["sid"], s] for s in range(3)] == pytest.approx(r["pi"])
        assert gap[r["sid"]] == pytest.approx(r["spectral_gap"])


@pytest.mark.parametrize("signal, value", [("1", 2.0), ("01", 1.5), ("00", 1.5), ("0000", 2.0), ("0110100110", 1.993157)])
def test_complexity(signal, value):
    assert sequences.lz_complexity(signal) == pytest.approx(value, abs=1e-6)


def test_run_lengths_cover_the_sequence(seq):
    total = {r["sid"]: r["n"] for r in sequences.runs(seq).groupBy("sid").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert total == {"a": 10, "one": 1}
