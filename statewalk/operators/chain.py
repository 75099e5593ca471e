"""Markov-chain summaries of transition probabilities: stationary distribution, spectral gap, entropy rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.functions.expressions import entropy_bits
from statewalk.operators.sequences import lzc, occupancy, row_entropy, self_transition, switch_global, transition_probs


def matrix_rows(probs: DataFrame, k: int) -> DataFrame:
    """sid and columns p00, p01, ... of the transition matrix, by one aggregation."""
    cells = [F.max(F.when((F.col("from_s") == i) & (F.col("to_s") == j), F.col("p"))).alias(f"p{i}{j}" if k <= 10 else f"p{i}_{j}") for i in range(k) for j in range(k)]
    return probs.groupBy("sid").agg(*cells)


def stationary_k3(probs: DataFrame) -> DataFrame:
    """sid, s, pi for three states, from the cofactors of I - P: all in column expressions."""
    m = matrix_rows(probs, 3)
    c = {(i, j): F.col(f"p{i}{j}") for i in range(3) for j in range(3)}
    weight = [(1 - c[b, b]) * (1 - c[d, d]) - c[b, d] * c[d, b] for b, d in ((1, 2), (0, 2), (0, 1))]
    w = m.select("sid", *[x.alias(f"w{i}") for i, x in enumerate(weight)])
    total = F.col("w0") + F.col("w1") + F.col("w2")
    return w.select("sid", F.posexplode(F.array(*[F.col(f"w{i}") / total for i in range(3)])).alias("s", "pi"))


def gap_k3(probs: DataFrame) -> DataFrame:
    """sid, spectral_gap for three states: 1 less the second greatest |real part| of the eigenvalues 1, x, y.

    x and y are the roots of z**2 - (trace - 1) z + det; a complex pair has the real part (trace - 1) / 2.
    """
    m = matrix_rows(probs, 3)
    p = [[F.col(f"p{i}{j}") for j in range(3)] for i in range(3)]
    det = p[0][0] * (p[1][1] * p[2][2] - p[1][2] * p[2][1]) - p[0][1] * (p[1][0] * p[2][2] - p[1][2] * p[2][0]) + p[0][2] * (p[1][0] * p[2][1] - p[1][1] * p[2][0])
    out = m.select("sid", (p[0][0] + p[1][1] + p[2][2] - 1).alias("b"), det.alias("det"))
    disc = F.col("b") * F.col("b") - 4 * F.col("det")
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    second = F.greatest(F.abs((F.col("b") + root) / 2), F.abs((F.col("b") - root) / 2))
    return out.select("sid", (1 - second).alias("spectral_gap"))


def stationary(p: np.ndarray) -> np.ndarray:
    """Stationary distributions of a stack of matrices (n, k, k), by reduction of states: the last state's flow is handed to the
    others, one state after the other, which takes no subtraction and so loses no digits. Uniform where a state that is handed
    on leads to no other."""
    a = np.array(p, np.float64)
    n, k, _ = a.shape
    for last in range(k - 1, 0, -1):
        out = a[:, last, :last].sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            a[:, :last, last] /= out[:, None]
        a[:, :last, :last] += a[:, :last, last, None] * a[:, last, None, :last]
    pi = np.ones((n, k))
    for at in range(1, k):
        pi[:, at] = (pi[:, :at] * a[:, :at, at]).sum(1)
    pi /= pi.sum(1, keepdims=True)
    return np.where(np.isfinite(pi).all(1, keepdims=True), pi, 1 / k)


def spectral_gap(p: np.ndarray) -> np.ndarray:
    """1 less the second greatest |real part| of the eigenvalues, of a stack of matrices (n, k, k); 1 for one state."""
    if p.shape[1] < 2:
        return np.ones(len(p))
    return 1.0 - np.sort(np.abs(np.real(np.linalg.eigvals(p))), axis=1)[:, -2]


def chain_general(probs: DataFrame, k: int) -> DataFrame:
    """sid, pi (array), spectral_gap for any k: matrices as arrays, a batch of them solved at once."""
    cells = matrix_rows(probs, k)
    flat = F.array(*[f"p{i}{j}" if k <= 10 else f"p{i}_{j}" for i in range(k) for j in range(k)])

    @F.pandas_udf("struct<pi: array<double>, spectral_gap: double>")
    def solve(x: pd.Series) -> pd.DataFrame:
        found = np.stack([np.asarray(v, np.float64) for v in x]).reshape(-1, k, k) if len(x) else np.zeros((0, k, k))
        return pd.DataFrame({"pi": stationary(found).tolist(), "spectral_gap": spectral_gap(found)})

    return cells.select("sid", solve(flat).alias("x")).select("sid", "x.pi", "x.spectral_gap")


def entropy_rate(probs: DataFrame, pi: DataFrame) -> DataFrame:
    """sid, entropy_rate_bits: row entropies weighted by pi(sid, s, pi)."""
    return row_entropy(probs).join(pi, ["sid", "s"]).groupBy("sid").agg(F.sum(F.col("pi") * F.col("row_entropy_bits")).alias("entropy_rate_bits"))


def global_metrics(seq: DataFrame, k: int) -> DataFrame:
    """One row for each sequence: switch rate, occupancy entropy, entropy rate, mean self transition, gap, complexity."""
    probs = transition_probs(seq, k)
    shares = [F.sum(F.when(F.col("s") == i, F.col("fo"))) for i in range(k)]
    occ = occupancy(seq, k).groupBy("sid").agg(*[x.alias(f"f{i}") for i, x in enumerate(shares)]).select("sid", entropy_bits([F.col(f"f{i}") for i in range(k)]).alias("occ_entropy_bits"))
    solved = chain_general(probs, k)
    pi = solved.select("sid", F.posexplode("pi").alias("s", "pi"))
    stay = self_transition(probs).groupBy("sid").agg(F.avg("self_transition").alias("mean_self_transition"))
    out = switch_global(seq).select("sid", "sr_global")
    for part in (occ, entropy_rate(probs, pi), stay, solved.select("sid", "spectral_gap"), lzc(seq)):
        out = out.join(part, "sid")
    return out
