"""Model selection: fits over numbers of states and seeds, detectors on each fit, and summaries by number of states."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.operators import arhmm, matrices, posterior
from statewalk.plans.config import Evaluation

#: Fits of a sweep that run at the same time.
FITS_AT_ONCE = 4


@dataclass
class Found:
    """What a detector returns: figures for the scorecard, and the tables behind them."""

    name: str
    figures: dict[str, float | None]
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Fit:
    k: int
    seed: int
    model: arhmm.Parameters
    gamma: DataFrame


def _first(df: DataFrame) -> dict[str, float | None]:
    row = df.first().asDict()
    return {c: None if v is None else float(v) for c, v in row.items()}


def junk(fit: Fit, e: Evaluation) -> Found:
    table = posterior.junk_states(posterior.soft_metrics(fit.gamma, fit.k), e.low_fo, e.short_dt, e.low_presence)
    return Found("junk", _first(table.agg(F.sum(F.col("junk_state").cast("double")).alias("n_junk"), F.min("fo_median").alias("min_fo"))), {"states": table})


def randomness(fit: Fit, _e: Evaluation) -> Found:
    table = posterior.soft_randomness(fit.gamma, fit.k).join(posterior.soft_switch(fit.gamma, fit.k), "sid")
    figures = [F.avg(c).alias(f"{c}_mean") for c in table.columns[1:]] + [F.stddev_samp(c).alias(f"{c}_std") for c in table.columns[1:]]
    norm = F.avg(F.col("entropy_rate_bits") / float(np.log2(max(fit.k, 2)))).alias("entropy_rate_norm")
    return Found("randomness", _first(table.agg(*figures, norm)), {"subjects": table})


def indecision(fit: Fit, e: Evaluation) -> Found:
    table = posterior.indecision(fit.gamma, fit.k, e.dominant, e.ambiguous)
    return Found("indecision", _first(table.agg(F.avg("entropy_mean").alias("entropy"), F.avg("frac_dominant").alias("dominant"), F.avg("frac_ambiguous").alias("ambiguous"))), {"subjects": table})


def clones(fit: Fit, e: Evaluation) -> Found:
    spark = fit.gamma.sparkSession
    means = [(s, p, float(v)) for s, row in enumerate(fit.model.means) for p, v in enumerate(row)]
    table = matrices.pattern_correlations(spark.createDataFrame(means, "s int, p int, mean double"))
    return Found("clone", _first(table.agg(F.max("corr").alias("max_corr"), F.sum((F.col("corr") >= e.clone_corr).cast("double")).alias("n_pairs"))), {"pairs": table})


def reliability(fit: Fit, e: Evaluation) -> Found:
    """Of sequences of exactly n_runs runs of run_len steps, or with a run_len of 0 of all, cut into n_runs parts."""
    table = posterior.reliability(fit.gamma, fit.k, e.n_runs, e.run_len or None)
    return Found("reliability", _first(table.agg(F.avg("fo_gamma_r").alias("r_mean"), F.stddev_samp("fo_gamma_r").alias("r_std"))), {"subjects": table})


Detector = Callable[[Fit, Evaluation], Found]
DETECTORS: tuple[Detector, ...] = (junk, randomness, indecision, clones, reliability)


def fit_one(seqs: DataFrame, k: int, seed: int, **how) -> Fit:
    model = arhmm.fit(seqs, k, seed=seed, **how)
    return Fit(k, seed, model, arhmm.decode(seqs, model).select("sid", "t", F.transform("g", lambda x: F.round(x, 6)).alias("g")).persist())


def evaluate(fit: Fit, detectors: Iterable[Detector] = DETECTORS, settings: Evaluation | None = None, keep: Callable[[str, DataFrame], object] | None = None) -> dict[str, float | None]:
    """One row of the scorecard: k, seed, loglik and each detector's figures as detector__figure.

    keep gets the table behind each figure under the name detector_table.
    """
    out: dict[str, float | None] = {"k": float(fit.k), "seed": float(fit.seed), "loglik": fit.model.loglik}
    for detector in detectors:
        found = detector(fit, settings or Evaluation(run_len=0))
        out |= {f"{found.name}__{c}": v for c, v in found.figures.items()}
        if keep is not None:
            for name, table in found.tables.items():
                keep(f"{found.name}_{name}", table)
    return out


def scored(seqs: DataFrame, k: int, seed: int, detectors: Iterable[Detector] = DETECTORS, settings: Evaluation | None = None, keep: Callable[[str, DataFrame], object] | None = None, **how) -> dict:
    """`evaluate` of one fit; a fit that fails gives its error and no figures."""
    fit = None
    try:
        fit = fit_one(seqs, k, seed, **how)
        return evaluate(fit, detectors, settings, keep)
    except (np.linalg.LinAlgError, FloatingPointError, ValueError) as e:
        return {"k": float(k), "seed": float(seed), "error": str(e)}
    finally:
        if fit is not None:
            fit.gamma.unpersist()


def scorecard(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of figures as a table; what a row lacks, or is not a number, is null."""
    names = list(dict.fromkeys(c for r in rows for c in r))
    schema = ", ".join(f"`{c}` {'string' if c == 'error' else 'double'}" for c in names)
    return spark.createDataFrame([tuple(None if isinstance(v := r.get(c), float) and np.isnan(v) else v for c in names) for r in rows], schema)


def sweep(seqs: DataFrame, ks: Iterable[int], seeds: Iterable[int], detectors: Iterable[Detector] = DETECTORS, **how) -> DataFrame:
    """The scorecard of all fits, one row for each k and seed.

    Fits don't depend on each other, and the jobs of one leave most cores idle, so FITS_AT_ONCE of them run beside one another.
    """
    seqs = seqs.persist()
    try:
        with ThreadPool(FITS_AT_ONCE) as pool:
            rows = pool.starmap(lambda k, seed: scored(seqs, k, seed, detectors, **how), itertools.product(sorted(set(ks)), sorted(set(seeds))), 1)
    finally:
        seqs.unpersist()
    return scorecard(seqs.sparkSession, rows)


def summary_by_k(scorecard: DataFrame) -> DataFrame:
    """k and, for each figure, its mean and deviation over seeds as figure__mean and figure__std."""
    figures = [c for c, kind in scorecard.dtypes if kind == "double" and c not in ("k", "seed")]
    aggregates = [f(c).alias(f"{c}__{name}") for c in figures for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return scorecard.groupBy(F.col("k").cast("int").alias("k")).agg(F.count("*").alias("runs"), *aggregates)
