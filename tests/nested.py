"""Nested least squares with every column written out, for the tests."""

from __future__ import annotations

import numpy as np


def design_columns(sid: np.ndarray, s: np.ndarray, k: int, fd: np.ndarray, sex: np.ndarray, age: np.ndarray, terms: set[str]) -> np.ndarray:
    """Design matrix of the terms Subject, State, FD, Sex, AgeGroup, Sex:State, AgeGroup:State, after the intercept.

    Factors drop their first level in sorted order; the columns' order is that of the list.
    """
    def dummies(values: np.ndarray) -> list[np.ndarray]:
        return [(values == v).astype(float) for v in sorted(set(values.tolist()))[1:]]

    states = [(s == i).astype(float) for i in range(1, k)]
    known = fd[~np.isnan(fd)]
    full = np.where(np.isnan(fd), known.mean() if len(known) else 0.0, fd)
    male = (sex == "M").astype(float)
    ages = dummies(age)
    columns = [np.ones(len(s))]
    for term, some in (("Subject", dummies(sid)), ("State", states), ("FD", [full]), ("Sex", [male]), ("AgeGroup", ages), ("Sex:State", [male * x for x in states]), ("AgeGroup:State", [a * x for a in ages for x in states])):
        if term in terms:
            columns += some
    return np.column_stack(columns)


def nested_f(y: np.ndarray, reduced: np.ndarray, full: np.ndarray) -> tuple[float, int, int, float]:
    """F, degrees of freedom by columns, and partial eta squared of the columns that full has and reduced doesn't.

    NaN where the model leaves no freedom, or where the added columns explain nothing that rounding doesn't.
    """
    def rss(x: np.ndarray) -> float:
        try:
            beta, *_ = np.linalg.lstsq(x, y, rcond=1e-6)
        except np.linalg.LinAlgError:
            beta = np.linalg.pinv(x, rcond=1e-6) @ y
        return float(((y - x @ beta) ** 2).sum())

    r, f = rss(reduced), rss(full)
    num, den = full.shape[1] - reduced.shape[1], len(y) - full.shape[1]
    if num <= 0 or den <= 0 or f <= 0:
        return float("nan"), num, den, float("nan")
    gain = max(r - f, 0.0)
    same = np.linalg.matrix_rank(full, tol=1e-8) == np.linalg.matrix_rank(reduced, tol=1e-8)
    return float("nan") if same else (gain / num) / (f / den), num, den, gain / (gain + f)
