"""Likelihood fits: the data are reduced to cells in Spark, the small cell table is fitted on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tessera.functions.special import normal_sf, t_sf

CELLS = 100_000  # most cells a fit takes to the driver


@dataclass
class Fit:
    """Coefficients with their covariance, log likelihood (up to constants) and dispersion."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    dispersion: float
    df: int

    def table(self, spark, student: bool = False) -> DataFrame:
        """(term, estimate, se, ratio, lo, hi, p) of each coefficient."""
        se = np.sqrt(np.maximum(np.diag(self.cov), 0))
        rows = []
        for n, b, s in zip(self.names, self.beta, se):
            z = abs(b / s) if s > 0 else float("nan")
            p = (2 * t_sf(z, self.df) if student and self.df > 0 else 2 * normal_sf(z)) if s > 0 else None
            ratio = [float(np.exp(np.clip(v, -700, 700))) for v in (b, b - 1.96 * s, b + 1.96 * s)]
            rows.append((n, float(b), float(s), *ratio, None if p is None else float(p)))
        return spark.createDataFrame(rows, "term string, estimate double, se double, ratio double, lo double, hi double, p double")


def cells(df: DataFrame) -> list:
    """The rows of an aggregated table, whose number is checked."""
    rows = df.take(CELLS + 1)
    if len(rows) > CELLS:
        raise ValueError(f"a fit takes {CELLS} cells at most; aggregate further")
    return rows


def design(rows: Sequence, factors: Sequence[str], numeric: Sequence[str] = ()) -> tuple[np.ndarray, list[str]]:
    """Intercept, numeric columns and reference-coded factors; the reference is the first level in order."""
    cols, names = [np.ones(len(rows))], ["(intercept)"]
    for c in numeric:
        cols.append(np.array([float(r[c]) for r in rows]))
        names.append(c)
    for f in factors:
        for level in sorted({r[f] for r in rows})[1:]:
            cols.append(np.array([float(r[f] == level) for r in rows]))
            names.append(f"{f}={level}")
    return np.column_stack(cols), names


def poisson(x: np.ndarray, y: np.ndarray, offset: np.ndarray | float = 0.0, names: list[str] | None = None, quasi: bool = False) -> Fit:
    """Poisson regression with log link by iteratively reweighted least squares; quasi scales the covariance."""
    eta = np.log(np.maximum(y, 0.5)) if np.isscalar(offset) else np.log((y.sum() + 0.5) / np.exp(offset).sum()) + offset
    beta = np.zeros(x.shape[1])
    for _ in range(200):
        mu = np.exp(np.clip(eta, -30, 30))
        z = eta - offset + (y - mu) / mu
        new = np.linalg.pinv(x.T @ (mu[:, None] * x)) @ (x.T @ (mu * z))
        moved, beta = np.abs(new - beta).max(), new
        eta = x @ beta + offset
        if moved < 1e-10:
            break
    mu = np.exp(np.clip(eta, -30, 30))
    df = len(y) - np.linalg.matrix_rank(x)
    disp = float(((y - mu) ** 2 / mu).sum() / df) if df > 0 else 1.0
    cov = np.linalg.pinv(x.T @ (mu[:, None] * x)) * (max(disp, 1.0) if quasi else 1.0)
    return Fit(names or [f"x{i}" for i in range(x.shape[1])], beta, cov, float((y * np.log(mu) - mu).sum()), disp, int(df))


def logistic(x: np.ndarray, k: np.ndarray, n: np.ndarray, names: list[str] | None = None, ridge: float = 0.0) -> Fit:
    """Logistic regression of k out of n per cell by Newton steps with halving; a ridge keeps separated data finite."""
    beta = np.zeros(x.shape[1])

    def value(b: np.ndarray) -> float:
        eta = np.clip(x @ b, -30, 30)
        return float((k * eta - n * np.log1p(np.exp(eta))).sum() - ridge * (b @ b) / 2)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ ((n * p * (1 - p))[:, None] * x) + ridge * np.eye(len(beta))
        step = np.linalg.pinv(h) @ (x.T @ (k - n * p) - ridge * beta)
        scale = 1.0
        while value(beta + scale * step) < value(beta) - 1e-12 and scale > 1e-8:
            scale /= 2
        beta = beta + scale * step
        if np.abs(scale * step).max() < 1e-10:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    h = x.T @ ((n * p * (1 - p))[:, None] * x) + ridge * np.eye(len(beta))
    return Fit(names or [f"x{i}" for i in range(x.shape[1])], beta, np.linalg.pinv(h), value(beta), 1.0, int(len(n) - x.shape[1]))


def multinomial_shares(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Shares of the levels, the first being the reference, under a multinomial logit."""
    eta = np.column_stack([np.zeros(len(x)), x @ beta.reshape(-1, x.shape[1]).T])
    e = np.exp(eta - eta.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def multinomial(x: np.ndarray, counts: np.ndarray, names: list[str], levels: list[str], ridge: float = 1e-3, intercept_ridge: float | None = None) -> Fit:
    """Multinomial logit against the first level with a ridge prior, by Newton steps with halving; the log likelihood is
    without the prior."""
    d, m = x.shape[1], counts.shape[1] - 1
    n = counts.sum(1)
    prior = np.tile(np.r_[ridge if intercept_ridge is None else intercept_ridge, np.full(d - 1, ridge)], m)

    def probs(b: np.ndarray) -> np.ndarray:
        return multinomial_shares(x, b)

    def loglik(b: np.ndarray) -> float:
        return float((counts * np.log(np.maximum(probs(b), 1e-300))).sum())

    def value(b: np.ndarray) -> float:
        return loglik(b) - float(prior @ (b * b)) / 2

    beta = np.zeros(m * d)
    for _ in range(100):
        p = probs(beta)
        grad = np.concatenate([x.T @ (counts[:, j + 1] - n * p[:, j + 1]) for j in range(m)]) - prior * beta
        h = np.diag(prior)
        for i in range(m):
            for j in range(m):
                w = n * p[:, i + 1] * ((i == j) - p[:, j + 1])
                h[i * d : (i + 1) * d, j * d : (j + 1) * d] += x.T @ (w[:, None] * x)
        step, scale = np.linalg.solve(h, grad), 1.0
        while value(beta + scale * step) < value(beta) - 1e-12 and scale > 1e-8:
            scale /= 2
        beta = beta + scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return Fit([f"{lv}:{c}" for lv in levels[1:] for c in names], beta, np.linalg.inv(h), loglik(beta), 1.0, int(n.sum()) - m * d)
