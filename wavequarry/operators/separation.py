"""Blind source separation from sums over samples.

Lagged covariances and the moments that FastICA asks for are sums over rows, so
they are made by distributed aggregation; the driver holds matrices of channels
by channels only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, channels: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, population covariance, number of rows."""
    n = len(channels)
    r = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in channels], *[F.covar_pop(a, b) for a in channels for b in channels]).first()
    return np.array(r[1 : n + 1]), np.array(r[n + 1 :]).reshape(n, n), r[0]


def lagged_covariances(df: DataFrame, keys: list[str], order: list[str], channels: list[str], lags: int) -> list[np.ndarray]:
    """Symmetrised covariances at lags 1..lags within keys, about the overall mean."""
    mean, _, _ = moments(df, channels)
    w = Window.partitionBy(*keys).orderBy(*order)
    centred = df.select(*keys, *order, *[(F.col(c) - float(m)).alias(c) for c, m in zip(channels, mean)])
    wide = centred.select(*channels, *[F.lag(c, k).over(w).alias(f"{c}_{k}") for k in range(1, lags + 1) for c in channels])
    sums = wide.agg(*[F.avg(F.col(a) * F.col(f"{b}_{k}")) for k in range(1, lags + 1) for a in channels for b in channels]).first()
    n = len(channels)
    found = np.array([x or 0.0 for x in sums]).reshape(lags, n, n)
    return [(m + m.T) / 2 for m in found]


def joint_diagonalizer(matrices: list[np.ndarray], sweeps: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """Orthogonal V for which all V^T M V are as diagonal as can be, by plane rotations.

    For a plane, the best angle comes from the eigenvector of the 2x2 sums of
    the differences of the diagonal and of twice the off-diagonal.
    """
    ms = np.array(matrices)
    n = ms.shape[1]
    v = np.eye(n)
    for _ in range(sweeps):
        largest = 0.0
        for p in range(n - 1):
            for q in range(p + 1, n):
                h = np.stack([ms[:, p, p] - ms[:, q, q], 2 * ms[:, p, q]])
                g = h @ h.T
                angle = 0.25 * np.arctan2(2 * g[0, 1], g[0, 0] - g[1, 1])
                c, s = np.cos(angle), np.sin(angle)
                if abs(s) > tolerance:
                    largest = max(largest, abs(s))
                    turn = np.eye(n)
                    turn[[p, p, q, q], [p, q, p, q]] = c, -s, s, c
                    ms = turn.T @ ms @ turn
                    v = v @ turn
        if largest <= tolerance:
            break
    return v


def _whitener(covariance: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(covariance)
    return (vectors / np.sqrt(np.maximum(values, 1e-12))).T


def sobi(df: DataFrame, keys: list[str], order: list[str], channels: list[str], lags: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(mean, unmixing matrix) by second-order blind identification."""
    mean, covariance, _ = moments(df, channels)
    white = _whitener(covariance)
    turned = [white @ m @ white.T for m in lagged_covariances(df, keys, order, channels, lags)]
    return mean, joint_diagonalizer(turned).T @ white


def fast_ica(df: DataFrame, channels: list[str], rounds: int = 50, tolerance: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(mean, unmixing matrix) by symmetric FastICA with the log-cosh contrast; a round is one pass of sums."""
    mean, covariance, n = moments(df, channels)
    white, k = _whitener(covariance), len(channels)

    def orthogonal(m: np.ndarray) -> np.ndarray:
        u, _, vt = np.linalg.svd(m)
        return u @ vt

    w = orthogonal(np.random.default_rng(seed).normal(size=(k, k)))
    rows = df.select(*channels)
    for _ in range(rounds):

        def sums(batches: Iterator[pd.DataFrame], w=w) -> Iterator[pd.DataFrame]:
            for batch in batches:
                z = (batch.to_numpy(float) - mean) @ white.T
                g = np.tanh(z @ w.T)
                yield pd.DataFrame({"s": [np.concatenate([(g.T @ z).ravel(), (1 - g**2).sum(0)]).tolist()]})

        r = rows.mapInPandas(sums, "s array<double>").agg(*[F.sum(F.get("s", F.lit(i))) for i in range(k * k + k)]).first()
        r = np.array(r) / n
        new = orthogonal(r[: k * k].reshape(k, k) - r[k * k :, None] * w)
        change = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if change < tolerance:
            break
    return mean, w @ white


def suppress(df: DataFrame, channels: list[str], mean: np.ndarray, unmixing: np.ndarray, factors: np.ndarray) -> DataFrame:
    """``df`` with channels rebuilt from components times ``factors`` (0 removes one); plain column arithmetic."""
    whole = np.linalg.inv(unmixing) @ np.diag(factors) @ unmixing
    centred = [F.col(c) - float(m) for c, m in zip(channels, mean)]
    rebuilt = {c: sum((float(whole[i, j]) * x for j, x in enumerate(centred)), F.lit(float(mean[i]))) for i, c in enumerate(channels)}
    return df.withColumns(rebuilt)


def artifact_factors(df: DataFrame, channels: list[str], mean: np.ndarray, unmixing: np.ndarray, kurtosis: float = 5.0, soft: float = 0.0) -> np.ndarray:
    """``soft`` for components whose absolute excess kurtosis is above the bound, 1 for the others."""
    centred = [F.col(c) - float(m) for c, m in zip(channels, mean)]
    parts = [sum((float(u) * x for u, x in zip(row, centred)), F.lit(0.0)) for row in unmixing]
    k = df.agg(*[F.kurtosis(p) for p in parts]).first()
    return np.array([soft if v is not None and abs(v) > kurtosis else 1.0 for v in k])
