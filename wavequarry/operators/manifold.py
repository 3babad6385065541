"""Means, distances, tangent vectors and running means of covariance matrices.

Matrices travel as arrays of 16 doubles. A geometric mean is found by passes
over the data: a pass maps each matrix to the tangent space of its group's
current mean and sums; the driver holds one matrix per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions import linalg as L
from ..sources.tables import CHANNELS, EPOCH_SAMPLES
from .ordered import ordered_fold

N = CHANNELS


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).reshape(-1, N, N) if len(column) else np.zeros((0, N, N))


def epoch_covariance(x: Column | str) -> Column:
    """Sample covariance, 1e-6 on the diagonal, of epoch arrays."""

    @F.pandas_udf("array<double>")
    def covariance(x: pd.Series) -> pd.Series:
        return pd.Series(list(L.covariances(np.stack(x.to_numpy()).reshape(-1, EPOCH_SAMPLES, N)).reshape(-1, N * N)))

    return covariance(x)


def arithmetic_means(df: DataFrame, key: str, cov: str) -> dict:
    """Key -> mean matrix; one row per key comes to the driver."""
    sums = df.groupBy(key).agg(*[F.avg(F.get(cov, F.lit(k))).alias(f"c{k}") for k in range(N * N)]).collect()
    return {r[key]: np.array([r[f"c{k}"] for k in range(N * N)]).reshape(N, N) for r in sums}


def references_without(df: DataFrame, key: str, cov: str) -> dict:
    """Key -> mean matrix of all other keys' rows; one row per key comes to the driver."""
    sums = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get(cov, F.lit(k))).alias(f"c{k}") for k in range(N * N)]).collect()
    parts = {r[key]: (r["n"], np.array([r[f"c{k}"] for k in range(N * N)]).reshape(N, N)) for r in sums}
    n, whole = sum(p[0] for p in parts.values()), sum((p[1] for p in parts.values()), np.zeros((N, N)))
    return {k: (whole - own) / (n - m) for k, (m, own) in parts.items() if n > m}


def tangents(values: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Tangent vectors at the reference of matrices given as rows of 16."""
    return L.tangent(values.reshape(-1, N, N), reference)


SIDES = ([0, 2], [1, 3])


def fused_tangents(values: np.ndarray, reference: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Tangent vectors of the whole matrices and of the left and the right block, each times its weight: 10 + 3 + 3 numbers."""
    m = values.reshape(-1, N, N)
    parts = [L.tangent(m, reference)] + [L.tangent(m[:, s][:, :, s], reference[np.ix_(s, s)]) for s in SIDES]
    return np.hstack([w * p for w, p in zip(weights, parts)])


def scale_distances(values: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distances to the reference of the whole matrices and of their left and right blocks."""
    m = values.reshape(-1, N, N)
    return np.column_stack([L.distance(reference, m)] + [L.distance(reference[np.ix_(s, s)], m[:, s][:, :, s]) for s in SIDES])


def by_key(f: Callable, cov: Column, key: Column, given: dict, kind: str = "array<double>") -> Column:
    """``f(matrices as rows, given[key])`` of each row, null for keys that ``given`` does not have."""

    @F.pandas_udf(kind)
    def run(c: pd.Series, k: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(c), index=c.index, dtype=object)
        for name in k.unique():
            if name in given:
                own = np.flatnonzero(k == name)
                for at, v in zip(own, f(np.stack(c.iloc[own].to_numpy()), given[name])):
                    out.iat[at] = v
        return out

    return run(cov, key)


def whitening(vectors: DataFrame, key: str, v: str, size: int, ridge: float = 1e-4) -> dict:
    """Key -> inverse root of the sample covariance of its vectors plus ``ridge``; the identity for keys with one row."""
    found = {}
    kind, n = dict(vectors.dtypes)[key], size + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, rows in batch.groupby(key):
                x = np.column_stack([np.ones(len(rows)), np.stack(rows[v].to_numpy())])
                yield pd.DataFrame({key: [k], "s": [(x.T @ x).ravel().tolist()]})

    parts = vectors.select(key, v).mapInPandas(sums, f"{key} {kind}, s array<double>")
    for r in parts.groupBy(key).agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(n * n)]).alias("s")).collect():
        g = np.array(r["s"]).reshape(n, n)
        count, mean = g[0, 0], g[0, 1:] / g[0, 0]
        found[r[key]] = np.eye(size) if count < 2 else L.inverse_root((g[1:, 1:] - count * np.outer(mean, mean)) / (count - 1) + ridge * np.eye(size))
    return found


def geometric_means(df: DataFrame, key: str, cov: str, most_rounds: int = 50, tolerance: float = 1e-8) -> dict:
    """Key -> (geometric mean, rounds, converged).

    A round moves each mean along the mean tangent vector, until that is
    shorter than ``tolerance`` for every key.
    """
    means = arithmetic_means(df, key, cov)
    rounds = {k: 0 for k in means}
    size = N * (N + 1) // 2
    done: set = set()
    for _ in range(most_rounds):
        now = {k: m for k, m in means.items() if k not in done}
        if not now:
            break

        def tangents(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k, rows in batch.groupby(key):
                    if k in now:
                        v = L.tangent(_stack(rows[cov]), now[k])
                        yield pd.DataFrame({key: [k], "n": [len(v)], "v": [v.sum(0).tolist()]})

        kind = dict(df.dtypes)[key]
        sums = df.select(key, cov).mapInPandas(tangents, f"{key} {kind}, n long, v array<double>")
        for r in sums.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(size)]).collect():
            k = r[key]
            step = L.from_upper(np.array([r[f"v{i}"] for i in range(size)]) / r["n"])
            base = L.root(means[k])
            means[k] = base @ L.exp(step) @ base
            rounds[k] += 1
            if np.linalg.norm(step) < tolerance:
                done.add(k)
    return {k: (m, rounds[k], k in done) for k, m in means.items()}


def settled_means(df: DataFrame, key: str, cov: str, most_rounds: int = 500) -> dict:
    """Key -> geometric mean; an error if one has not converged, so that none is used which is not there yet."""
    found = geometric_means(df, key, cov, most_rounds)
    if still := [k for k, (_, _, done) in found.items() if not done]:
        raise RuntimeError(f"{len(still)} means have not converged in {most_rounds} rounds, the first of key {still[0]!r}")
    return {k: m for k, (m, _, _) in found.items()}


def distance_to(cov: Column, reference: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def distance(c: pd.Series) -> pd.Series:
        return pd.Series(L.distance(reference, _stack(c)))

    return distance(cov)


def tangent_at(cov: Column, reference: np.ndarray) -> Column:
    @F.pandas_udf("array<double>")
    def tangent(c: pd.Series) -> pd.Series:
        return pd.Series(list(L.tangent(_stack(c), reference)))

    return tangent(cov)


def divergence_to(cov: Column, reference: np.ndarray) -> Column:
    """Log-det divergence from the reference, at least 0."""

    @F.pandas_udf("double")
    def divergence(c: pd.Series) -> pd.Series:
        values = np.maximum(np.linalg.eigvalsh(L.whiten(_stack(c), reference)), L.CLIP)
        return pd.Series(np.maximum((values - np.log(values) - 1).sum(-1), 0.0))

    return divergence(cov)


def resampled_powers(x: Column, samples: int) -> Column:
    """Mean squares of the channels before, then after, resampling to ``samples``."""

    @F.pandas_udf("array<double>")
    def powers(x: pd.Series) -> pd.Series:
        epochs = np.stack(x.to_numpy()).reshape(-1, EPOCH_SAMPLES, N)
        after = dsp.resample(np.moveaxis(epochs, 1, 0), samples)
        return pd.Series(list(np.hstack([(epochs**2).mean(1), (after**2).mean(0)])))

    return powers(x)


def swelling(arithmetic: np.ndarray, geometric: np.ndarray) -> tuple[float, float, float]:
    """Ratios of the determinants and of the largest eigenvalues, and the distance, of two means."""
    ratio = np.exp(np.linalg.slogdet(arithmetic)[1] - np.linalg.slogdet(geometric)[1])
    return float(ratio), float(np.linalg.eigvalsh(arithmetic)[-1] / np.linalg.eigvalsh(geometric)[-1]), float(L.distance(arithmetic, geometric))


def running_mean(df: DataFrame, keys: list[str], order: list[str], cov: str, rate: float = 0.01, adaptive: float | None = None) -> DataFrame:
    """keys, order, distance, logdet: distance of each matrix to the running mean before it, and the mean's log determinant after.

    The mean starts at the first matrix and moves along the geodesic by
    ``rate``; with ``adaptive`` by rate (1 + 5 d / adaptive), 0.15 at most.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, *order)) + ", distance double, logdet double"

    def step(mean, rows: pd.DataFrame):
        found = []
        for c in _stack(rows[cov]):
            mean = c if mean is None else mean
            d = float(L.distance(mean, c))
            mean = L.along(mean, c, rate if adaptive is None else min(0.15, max(rate, rate * (1 + 5 * d / adaptive))))
            found.append((d, float(np.linalg.slogdet(mean)[1])))
        return mean, pd.concat([rows[[*keys, *order]].reset_index(drop=True), pd.DataFrame(found, columns=["distance", "logdet"])], axis=1)

    return ordered_fold(df, keys, order, lambda: None, step, schema)


def transport(df: DataFrame, key: str, cov: str, means: dict, target: np.ndarray) -> DataFrame:
    """Each matrix carried so that its group's mean comes to lie at ``target``; ``means`` has one matrix per key."""
    root = L.root(target)
    carry = {k: root @ L.inverse_root(m) for k, m in means.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                e = np.stack([carry[k] for k in batch[key]])
                batch[cov] = list((e @ _stack(batch[cov]) @ np.swapaxes(e, 1, 2)).reshape(-1, N * N))
                yield batch

    return df.mapInPandas(run, df.schema)
