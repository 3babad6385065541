"""Ridge classifiers on features of degree two, the penalty by generalised cross-validation.

All that a fold asks for are sums: the moments of its features, then the Gram
matrix of their products. One eigen-decomposition of that gives the error and
the trace of the hat matrix for every penalty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import _added

ALPHAS = np.logspace(-3, 5, 30)


def squares(z: np.ndarray) -> np.ndarray:
    """Features and all their products by twos."""
    i, j = np.triu_indices(z.shape[1])
    return np.column_stack([z, z[:, i] * z[:, j]])


def validated(gram: np.ndarray, alphas: np.ndarray = ALPHAS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(errors, coefficients by penalty, mean, scale, intercept) from the sums of products of (1, features, target).

    The error of a penalty is the mean squared residual over the squared share
    of the rows that the fit leaves free: 1 - trace of the hat matrix / rows.
    """
    n, k = gram[0, 0], len(gram) - 2
    mean, mean_y = gram[0, 1:-1] / n, gram[0, -1] / n
    covariance = gram[1:-1, 1:-1] - n * np.outer(mean, mean)
    scale = np.sqrt(np.diag(covariance) / n)
    scale = np.where(scale > 1e-9 * (1 + np.abs(mean)), scale, np.inf)  # what does not vary has no say
    products = covariance / np.outer(scale, scale)
    to_y = (gram[1:-1, -1] - n * mean * mean_y) / scale
    values, vectors = np.linalg.eigh(products)
    values, along = np.maximum(values, 0), vectors.T @ to_y
    left = gram[-1, -1] - n * mean_y**2
    shrunk = 1 / (values[None] + alphas[:, None])
    residual = left - 2 * (along**2 * shrunk).sum(1) + (values * (along * shrunk) ** 2).sum(1)
    free = 1 - (1 + (values * shrunk).sum(1)) / n
    errors = np.where(free > 0, residual / n / np.where(free > 0, free, 1) ** 2, np.inf)
    return errors, (along * shrunk) @ vectors.T, mean, scale, mean_y if k else 0.0


def left_out_polynomial(df: DataFrame, raw: str, target: str, group: str, at: Callable, references: dict, alphas: np.ndarray = ALPHAS) -> tuple[DataFrame, DataFrame]:
    """(fold, alpha, gcv for every fold and penalty; ``df`` with alpha and decision of the fit without the row's group).

    ``target`` is 0 or 1 and taken as -1 and 1; the decision is positive for 1.
    Features are ``at(raw, reference)`` of the fold, standardised, with their
    products, standardised again, all by sums over the other groups' rows.
    """
    kind = dict(df.dtypes)[group]

    def sums(make: Callable) -> dict:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for batch in batches:
                if not len(batch):
                    continue
                x, y, g = np.stack(batch[raw].to_numpy()), np.where(batch[target].to_numpy(float) > 0.5, 1.0, -1.0), batch[group].to_numpy()
                for fold, reference in references.items():
                    own = g != fold
                    if own.any():
                        total[fold] = total.get(fold, 0) + make(fold, at(x[own], reference), y[own])
            if total:
                yield pd.DataFrame([(k, np.ascontiguousarray(s).tobytes()) for k, s in total.items()], columns=["fold", "s"])

        rows = df.select(raw, target, group).mapInPandas(each, f"fold {kind}, s binary")
        return {r["fold"]: np.frombuffer(r["s"]) for r in _added(rows, ["fold"]).collect()}

    moments = {}
    for fold, s in sums(lambda _, v, y: np.concatenate([[len(v)], v.sum(0), (v**2).sum(0)])).items():
        size = (len(s) - 1) // 2
        mean = s[1 : size + 1] / s[0]
        moments[fold] = mean, np.sqrt(np.maximum(s[size + 1 :] / s[0] - mean**2, 1e-12))

    def products(fold, v, y) -> np.ndarray:
        mean, scale = moments[fold]
        full = np.column_stack([np.ones(len(v)), squares((v - mean) / scale), y])
        return (full.T @ full).ravel()

    scores, fits = [], {}
    for fold, s in sums(products).items():
        size = int(round(len(s) ** 0.5))
        errors, coefficients, mean, scale, base = validated(s.reshape(size, size), alphas)
        best = int(np.argmin(errors))
        scores += [(int(fold), float(a), float(e)) for a, e in zip(alphas, errors)]
        fits[fold] = float(alphas[best]), coefficients[best] / scale, mean, base

    @F.pandas_udf("alpha double, decision double")
    def decided(x: pd.Series, g: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"alpha": np.nan, "decision": np.nan}, index=x.index)
        for fold in g.unique():
            if fold in fits:
                own = (g == fold).to_numpy()
                alpha, w, mean, base = fits[fold]
                centre, scale = moments[fold]
                z = squares((at(np.stack(x[own].to_numpy()), references[fold]) - centre) / scale)
                out.loc[own, "alpha"], out.loc[own, "decision"] = alpha, (z - mean) @ w + base
        return out

    table = df.sparkSession.createDataFrame(scores, "fold long, alpha double, gcv double")
    return table, df.withColumn("_d", decided(F.col(raw), F.col(group))).select(*df.columns, "_d.*")
