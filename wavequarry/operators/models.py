"""Models and their evaluation by leaving groups out.

Ridge models need sums of products only, so a leave-one-group-out run is one
pass: each fold's sums are all sums less the group's. Scores come back as a
column, so no fold is a loop over data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_by_group(df: DataFrame, features: str, target: str, group: str, size: int) -> dict:
    """Group -> sums of outer products of (1, features, target): one matrix of size + 2 per group."""
    kind = dict(df.dtypes)[group]
    n = size + 2

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, rows in batch.groupby(group):
                x = np.column_stack([np.ones(len(rows)), np.stack(rows[features].to_numpy()), rows[target].to_numpy(float)])
                yield pd.DataFrame({group: [g], "s": [(x.T @ x).ravel().tolist()]})

    parts = df.select(group, features, target).mapInPandas(sums, f"{group} {kind}, s array<double>")
    rows = parts.groupBy(group).agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(n * n)]).alias("s")).collect()
    return {r[group]: np.array(r["s"]).reshape(n, n) for r in rows}


def solve_ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Weights (intercept first, not held down) of features standardised by the sums themselves."""
    n, k = gram[0, 0], len(gram) - 2
    mean, mean_y = gram[0, 1:-1] / n, gram[0, -1] / n
    cov = gram[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    to_y = (gram[1:-1, -1] / n - mean * mean_y) / sd
    w = np.linalg.solve(cov / np.outer(sd, sd) + alpha / n * np.eye(k), to_y) / sd
    return np.concatenate([[mean_y - mean @ w], w])


def leave_out_ridge(df: DataFrame, features: str, target: str, group: str, size: int, alpha: float = 1.0) -> DataFrame:
    """Add ``predicted``: the ridge model fitted without the row's own group; null if there is no other group."""
    grams = gram_by_group(df, features, target, group, size)
    whole = sum(grams.values(), np.zeros((size + 2, size + 2)))
    models = {g: solve_ridge(whole - own, alpha) for g, own in grams.items() if whole[0, 0] > own[0, 0]}

    @F.pandas_udf("double")
    def predicted(x: pd.Series, g: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        for k in g.unique():
            if k in models:
                own = g == k
                out[own] = models[k][0] + np.stack(x[own].to_numpy()) @ models[k][1:]
        return out

    return df.withColumn("predicted", predicted(F.col(features), F.col(group)))


def leave_out_ridge_at(df: DataFrame, raw: str, at: Callable, references: dict, target: str, group: str, size: int, alpha: float = 1.0) -> DataFrame:
    """Add ``predicted`` of the ridge model fitted without the row's own group, on features ``at(raw values, references[group])``.

    The reference of a fold comes from the other groups, so nothing of the
    held-out one enters its model. A pass makes the sums of all folds.
    """
    grams = {g: parts[0] for g, parts in fold_grams(df.withColumn("_part", F.lit(0)), raw, at, references, target, group, size).items() if 0 in parts}
    fitted = {g: solve_ridge(gram, alpha) for g, gram in grams.items()}

    @F.pandas_udf("double")
    def predicted(x: pd.Series, g: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        for k in g.unique():
            if k in fitted:
                own = g == k
                out[own] = fitted[k][0] + at(np.stack(x[own].to_numpy()), references[k]) @ fitted[k][1:]
        return out

    return df.withColumn("predicted", predicted(F.col(raw), F.col(group)))


def fold_grams(df: DataFrame, raw: str, at: Callable, references: dict, target: str, group: str, size: int) -> dict:
    """Fold -> part -> sums of outer products of (1, features, target), the features at the fold's reference.

    A row's part is its column ``_part``, and -1 where its own group is the fold.
    """
    kind, n = dict(df.dtypes)[group], size + 2

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            values, y, g = np.stack(batch[raw].to_numpy()), batch[target].to_numpy(float), batch[group].to_numpy()
            for fold, reference in references.items():
                x = np.column_stack([np.ones(len(batch)), at(values, reference), y])
                part = np.where(g == fold, -1, batch["_part"].to_numpy())
                for k in np.unique(part):
                    own = x[part == k]
                    yield pd.DataFrame({"fold": [fold], "part": [int(k)], "s": [(own.T @ own).ravel().tolist()]})

    parts = df.select(raw, target, group, "_part").mapInPandas(sums, f"fold {kind}, part int, s array<double>")
    found: dict = {}
    for r in parts.groupBy("fold", "part").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(n * n)]).alias("s")).collect():
        found.setdefault(r["fold"], {})[r["part"]] = np.array(r["s"]).reshape(n, n)
    return found


def squared_error(gram: np.ndarray, weights: np.ndarray) -> float:
    """Sum of squared errors of a model on the rows of ``gram``, from the sums alone."""
    w = np.append(weights, -1.0)
    return float(w @ gram @ w)


def nested_search(grams: dict, alphas: list[float]) -> list[tuple]:
    """(fold, best alpha, its mean squared error over the inner parts, that of the refitted model on the fold) from ``fold_grams``."""
    found = []
    for fold, parts in sorted(grams.items()):
        inner = {k: g for k, g in parts.items() if k >= 0}
        whole = sum(inner.values())
        if len(inner) < 2 or -1 not in parts:
            continue
        errors = [sum(squared_error(g, solve_ridge(whole - g, alpha)) for g in inner.values()) / whole[0, 0] for alpha in alphas]
        best = int(np.argmin(errors))
        outer = squared_error(parts[-1], solve_ridge(whole, alphas[best])) / parts[-1][0, 0]
        found.append((fold, float(alphas[best]), errors[best], outer))
    return found


def left_out_errors(grams: dict, alphas: list[float]) -> list[tuple[float, float]]:
    """(alpha, mean squared error on the left-out groups), from the groups' sums alone."""
    whole, found = sum(grams.values()), []
    for alpha in alphas:
        error = sum(squared_error(own, solve_ridge(whole - own, alpha)) for own in grams.values())
        found.append((alpha, error / whole[0, 0]))
    return found


def fit_platt(df: DataFrame, score: str, target: str, rounds: int = 20) -> tuple[float, float]:
    """(slope, bias) of the logistic curve of a 0/1 target over a score, by Newton steps on sums; targets are drawn in from 0 and 1."""
    s, y = F.col(score), F.col(target)
    df = df.where(s.isNotNull() & y.isNotNull())
    up, down = df.agg(F.count_if(y > 0.5), F.count_if(y <= 0.5)).first()
    if not up or not down:
        return 0.0, float(np.log((up + 1) / (down + 1)))
    goal = F.when(y > 0.5, (up + 1) / (up + 2)).otherwise(1 / (down + 2))
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(float(w[0]) * s + float(w[1]))))
        e, h = goal - p, p * (1 - p)
        r = df.agg(F.sum(e * s), F.sum(e), F.sum(h * s * s), F.sum(h * s), F.sum(h)).first()
        change = np.linalg.solve(np.array([[r[2], r[3]], [r[3], r[4]]]) + 1e-9 * np.eye(2), np.array(r[:2]))
        w += np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fourier_features(features: Column, size: int, n: int = 64, gamma: float = 0.1, seed: int = 3) -> Column:
    """Random Fourier features whose products approach the kernel exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(size, n)), rng.uniform(0, 2 * np.pi, n)

    @F.pandas_udf("array<double>")
    def waves(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / n) * np.cos(np.stack(x.to_numpy()) @ w + b)))

    return waves(features)


def leave_out_classifier(df: DataFrame, features: Callable[[object], Column], target: str, group: str, model) -> DataFrame:
    """``df`` with ``predicted`` of a pyspark.ml model fitted without the row's group, one fit per group, on ``features(group)`` of each row."""
    rows = df.withColumn("_y", F.col(target).cast("double"))
    done = []
    for g in sorted(r[group] for r in rows.select(group).distinct().collect()):
        at = rows.withColumn("_x", array_to_vector(features(g)))
        fitted = model.fit(at.where(F.col(group) != g))
        done.append(fitted.transform(at.where(F.col(group) == g)).select(*df.columns, F.col("prediction").alias("predicted")))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def random_forest(trees: int = 20, depth: int = 5, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)


def forest_regressor(trees: int = 20, depth: int = 5, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)


def linear_svc(rounds: int = 20, regularisation: float = 0.01) -> LinearSVC:
    return LinearSVC(featuresCol="_x", labelCol="_y", maxIter=rounds, regParam=regularisation)


class WaveNet:
    """One temporal convolution, rectifier, mean over time, linear output; loss is the mean squared error.

    Gradients are sums over epochs, so a training step is one pass of sums.
    """

    def __init__(self, channels: int = 4, filters: int = 8, width: int = 5, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.parameters = {"kernel": rng.normal(scale=0.3, size=(filters, width, channels)), "bias": np.zeros(filters), "out": rng.normal(scale=0.3, size=filters), "base": np.zeros(1)}

    def _forward(self, x: np.ndarray):
        p = self.parameters
        windows = np.lib.stride_tricks.sliding_window_view(x, p["kernel"].shape[1], axis=1)  # (k, t, channels, width)
        z = np.einsum("ktcw,fwc->ktf", windows, p["kernel"]) + p["bias"]
        active = np.maximum(z, 0)
        pooled = active.mean(1)
        return windows, z, pooled, pooled @ p["out"] + p["base"][0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[-1]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Sums over the epochs of half the squared error and of its gradient."""
        windows, z, pooled, out = self._forward(x)
        e = out - y
        back = (e[:, None] * self.parameters["out"])[:, None, :] * (z > 0) / z.shape[1]
        found = {"kernel": np.einsum("ktf,ktcw->fwc", back, windows), "bias": back.sum((0, 1)), "out": pooled.T @ e, "base": np.array([e.sum()])}
        return float((e**2).sum() / 2), found

    def fit(self, df: DataFrame, x: str, y: str, samples: int, channels: int, steps: int = 20, rate: float = 0.1) -> list[float]:
        """Gradient steps over the whole table; returns the mean loss before each."""
        losses = []
        sizes = {k: v.shape for k, v in self.parameters.items()}
        total = 1 + 1 + sum(v.size for v in self.parameters.values())
        for _ in range(steps):

            def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    if len(batch):
                        loss, g = self.gradient(np.stack(batch[x].to_numpy()).reshape(-1, samples, channels), batch[y].to_numpy(float))
                        yield pd.DataFrame({"s": [np.concatenate([[len(batch), loss], *[g[k].ravel() for k in sizes]]).tolist()]})

            r = np.array(df.select(x, y).mapInPandas(sums, "s array<double>").agg(*[F.sum(F.get("s", F.lit(i))) for i in range(total)]).first())
            at = 2
            for k, shape in sizes.items():
                n = int(np.prod(shape))
                self.parameters[k] = self.parameters[k] - rate * r[at : at + n].reshape(shape) / r[0]
                at += n
            losses.append(float(r[1] / r[0]))
        return losses
