"""Kernel classifiers over a grid of settings, nested in folds of whole groups.

A kernel is approached by landmarks: features are the kernel to a bounded number
of training rows, whitened by that among them. A classifier has the squared
hinge as its loss, so a Newton step needs sums over rows only, and one pass
makes those of all settings, inner parts and folds at once. The driver holds
the weights: settings times parts times folds, none of which grow with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CS = (0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0)
GAMMAS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0)
WEIGHTS = ("none", "balanced")
LANDMARKS = 24
SCORES = "fold long, c double, gamma double, class_weight string, inner double, outer double, n_inner long, n_outer long"


@dataclass
class Fold:
    """What a fold's features need, none of it from the group that is left out."""

    reference: object
    mean: np.ndarray
    scale: np.ndarray
    landmarks: np.ndarray
    whitening: dict[float, np.ndarray]
    #: Rows of each class (0, 1) by inner part.
    classes: np.ndarray

    def features(self, x: np.ndarray, gamma: float) -> np.ndarray:
        """Landmark features of rows of view values, and a one."""
        z = (x - self.mean) / self.scale
        far = ((z[:, None, :] - self.landmarks[None]) ** 2).sum(-1)
        return np.column_stack([np.exp(-gamma * far) @ self.whitening[gamma], np.ones(len(z))])


def kernel_fold(values: np.ndarray, reference: object, mean: np.ndarray, scale: np.ndarray, classes: np.ndarray, gammas: tuple[float, ...] = GAMMAS) -> Fold:
    """A fold from its landmarks' view values."""
    z = (values - mean) / scale
    far = ((z[:, None, :] - z[None]) ** 2).sum(-1)
    whitening = {}
    for gamma in gammas:
        v, w = np.linalg.eigh(np.exp(-gamma * far))
        whitening[gamma] = (w / np.sqrt(np.maximum(v, 1e-10))) @ w.T
    return Fold(reference, mean, scale, z, whitening, classes)


def class_weights(classes: np.ndarray, parts: int) -> np.ndarray:
    """(kind of weight, fit, class): fits are those without each inner part and that of all parts."""
    found = np.ones((len(WEIGHTS), parts + 1, 2))
    for p in range(parts + 1):
        n = classes.sum(0) - (classes[p] if p < parts else 0)
        found[1, p] = n.sum() / (2 * np.maximum(n, 1))
    return found


def newton_sums(phi: np.ndarray, y: np.ndarray, part: np.ndarray, w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, its descent and its curvature for weights w (kind, C, fit, features) over rows of a fold that are not left out."""
    kinds, cs, fits, m = w.shape
    sign, cls = np.where(y > 0.5, 1.0, -1.0), (y > 0.5).astype(int)
    found = np.zeros((kinds, cs, fits, 1 + m + m * m))
    for f in range(fits):
        own = part != f
        p, s, c = phi[own], sign[own], cls[own]
        for k in range(kinds):
            given = weights[k, f][c]
            for j in range(cs):
                short = np.maximum(1 - s * (p @ w[k, j, f]), 0)
                active = p[short > 0]
                found[k, j, f] = np.concatenate([[(given * short**2).sum()], p.T @ (given * s * short), (active.T @ (active * given[short > 0][:, None])).ravel()])
    return found


def newton_step(sums: np.ndarray, w: np.ndarray, cs: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(objective at w, the full step from w) of |w|^2 / 2 + C sum of weighted squared hinges; the last feature is not held down."""
    m = w.shape[-1]
    held = np.append(np.ones(m - 1), 1e-6)
    objective, step = np.zeros(w.shape[:-1]), np.zeros(w.shape)
    for at in np.ndindex(*w.shape[:-1]):
        c, s = cs[at[1]], sums[at]
        objective[at] = 0.5 * (held * w[at] ** 2).sum() + c * s[0]
        step[at] = np.linalg.solve(np.diag(held) + 2 * c * s[1 + m :].reshape(m, m), 2 * c * s[1 : m + 1] - held * w[at])
    return objective, step


def _folds(df: DataFrame, raw: str, target: str, group: str, part: str, at: Callable, references: dict, standard: bool, parts: int, landmarks: int) -> dict:
    """Fold -> what its features need: landmarks by the smallest hashes, moments and classes by a pass of sums."""
    kind = dict(df.dtypes)[group]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, y, g, p = np.stack(batch[raw].to_numpy()), batch[target].to_numpy(float), batch[group].to_numpy(), batch[part].to_numpy()
            for fold, reference in references.items():
                own = g != fold
                v = at(x[own], reference)
                counts = np.zeros((parts, 2))
                np.add.at(counts, (p[own], (y[own] > 0.5).astype(int)), 1)
                yield pd.DataFrame({"fold": [fold], "s": [np.concatenate([[own.sum()], v.sum(0), (v**2).sum(0), counts.ravel()]).tolist()]})

    sums = df.mapInPandas(moments, f"fold {kind}, s array<double>").select("fold", F.posexplode("s").alias("place", "v")).groupBy("fold", "place").agg(F.sum("v").alias("v"))
    told: dict = {}
    for r in sums.collect():  # a few numbers a fold
        told.setdefault(r["fold"], {})[r["place"]] = r["v"]
    found = {}
    for fold, reference in references.items():
        rows = df.where(F.col(group) != F.lit(fold)).orderBy(F.xxhash64(F.col(raw).cast("string")), F.col(raw).cast("string")).limit(landmarks).select(raw).collect()
        s = np.array([told[fold][k] for k in sorted(told[fold])])
        size = (len(s) - 1 - 2 * parts) // 2
        mean = s[1 : size + 1] / s[0]
        scale = np.sqrt(np.maximum(s[size + 1 : 2 * size + 1] / s[0] - mean**2, 1e-12))
        if not standard:
            mean, scale = np.zeros(size), np.ones(size)
        found[fold] = kernel_fold(at(np.array([r[raw] for r in rows]), reference), reference, mean, scale, s[2 * size + 1 :].reshape(parts, 2))
    return found


def _added(df: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """keys, s: sums of arrays given as bytes of doubles, in two steps."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s) for s in rows["s"])
        return rows.iloc[:1].assign(s=[total.tobytes()])

    salted = df.withColumn("salt", (F.spark_partition_id() % salts).cast("int"))
    parts = salted.groupBy(*keys, "salt").applyInPandas(lambda rows: add(rows)[[*keys, "salt", "s"]], f"{schema}, salt int, s binary")
    return parts.groupBy(*keys).applyInPandas(lambda rows: add(rows)[[*keys, "s"]], f"{schema}, s binary")


def kernel_grid(df: DataFrame, raw: str, target: str, group: str, part: str, parts: int, at: Callable, references: dict, standard: bool, landmarks: int | None = None, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """fold, c, gamma, class_weight, inner, outer, n_inner, n_outer: all settings for each fold.

    A fold leaves a group out; ``references`` has for each what ``at(raw,
    reference)`` makes the view with, from the other groups. ``part`` (0 to
    ``parts`` - 1) must be the same for all rows of a group. inner is the
    accuracy over the parts, each predicted without it; outer that over the
    group left out, by a fit to all parts. A round is a pass for all settings;
    a fit whose objective rose goes half the way. A fold has LANDMARKS
    ``landmarks`` unless told otherwise.
    """
    df = df.select(raw, target, group, part)
    folds = _folds(df, raw, target, group, part, at, references, standard, parts, landmarks or LANDMARKS)
    kind = dict(df.dtypes)[group]
    sizes = {k: len(f.landmarks) + 1 for k, f in folds.items()}
    keys = [(k, g) for k in folds for g in GAMMAS]
    shape = {k: (len(WEIGHTS), len(CS), parts + 1, sizes[k]) for k in folds}
    w = {(k, g): np.zeros(shape[k]) for k, g in keys}
    balance = {k: class_weights(f.classes, parts) for k, f in folds.items()}

    def each(batches: Iterator[pd.DataFrame], w: dict, make: Callable) -> Iterator[pd.DataFrame]:
        """The sum of ``make`` over a task's rows for each fold and gamma."""
        total: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            x, y, g, p = np.stack(batch[raw].to_numpy()), batch[target].to_numpy(float), batch[group].to_numpy(), batch[part].to_numpy()
            for fold, f in folds.items():
                v, out = at(x, f.reference), g == fold
                for gamma in GAMMAS:
                    s = make(f.features(v, gamma), y, p, out, w[fold, gamma], balance[fold])
                    total[fold, gamma] = total.get((fold, gamma), 0) + s
        if total:
            yield pd.DataFrame([(k, g, np.ascontiguousarray(s).tobytes()) for (k, g), s in total.items()], columns=["fold", "gamma", "s"])

    def passed(w: dict, make: Callable) -> dict:
        rows = df.mapInPandas(lambda batches: each(batches, w, make), f"fold {kind}, gamma double, s binary")
        return {(r["fold"], r["gamma"]): np.frombuffer(r["s"]) for r in _added(rows, ["fold", "gamma"]).collect()}

    before, step, size_of = {k: np.full(shape[k[0]][:-1], np.inf) for k in keys}, {k: np.zeros(shape[k[0]]) for k in keys}, {k: np.ones(shape[k[0]][:-1]) for k in keys}
    for _ in range(rounds):
        sums, worst = passed(w, lambda phi, y, p, out, w, b: newton_sums(phi[~out], y[~out], p[~out], w, b)), 0.0
        for k in keys:
            m = sizes[k[0]]
            objective, full = newton_step(sums[k].reshape(*shape[k[0]][:-1], 1 + m + m * m), w[k], CS)
            rose = objective > before[k] * (1 + 1e-12) + 1e-12
            size_of[k] = np.where(rose, size_of[k] / 2, 1.0)
            back = w[k] - step[k] * np.where(rose, size_of[k], 0.0)[..., None]  # half of the last step is taken back
            before[k] = np.where(rose, before[k], objective)
            step[k] = np.where(rose[..., None], step[k], full)
            new = np.where(rose[..., None], back, w[k] + full)
            worst = max(worst, float(np.abs(new - w[k]).max() / (1 + np.abs(new).max())))
            w[k] = new
        if worst < tolerance:
            break

    def right(phi, y, p, out, w, _):
        """Right predictions over the inner parts and over the group left out, and the numbers of rows."""
        yes = (np.einsum("nm,kcfm->nkcf", phi, w) > 0) == (y > 0.5)[:, None, None, None]
        inner = sum((yes[(p == f) & ~out][:, :, :, f].sum(0) for f in range(parts)), np.zeros(w.shape[:2]))
        outer = yes[out][:, :, :, parts].sum(0)
        return np.stack([inner, outer, np.full(inner.shape, (~out).sum()), np.full(inner.shape, out.sum())]).astype(float)

    found = []
    for (fold, gamma), s in passed(w, right).items():
        s = s.reshape(4, len(WEIGHTS), len(CS))
        for k, name in enumerate(WEIGHTS):
            for j, c in enumerate(CS):
                inner, outer, n, out = s[:, k, j]
                found.append((int(fold), c, float(gamma), name, float(inner / n), float(outer / out), int(n), int(out)))
    return df.sparkSession.createDataFrame(found, SCORES)


def best_of(scores: DataFrame) -> DataFrame:
    """The setting of each fold with the highest inner accuracy; of several that of the smallest C, then gamma, then without weights."""
    order = F.struct(-F.col("inner"), "c", "gamma", (F.col("class_weight") != "none"))
    return scores.groupBy("fold").agg(F.min_by(F.struct("c", "gamma", "class_weight", "inner", "outer", "n_inner", "n_outer"), order).alias("best")).select("fold", "best.*")
