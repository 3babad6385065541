"""A small convolutional network trained out of fold by local steps, and what it looks at.

In an epoch every task takes steps over its own rows from the same parameters,
for all folds at once; the parameters it ends with are averaged by rows. So an
epoch is one job, and what comes to the driver is a parameter vector per fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import _added
from .models import WaveNet

NAMES = ("kernel", "bias", "out", "base")


def flat(net: WaveNet) -> np.ndarray:
    return np.concatenate([net.parameters[k].ravel() for k in NAMES])


def shaped(net: WaveNet, values: np.ndarray) -> WaveNet:
    """``net`` with its parameters from one vector."""
    at = 0
    for k in NAMES:
        n = net.parameters[k].size
        net.parameters[k] = values[at : at + n].reshape(net.parameters[k].shape)
        at += n
    return net


def input_gradient(net: WaveNet, x: np.ndarray) -> np.ndarray:
    """How the output changes with each input value, for epochs (k, samples, channels)."""
    p = net.parameters
    z = net._forward(x)[1]
    back = (z > 0) * p["out"] / z.shape[1]
    found = np.zeros(x.shape)
    for w in range(p["kernel"].shape[1]):
        found[:, w : w + z.shape[1]] += back @ p["kernel"][:, w]
    return found


def local_steps(net: WaveNet, x: np.ndarray, y: np.ndarray, rate: float, batch: int) -> tuple[WaveNet, float]:
    """A step per ``batch`` rows; also the sum of squared errors met on the way."""
    loss = 0.0
    for at in range(0, len(x), batch):
        part, g = net.gradient(x[at : at + batch], y[at : at + batch])
        loss += 2 * part
        net.parameters = {k: v - rate * g[k] / len(x[at : at + batch]) for k, v in net.parameters.items()}
    return net, loss


def _batches(batches: Iterator[pd.DataFrame], columns: list[str], samples: int, channels: int) -> Iterator[tuple]:
    for rows in batches:
        if len(rows):
            yield np.stack(rows[columns[0]].to_numpy()).astype(float).reshape(-1, samples, channels), *[rows[c].to_numpy() for c in columns[1:]]


def target_scales(df: DataFrame, y: str, fold: str, folds: int) -> dict[int, tuple[float, float]]:
    """Fold -> mean and deviation of the target without the fold."""
    rows = {r[fold]: r for r in df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q")).collect()}  # a row per fold
    n, s, q = (sum(r[c] for r in rows.values()) for c in "nsq")
    found = {}
    for k in range(folds):
        m, a, b = (n - rows[k]["n"], s - rows[k]["s"], q - rows[k]["q"]) if k in rows else (n, s, q)
        mean = a / m if m else 0.0
        found[k] = mean, max(b / m - mean**2, 1e-12) ** 0.5 if m else 1.0
    return found


def train_out_of_fold(df: DataFrame, x: str, y: str, fold: str, folds: int, samples: int, channels: int, width: int = 25, epochs: int = 60, rate: float = 0.05, batch: int = 16, seed: int = 0) -> tuple[dict[int, WaveNet], list[float], dict]:
    """(fold -> network trained on the other folds, mean squared error met in each epoch, fold -> mean and deviation of its targets).

    ``df`` should be a written table: each epoch reads it once, in tasks that
    stay the same. ``fold`` is 0 to ``folds`` - 1. Targets are standardised by
    the rows of the training folds.
    """
    scales = target_scales(df, y, fold, folds)
    nets = {k: WaveNet(channels, width=width, seed=seed) for k in range(folds)}
    losses = []
    for _ in range(epochs):
        start = {k: flat(n) for k, n in nets.items()}

        def steps(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            own = {k: shaped(WaveNet(channels, width=width), v.copy()) for k, v in start.items()}
            seen, lost = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
            for values, target, at in _batches(batches, [x, y, fold], samples, channels):
                for k, net in own.items():
                    train = at != k
                    if train.any():
                        own[k], loss = local_steps(net, values[train], (target[train] - scales[k][0]) / scales[k][1], rate, batch)
                        seen[k] += int(train.sum())
                        lost[k] += loss
            rows = [(k, np.concatenate([[n, lost[k]], n * flat(own[k])]).tobytes()) for k, n in seen.items() if n]
            if rows:
                yield pd.DataFrame(rows, columns=["fold", "s"])

        met = total = 0.0
        for r in _added(df.select(x, y, fold).mapInPandas(steps, "fold long, s binary"), ["fold"]).collect():
            s = np.frombuffer(r["s"])
            shaped(nets[r["fold"]], s[2:] / s[0])
            met, total = met + s[1], total + s[0]
        losses.append(met / total if total else 0.0)
    return nets, losses, scales


def predictions(df: DataFrame, x: str, fold: str, nets: dict[int, WaveNet], scales: dict, samples: int, channels: int) -> DataFrame:
    """Add ``predicted`` by the network that has not seen the row's fold, in the target's own units."""

    @F.pandas_udf("double")
    def predicted(values: pd.Series, at: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=values.index)
        for k in at.unique():
            own = at == k
            mean, sd = scales[k]
            out[own] = mean + sd * nets[k].predict(np.stack(values[own].to_numpy()).astype(float).reshape(-1, samples, channels))
        return out

    return df.withColumn("predicted", predicted(F.col(x), F.col(fold)))


def saliency(df: DataFrame, x: str, fold: str, nets: dict[int, WaveNet], samples: int, channels: int) -> DataFrame:
    """t, ch, saliency: mean absolute change of the out-of-fold output with each input value."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((samples, channels)), 0
        for values, at in _batches(batches, [x, fold], samples, channels):
            for k in np.unique(at):
                total += np.abs(input_gradient(nets[int(k)], values[at == k])).sum(0)
            n += len(values)
        if n:
            yield pd.DataFrame({"n": [n], "s": [total.ravel().tolist()]})

    cells = df.select(x, fold).mapInPandas(sums, "n long, s array<double>").select("n", F.posexplode("s").alias("place", "v"))
    place = F.col("place")
    return cells.groupBy(F.floor(place / channels).alias("t"), (place % channels).cast("long").alias("ch")).agg((F.sum("v") / F.sum("n")).alias("saliency"))
