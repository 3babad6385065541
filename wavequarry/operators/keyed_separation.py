"""Source separation of many recordings at once: a fit per recording, all fits a table.

A recording's lagged covariances, and the moments that FastICA asks for in a
round, are sums over its blocks. Fits are rows (mean, unmixing matrix) that are
joined to the blocks, so no recordings pass through the driver, and fits only
of those that are too long for a task. Recordings of one block are fitted where
they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import null_safe, stored, summed
from .separation import _whitener, joint_diagonalizer

FIT = "mean array<double>, unmixing array<double>, rounds long, converged boolean"

#: Bytes of samples up to which a task fits a recording by itself; of longer recordings, how many fits the driver holds at a time.
WHOLE, HELD = 1 << 26, 256


def _keyed(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in keys)


def _lag_sums(x: np.ndarray, before: np.ndarray, lags: int) -> np.ndarray:
    """Number, sums and products of x, and for each lag the number of pairs and the sums of both sides and of their products; ``before`` are the samples before x."""
    found = [[len(x)], x.sum(0), (x.T @ x).ravel()]
    whole = np.concatenate([before, x])
    for k in range(1, lags + 1):
        now = whole[max(k, len(before)) :]
        then = whole[max(k, len(before)) - k : max(len(whole) - k, 0)]
        found += [[len(now)], now.sum(0), then.sum(0), (now.T @ then).ravel()]
    return np.concatenate(found)


def _sobi_of_sums(s: np.ndarray, channels: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and unmixing matrix from the sums of ``_lag_sums``."""
    c, at = channels, 0

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return s[at - n : at]

    n = take(1)[0]
    mean = take(c) / n
    white = _whitener(take(c * c).reshape(c, c) / n - np.outer(mean, mean))
    turned = []
    for _ in range(lags):
        pairs, now, then, products = take(1)[0], take(c), take(c), take(c * c).reshape(c, c)
        if pairs:
            m = (products - np.outer(now, mean) - np.outer(mean, then)) / pairs + np.outer(mean, mean)
            turned.append(white @ ((m + m.T) / 2) @ white.T)
    return mean, joint_diagonalizer(turned).T @ white if turned else white


def sobi_by_recording(blocks: DataFrame, keys: list[str], channels: int, lags: int = 20) -> DataFrame:
    """keys, mean, unmixing, rounds, converged: second-order blind identification of each recording of ``blocks`` (see ``blocks.blocks``).

    Pairs of samples that lie in two blocks count too. Lags that a recording is
    too short for are left out; one sample has a whitening matrix only.
    """
    tails = blocks.where("not last").select(*keys, (F.col("block") + 1).alias("block"), F.slice("x", -lags * channels, lags * channels).alias("before"))
    rows = null_safe(blocks.select(*keys, "block", "x"), tails, [*keys, "block"], "left")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            none = np.zeros((0, channels))
            yield batch[keys].assign(s=[_lag_sums(x.reshape(-1, channels), none if b is None else b.reshape(-1, channels), lags).tolist() for x, b in zip(batch["x"], batch["before"])])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [_sobi_of_sums(s, channels, lags) for s in batch["s"]]
            yield batch[keys].assign(mean=[m.tolist() for m, _ in fits], unmixing=[w.ravel().tolist() for _, w in fits], rounds=1, converged=True)

    parts = rows.mapInPandas(sums, f"{_keyed(blocks, keys)}, s array<double>")
    return summed(parts, keys, "s").mapInPandas(fit, f"{_keyed(blocks, keys)}, {FIT}")


def _orthogonal(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def _contrast_sums(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    g = np.tanh(z @ w.T)
    return np.concatenate([(g.T @ z).ravel(), (1 - g**2).sum(0)])


def _step(s: np.ndarray, n: float, w: np.ndarray) -> tuple[np.ndarray, float]:
    """The next unmixing of white samples, and how far it turned."""
    k = len(w)
    new = _orthogonal(s[: k * k].reshape(k, k) / n - (s[k * k :] / n)[:, None] * w)
    return new, float(np.abs(np.abs((new * w).sum(1)) - 1).max())


def _turned(parts: list[np.ndarray], w: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, int, bool]:
    """The unmixing of a recording's white samples from ``w`` on, the rounds it took, and whether it came to rest."""
    size = sum(map(len, parts))
    for n in range(1, rounds + 1):  # noqa: B007
        w, turned = _step(sum(_contrast_sums(z, w) for z in parts), size, w)
        if turned < tolerance:
            break
    return w, n, turned < tolerance


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])


def _centred(s: np.ndarray, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and whitening matrix from the sums of ``_moments``."""
    mean = s[1 : channels + 1] / s[0]
    return mean, _whitener(s[channels + 1 :].reshape(channels, channels) / s[0] - np.outer(mean, mean))


def _fitted_by_jobs(blocks: DataFrame, held: list[tuple], keys: list[str], first: np.ndarray, rounds: int, tolerance: float) -> DataFrame:
    """Fits of the recordings whose keys are ``held``: the driver turns their matrices, a job a round sums over their blocks."""
    spark, k, own = blocks.sparkSession, len(first), _keyed(blocks, keys)
    places = spark.createDataFrame([(*key, i) for i, key in enumerate(held)], f"{own}, place long")
    tasks = spark.sparkContext.defaultParallelism
    rows = null_safe(blocks, F.broadcast(places), keys).repartition(tasks, "place", "block").sortWithinPartitions("place", "block")
    rows = stored(rows.select("place", "x"), "places")

    def totals(open_: list[int], of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
        """Sums of ``of`` over the blocks of each place: a task adds up its own and gives a row a place."""

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, x in zip(batch["place"], batch["x"]):
                    found[i] = found.get(i, 0.0) + of(i, x.reshape(-1, k))
            if found:
                yield pd.DataFrame({"place": list(found), "s": [s.tolist() for s in found.values()]})

        whole: dict[int, np.ndarray] = {}
        for r in rows.where(F.col("place").isin(open_)).coalesce(tasks).mapInPandas(sums, "place long, s array<double>").collect():
            whole[r.place] = whole.get(r.place, 0.0) + np.array(r.s)
        return whole

    sizes = totals(list(range(len(held))), lambda i, x: _moments(x))
    centre = {i: _centred(s, k) for i, s in sizes.items()}
    w, taken, open_ = dict.fromkeys(sizes, first), dict.fromkeys(sizes, (0, False)), list(sizes)
    for n in range(1, rounds + 1):
        if not open_:
            break
        now = {i: (*centre[i], w[i]) for i in open_}
        for i, s in totals(open_, lambda i, x, now=now: _contrast_sums((x - now[i][0]) @ now[i][1].T, now[i][2])).items():
            w[i], turned = _step(s, sizes[i][0], w[i])
            taken[i] = n, turned < tolerance
        open_ = [i for i in open_ if not taken[i][1]]
    return spark.createDataFrame([(*held[i], centre[i][0].tolist(), (w[i] @ centre[i][1]).ravel().tolist(), *taken[i]) for i in sizes], f"{own}, {FIT}")


def fast_ica_by_recording(blocks: DataFrame, keys: list[str], channels: int, rounds: int = 200, tolerance: float = 1e-4, seed: int = 42) -> DataFrame:
    """keys, mean, unmixing, rounds, converged: symmetric FastICA with the log-cosh contrast for each recording of ``blocks``.

    Recordings of one block are fitted where they are, others of up to ``WHOLE``
    bytes in a task each, so that their rounds cost no jobs. For longer ones,
    ``HELD`` at a time, a round is one job of sums over their blocks. Blocks are
    added up in order. Who has not converged after ``rounds`` says so.
    """
    k, own = channels, _keyed(blocks, keys)
    first = _orthogonal(np.random.default_rng(seed).normal(size=(k, k)))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x in batch["x"]:
                x = x.reshape(-1, k)
                mean, white = x.mean(0), _whitener(np.cov(x.T, bias=True).reshape(k, k))
                w, n, done = _turned([(x - mean) @ white.T], first, rounds, tolerance)
                found.append((mean.tolist(), (w @ white).ravel().tolist(), n, done))
            yield batch[keys].assign(**dict(zip(("mean", "unmixing", "rounds", "converged"), map(list, zip(*found)))))

    def gathered(recording: pd.DataFrame) -> pd.DataFrame:
        parts = [x.reshape(-1, k) for x in recording.sort_values("block")["x"]]
        mean, white = _centred(sum(map(_moments, parts)), k)
        w, n, done = _turned([(x - mean) @ white.T for x in parts], first, rounds, tolerance)
        return recording[keys].head(1).assign(mean=[mean.tolist()], unmixing=[(w @ white).ravel().tolist()], rounds=n, converged=done)

    done = blocks.where("first and last").select(*keys, "x").mapInPandas(whole, f"{own}, {FIT}")
    several = blocks.where("not (first and last)").select(*keys, "block", "x")
    sizes = stored(several.groupBy(*keys).agg((F.sum(F.size("x")) * 8).alias("bytes")), "sizes")
    if sizes.isEmpty():
        return done
    tasks = 4 * sizes.sparkSession.sparkContext.defaultParallelism
    parts = null_safe(several, sizes.where(F.col("bytes") <= WHOLE).select(*keys), keys).repartition(tasks, *keys)
    found = [done, parts.groupBy(*keys).applyInPandas(gathered, f"{own}, {FIT}")]
    for held in batched(map(tuple, sizes.where(F.col("bytes") > WHOLE).select(*keys).toLocalIterator()), HELD):
        found.append(_fitted_by_jobs(several, list(held), keys, first, rounds, tolerance))
    return reduce(DataFrame.union, found)


def components(x: Column, mean: Column, unmixing: Column, channels: int) -> Column:
    """The sources of a sample as an array."""
    off = F.zip_with(x, mean, lambda v, m: v - m)
    rows = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: F.slice(unmixing, i * channels + 1, channels))
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, off, lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v))


def strongest(rows: DataFrame, fits: DataFrame, keys: list[str], x: str, channels: int) -> DataFrame:
    """keys, component: the source with the largest absolute value of each recording, the first of several."""
    sources = null_safe(rows.select(*keys, x), fits.select(*keys, "mean", "unmixing"), keys).select(*keys, components(F.col(x), F.col("mean"), F.col("unmixing"), channels).alias("_s"))
    peaks = [F.max(F.abs(F.get("_s", F.lit(k)))) for k in range(channels)]
    return sources.groupBy(*keys).agg(F.array(*peaks).alias("_peaks")).select(*keys, (F.array_position("_peaks", F.array_max("_peaks")) - 1).cast("int").alias("component"))


def removers(fits: DataFrame, picked: DataFrame, keys: list[str], channels: int, factor: float = 0.0) -> DataFrame:
    """keys, mean, remover: the matrix that rebuilds channels with the picked source times ``factor``."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for w, component in zip(batch["unmixing"], batch["component"]):
                w = w.reshape(channels, channels)
                scale = np.ones(channels)
                scale[component] = factor
                found.append((np.linalg.inv(w) @ np.diag(scale) @ w).ravel().tolist())
            yield batch[[*keys, "mean"]].assign(remover=found)

    rows = null_safe(fits.select(*keys, "mean", "unmixing"), picked, keys)
    return rows.mapInPandas(build, f"{_keyed(fits, keys)}, mean array<double>, remover array<double>")


def rebuilt(x: Column, mean: Column, remover: Column, channels: int) -> Column:
    """A sample's channels without what its recording's remover takes out."""
    return F.zip_with(components(x, mean, remover, channels), mean, lambda v, m: v + m)
