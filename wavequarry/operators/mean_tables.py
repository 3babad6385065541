"""Geometric means of any number of groups, held as a table.

A round joins each group's current mean to its matrices, adds up their tangent
vectors natively, and moves the means; the driver sees how many groups are still
moving. So there may be as many groups as there are recordings, or sizes times
seeds of a resampling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from .blocks import null_safe, stored
from .manifold import N
from .stats import numbered

SIZE = N * (N + 1) // 2


def _square(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float).reshape(-1, N, N)


def geometric_mean_table(df: DataFrame, keys: list[str], cov: str, most_rounds: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """keys, n, arithmetic, mean, rounds, converged for each group of matrices ``cov`` (arrays of 16).

    A mean has converged when the mean tangent vector at it is shorter than
    ``tolerance``; one that has not after ``most_rounds`` says so. Null keys are
    a group; matrices that are null, or not positive definite, must be left out
    beforehand (``usable``).
    """
    kinds = dict(df.dtypes)
    rows = stored(df.select(*keys, cov), "matrices")
    own = ", ".join(f"{c} {kinds[c]}" for c in keys)
    state = f"{own}, n long, arithmetic array<double>, mean array<double>, rounds long, converged boolean"
    average = F.array(*[F.avg(F.get(cov, F.lit(k))) for k in range(N * N)])
    table = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), average.alias("arithmetic"))
    table = stored(table.withColumns({"mean": F.col("arithmetic"), "rounds": F.lit(0).cast("long"), "converged": F.lit(False)}), "means")

    def tangents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                w = L.inverse_root(_square(batch["mean"]))
                yield batch[keys].assign(v=list(L.upper(L.log(w @ _square(batch[cov]) @ w))))

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                step = L.from_upper(np.stack(batch["v"].to_numpy()).astype(float))
                base = L.root(_square(batch["mean"]))
                moved = base @ L.exp(step) @ base
                yield batch.drop(columns="v").assign(mean=list(moved.reshape(-1, N * N)), rounds=batch["rounds"] + 1, converged=np.linalg.norm(step, axis=(1, 2)) < tolerance)

    for _ in range(most_rounds):
        open_ = table.where("not converged")
        if open_.isEmpty():
            break
        vectors = null_safe(rows, open_.select(*keys, "mean"), keys).mapInPandas(tangents, f"{own}, v array<double>")
        steps = vectors.groupBy(*keys).agg(F.array(*[F.avg(F.get("v", F.lit(k))) for k in range(SIZE)]).alias("v"))
        table = stored(table.where("converged").unionByName(null_safe(open_, steps, keys).mapInPandas(move, state)), "means")
    return table


def usable(df: DataFrame, cov: str, least: float = 1e-10) -> DataFrame:
    """Rows whose matrix, made symmetric, has no eigenvalue below ``least``, with the symmetric one."""
    schema = df.schema

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch[cov].notna()]
            if len(batch):
                m = _square(batch[cov])
                m = (m + np.swapaxes(m, 1, 2)) / 2
                fine = np.isfinite(m).all((1, 2))
                fine[fine] = np.linalg.eigvalsh(m[fine])[:, 0] >= least
                if fine.any():
                    yield batch[fine].assign(**{cov: list(m[fine].reshape(-1, N * N))})

    return df.mapInPandas(keep, schema)


def swelling_table(means: DataFrame, name: str = "ratio") -> DataFrame:
    """Add ``name``: determinant of the arithmetic mean over that of the geometric one."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series(np.exp(np.linalg.slogdet(_square(a))[1] - np.linalg.slogdet(_square(g))[1]))

    return means.withColumn(name, ratio("arithmetic", "mean"))


def nested_samples(df: DataFrame, key: str, sizes: list[int], seeds: int) -> DataFrame:
    """A row for each row of ``df``, seed and size that it is drawn into: for each seed the rows with the least digests, so that a larger sample holds the smaller ones.

    ``key`` must name the rows. Sizes are numbers of rows; larger ones than
    there are take all.
    """
    digest = F.conv(F.substring(F.md5(F.concat_ws("-", "seed", key).cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = df.select(key).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long")))).withColumn("_draw", digest)
    placed = numbered(stored(drawn, "draws"), ["seed", "_draw", key])
    place = F.col("i") - F.col("seed") * (F.col("n") / seeds).cast("long")  # every seed has all rows
    within = F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]), lambda s: s > place)
    return placed.select(key, "seed", F.explode(within).alias("size")).join(df, key)
