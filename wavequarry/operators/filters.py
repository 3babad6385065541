"""Filters over recordings of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from .blocks import SIZE, blocks, null_safe, stored
from .ordered import ordered_fold


def causal(df: DataFrame, keys: list[str], order: list[str], value: str, b: np.ndarray, a: np.ndarray, steady: bool = False, clip: float | None = None) -> DataFrame:
    """keys, order, filtered: the recursive filter from rest, or from its steady state, with the state carried along."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, *order)) + ", filtered double"

    def step(state, rows: pd.DataFrame):
        out, state = dsp.run_filter(b, a, rows[value].to_numpy(float), state)
        out = out if clip is None else np.clip(out, -clip, clip)
        return state, rows[[*keys, *order]].assign(filtered=out)

    return ordered_fold(df, keys, order, lambda: dsp.steady_state(b, a) if steady else None, step, schema)


def _zero_phase(x: np.ndarray, filters: list[dsp.Recursion]) -> np.ndarray:
    """All filters over a whole recording."""
    for f in filters:
        edge = min(f.edge, len(x) - 1)
        if edge < 1:
            return x
        x = dsp.extended(x, edge)
        for _ in range(2):
            x = f.run(x, f.settled(x[0]))[0][::-1]
        x = x[edge : len(x) - edge]
    return x


def _passes(filters: list[dsp.Recursion], k: int, channels: int):
    """Pass k over blocks: apply direction k - 1 from the state that its start was found to have, then tell what direction k makes of a state.

    Even directions go forwards over a filter's input, whose ends are extended
    first; odd ones go back, and take the extensions off.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xs, adds, starts = [], [], []
            for x, z, first, last in zip(batch["x"], batch["z"], batch["first"], batch["last"]):
                x = x.reshape(-1, channels)
                if k:
                    f, back = filters[(k - 1) // 2], (k - 1) % 2
                    x = f.run(x[::-1] if back else x, z.reshape(-1, channels))[0]
                    if back:
                        x = x[::-1][f.edge if first else 0 : len(x) - f.edge if last else None]
                if k < 2 * len(filters):
                    f, back = filters[k // 2], k % 2
                    if not back:
                        x = dsp.extended(x, f.edge, first, last)
                    way = x[::-1] if back else x
                    adds.append(f.run(way)[1].ravel().tolist())
                    starts.append(f.settled(way[0]).ravel().tolist() if (last if back else first) else None)
                else:
                    adds.append(None)
                    starts.append(None)
                xs.append(x.ravel())
            yield batch.assign(x=xs, add=adds, start=starts, n=[len(x) // channels for x in xs])

    return run


def _states(blocks: DataFrame, keys: list[str], f: dsp.Recursion, back: bool, channels: int) -> DataFrame:
    """keys, block, z: the filter's state where each block starts, by composing the maps of the blocks before it."""
    kinds = dict(blocks.dtypes)
    powers: dict[int, np.ndarray] = {}

    def step(state, rows: pd.DataFrame):
        found = []
        for start, add, n in zip(rows["start"], rows["add"], rows["n"]):
            state = np.array(start, float).reshape(-1, channels) if start is not None else state
            found.append(state.ravel().tolist())
            if n not in powers:
                powers[n] = f.power(n)
            state = powers[n] @ state + np.array(add, float).reshape(-1, channels)
        return state, rows[[*keys, "block"]].assign(z=found)

    rows = blocks.select(*keys, "block", "start", "add", "n", (-F.col("block") if back else F.col("block")).alias("_turn"))
    return ordered_fold(rows, keys, ["_turn"], lambda: None, step, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", block long, z array<double>")


def zero_phase_chain(df: DataFrame, keys: list[str], order: list[str], value: str, stages: list[np.ndarray], size: int = SIZE, channels: int = 0) -> DataFrame:
    """keys, order, filtered: zero-phase filters one after another, over recordings of any length.

    Recordings are cut into blocks. A filter is an affine map of its state, so
    for each direction of each filter the blocks tell at once what they make of
    a state, the maps are composed block after block, a row each, and all
    blocks filter at once from the right state. Recordings of one block go
    through all filters in a single pass. Null keys are one recording; ``order``
    must name a recording's samples; an empty table gives no rows. ``stages``
    are the filters' sections. With ``channels``, values are arrays of so many
    channels, which are filtered side by side.
    """
    wide = channels or 1
    filters = [dsp.Recursion(sections) for sections in stages]
    size = max([size, *(2 * f.edge for f in filters)])
    kinds = dict(df.dtypes)
    cut = stored(blocks(df, keys, order, value, size), "blocks")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(x=[_zero_phase(x.reshape(-1, wide), filters).ravel() for x in batch["x"]])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", block long, x array<double>"
    done = cut.where("first and last").select(*keys, "block", "x").mapInPandas(whole, schema)
    long = cut.where("not (first and last)")
    if not long.isEmpty():
        now = long.select(*keys, "block", "first", "last", "x", F.lit(None).cast("array<double>").alias("z"))
        told = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", block long, first boolean, last boolean, x array<double>, z array<double>, add array<double>, start array<double>, n long"
        for k in range(2 * len(filters) + 1):
            now = stored(now.mapInPandas(_passes(filters, k, wide), told), "pass")
            if k < 2 * len(filters):
                states = _states(now, keys, filters[k // 2], k % 2 == 1, wide)
                now = null_safe(now.select(*keys, "block", "first", "last", "x"), states, [*keys, "block"])
        done = done.unionByName(now.select(*keys, "block", "x"))
    placed = null_safe(cut.select(*keys, "block", "at"), done, [*keys, "block"])
    if channels:
        placed = placed.withColumn("x", F.transform(F.sequence(F.lit(0), F.size("at") - 1), lambda k: F.slice("x", k * channels + 1, channels)))
    rows = placed.select(*keys, F.inline(F.arrays_zip("at", "x")))
    return rows.select(*keys, *[F.col(f"at.{c}").alias(c) for c in order], F.col("x").alias("filtered"))


def from_rest(df: DataFrame, keys: list[str], block: str, order: list[str], value: str, b: np.ndarray, a: np.ndarray) -> DataFrame:
    """keys, block, order, filtered: each block filtered by itself, from rest, without the state that the one before it left."""
    return causal(df, [*keys, block], order, value, b, a)


def leaky_neuron(df: DataFrame, keys: list[str], order: list[str], drive: str, leak: float = 0.9, threshold: float = 1.0, trace: float = 0.8, rate: float = 0.01) -> DataFrame:
    """keys, order, spike, weight: a neuron that leaks, fires above the threshold and starts again from 0.

    Its synapse grows by the trace of recent drive when it fires and shrinks by
    the trace of recent spikes otherwise; the weight stays within 0 and 1.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, *order)) + ", spike long, weight double"

    def step(state, rows: pd.DataFrame):
        potential, before, after, weight = state
        found = []
        for x in rows[drive].to_numpy(float):
            potential = leak * potential + weight * x
            before = trace * before + x
            fired = potential >= threshold
            weight = weight + rate * before if fired else weight - rate * after
            weight = min(1.0, max(0.0, weight))
            after = trace * after + fired
            potential = 0.0 if fired else potential
            found.append((int(fired), weight))
        out = pd.DataFrame(found, columns=["spike", "weight"], index=rows.index)
        return (potential, before, after, weight), pd.concat([rows[[*keys, *order]], out], axis=1)

    return ordered_fold(df, keys, order, lambda: (0.0, 0.0, 0.0, 0.5), step, schema)


def running_moments(df: DataFrame, keys: list[str], order: list[str], values: list[str], alpha: float = 0.1, ridge: float = 1e-6, start: float = 0.1) -> DataFrame:
    """keys, order, mean, cov (row by row): exponential mean and covariance of ``values`` after each sample.

    The mean starts at the first sample, the covariance at ``start`` times the
    identity; a sample adds the product of its distance from the mean before it, and
    ``ridge`` keeps the matrix positive definite.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, *order)) + ", mean array<double>, cov array<double>"

    def step(state, rows: pd.DataFrame):
        means, covs = [], []
        for x in rows[values].to_numpy(float):
            if state is None:
                state = x, start * np.eye(len(values))
            else:
                mean, cov = state
                off = x - mean
                state = mean + alpha * off, (1 - alpha) * cov + alpha * np.outer(off, off) + ridge * np.eye(len(values))
            means.append(state[0])
            covs.append(state[1].ravel())
        return state, rows[[*keys, *order]].assign(mean=means, cov=covs)

    return ordered_fold(df, keys, order, lambda: None, step, schema)
