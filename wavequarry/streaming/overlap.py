"""Live source removal by a fixed matrix over overlapping windows, whose results are blended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .phases import rearm

OUT = "sample long, clean array<double>, blends long"


class Blend:
    """Windows of a recording, each cleaned about its own mean; where windows overlap, what was there and what comes count half each.

    A window is taken when a sample beyond it is there. Samples that no later
    window covers are given out; the rest of the last window is kept.
    """

    def __init__(self, window: int, step: int, channels: int, first: int = 0, buffer: np.ndarray | None = None, blended: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.window, self.step, self.first = window, step, first
        none = np.zeros((0, channels))
        self.buffer, self.blended = none if buffer is None else buffer, none if blended is None else blended
        self.counts = np.zeros(0, int) if counts is None else counts

    def take(self, chunk: np.ndarray, remover: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
        """(sample, channels, windows that it is blended from) of the samples that are finished."""
        self.buffer = np.concatenate([self.buffer, chunk])
        found = []
        while len(self.buffer) > self.window:
            x = self.buffer[: self.window]
            mean = x.mean(0)
            clean = (x - mean) @ remover.T + mean
            n = len(self.blended)
            self.blended = np.concatenate([0.5 * self.blended + 0.5 * clean[:n], clean[n:]])
            self.counts = np.concatenate([self.counts + 1, np.ones(self.window - n, int)])
            found += [(self.first + k, self.blended[k], int(self.counts[k])) for k in range(self.step)]
            self.blended, self.counts, self.buffer = self.blended[self.step :], self.counts[self.step :], self.buffer[self.step :]
            self.first += self.step
        return found


class OverlapAdder(StatefulProcessor):
    """``Blend`` per key; a silent recording's state is deleted by a timer."""

    def __init__(self, window: int, step: int, channels: int, idle_ms: int, key: str):
        self.window, self.step, self.channels, self.idle_ms, self.key = window, step, channels, idle_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("blend", "first long, last long, buffer array<double>, blended array<double>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "nth"], kind="stable")
        square = lambda v: np.array(v, float).reshape(-1, self.channels)
        blend, last = Blend(self.window, self.step, self.channels), int(batch["ms"].iloc[0])
        if self.state.exists():
            first, last, buffer, blended, counts = self.state.get()
            blend = Blend(self.window, self.step, self.channels, first, square(buffer), square(blended), np.array(counts, int))
        found = []
        for x, remover, at in zip(batch["x"], batch["remover"], batch["ms"]):
            if at >= last:
                last = int(at)
                found += blend.take(square(x), square(remover))
        self.state.update((blend.first, last, blend.buffer.ravel().tolist(), blend.blended.ravel().tolist(), blend.counts.tolist()))
        rearm(self.handle, last + self.idle_ms)
        if found:
            yield pd.DataFrame({self.key: key[0], "sample": [f[0] for f in found], "clean": [f[1].tolist() for f in found], "blends": [f[2] for f in found]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def cleaned(stream: DataFrame, removers: DataFrame, key: str, window: int, step: int, channels: int, idle_ms: int, late: str) -> DataFrame:
    """key, sample, clean, blends of a stream (key, ts, nth, x), each recording by its own row of ``removers`` (key, remover), which are fitted beforehand.

    Samples are numbered from the recording's first. Recordings without a
    remover are left out. Start the query within ``phases.rocks``.
    """
    rows = stream.withColumnRenamed("key", key).withWatermark("ts", late).join(removers.select(key, "remover"), key)
    rows = rows.select(key, "ts", F.unix_millis("ts").alias("ms"), "nth", "x", "remover")
    kind = dict(removers.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(OverlapAdder(window, step, channels, idle_ms, key), f"{key} {kind}, {OUT}", "Append", "EventTime")
