"""Live scoring of covariance windows: calibration by event time, then inference, with state that ends when a recording falls silent.

A recording's samples come in chunks of any size. They are filtered, buffered
and cut into windows that overlap; a window that fails the amplitude gate is
told and otherwise ignored. For some time after a recording's first sample its
windows' covariances are only kept, the last of them; when the time is over
they move the stored reference once, and every later window moves the running
mean and is scored by its distances to both.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dsp
from ..functions import linalg as L

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANNELS = 4
SCORES = "window long, at timestamp, phase string, to_reference double, to_running double, engagement double, score double"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which states of several variables need."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


@dataclass(frozen=True)
class Scoring:
    """How windows are cut, gated and scored; times in milliseconds of event time."""

    window: int
    advance: int
    calibration_ms: int
    idle_ms: int
    reference: tuple[float, ...] = tuple(np.eye(CHANNELS).ravel())
    #: Calibration windows that move the reference, and by how much each; what a later window moves the running mean.
    recent: int = 50
    rate: float = 0.05
    running_rate: float = 0.05
    #: Windows with a larger sample are not scored.
    most: float = float("inf")
    shrink: float = 0.15
    ridge: float = 0.0
    bound: float = 3.0
    #: Weights of the log map's upper triangle at the reference, and what is added.
    weights: tuple[float, ...] = (0.0,) * (CHANNELS * (CHANNELS + 1) // 2)
    intercept: float = 50.0
    band: tuple[tuple[float, ...], tuple[float, ...]] | None = None
    clip: float = float("inf")
    key: str = "key"
    key_type: str = field(default="long")


#: Windows that are worked on side by side.
SIDE_BY_SIDE = 4096


def window_covariance(x: np.ndarray, shrink: float, ridge: float) -> np.ndarray:
    """Sample covariances of windows (..., samples, channels), each drawn to a multiple of the identity of the same trace, and ``ridge`` on the diagonal."""
    c = L.covariances(x, ridge=0.0)
    level = shrink * np.trace(c, axis1=-2, axis2=-1) / c.shape[-1] + ridge
    return (1 - shrink) * c + level[..., None, None] * np.eye(c.shape[-1])


def log_map(m: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Upper triangle of R^1/2 log(R^-1/2 M R^-1/2) R^1/2, off-diagonal times sqrt 2."""
    r = L.root(reference)
    return L.upper(r @ L.log(L.whiten(m, reference)) @ r)


class Session:
    """A recording's state and what a chunk makes of it; knows nothing of Spark."""

    def __init__(self, how: Scoring, started: int):
        self.how, self.started, self.last, self.windows, self.refined = how, started, started, 0, False
        self.buffer = np.zeros((0, CHANNELS))
        self.filter: np.ndarray | None = None
        self.recent: list[np.ndarray] = []
        self.reference = np.array(how.reference).reshape(CHANNELS, CHANNELS)
        self.running = self.reference

    def take(self, chunk: np.ndarray, at: int | np.ndarray) -> list[tuple]:
        """(window, at, phase, distances to the reference and the running mean, engagement, score) of each window that the samples complete.

        ``at`` is the time of each sample, or of all; a window's is that of its
        last sample. Only the running mean goes from window to window, the rest
        is worked out for many windows at once.
        """
        how, found = self.how, []
        if how.band:
            b, a = map(np.array, how.band)
            if self.filter is None:
                self.filter = np.repeat(dsp.steady_state(b, a)[:, None], CHANNELS, 1)
            chunk, self.filter = dsp.run_filter(b, a, chunk, self.filter)
        at = np.concatenate([np.zeros(len(self.buffer), np.int64), np.broadcast_to(np.asarray(at, np.int64), len(chunk))])
        self.buffer = np.concatenate([self.buffer, np.clip(chunk, -how.clip, how.clip)])
        starts = np.arange(0, len(self.buffer) - how.window + 1, how.advance)
        for k in range(0, len(starts), SIDE_BY_SIDE):
            part = starts[k : k + SIDE_BY_SIDE]
            found += self._judge(self.buffer[part[:, None] + np.arange(how.window)], at[part + how.window - 1])
        if len(starts):
            self.buffer = self.buffer[starts[-1] + how.advance :]
        return found

    def _judge(self, x: np.ndarray, at: np.ndarray) -> list[tuple]:
        """What ``take`` gives of whole windows (k, samples, channels) in order."""
        how = self.how
        gated = np.abs(x).max((1, 2)) > how.most
        early = ~gated & (at - self.started < how.calibration_ms)
        late = ~gated & ~early
        covs = window_covariance(x, how.shrink, how.ridge)
        self.recent = [*self.recent, *covs[early]][-how.recent :]
        told = {}
        if late.any():
            if not self.refined:
                for kept in self.recent:
                    self.reference = L.along(self.reference, kept, how.rate)
                self.running, self.refined, self.recent = self.reference, True, []
            c, means = covs[late], np.empty_like(covs[late])
            for k, cov in enumerate(c):
                means[k] = self.running = L.along(self.running, cov, how.running_rate)
            far, near = L.distance(self.reference, c), L.distance(means, c)
            scores = np.clip(log_map(c, self.reference) @ np.array(how.weights) + how.intercept, 0.0, 100.0)
            away = np.clip(2 * (far - near), -how.bound, how.bound)
            told = dict(zip(np.flatnonzero(late).tolist(), zip(far.tolist(), near.tolist(), away.tolist(), scores.tolist())))
        found = []
        for k, when in enumerate(at.tolist()):
            self.windows += 1
            phase = "gated" if gated[k] else "calibration" if early[k] else "inference"
            found.append((self.windows, when, phase, *told.get(k, (None,) * 4)))
        return found


def rearm(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer of the key, at ``at``."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(at)


class LiveScorer(StatefulProcessor):
    """``Session`` per key: its numbers, buffer and means as values, its calibration windows as a list, a timer for silence."""

    def __init__(self, how: Scoring):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "started long, last long, windows long, refined boolean")
        self.arrays = handle.getValueState("arrays", "buffer array<double>, filter array<double>, reference array<double>, running array<double>")
        self.recent = handle.getListState("recent", "c array<double>")

    def _load(self, started: int) -> Session:
        session = Session(self.how, started)
        if self.numbers.exists():
            session.started, session.last, session.windows, session.refined = self.numbers.get()
            buffer, kept, reference, running = self.arrays.get()
            square = lambda v: np.array(v, float).reshape(CHANNELS, CHANNELS)
            session.buffer = np.array(buffer, float).reshape(-1, CHANNELS)
            session.filter = np.array(kept, float).reshape(-1, CHANNELS) if len(kept) else None
            session.reference, session.running = square(reference), square(running)
            session.recent = [square(c) for (c,) in self.recent.get()]
        return session

    def _save(self, session: Session) -> None:
        flat = lambda m: [] if m is None else np.asarray(m).ravel().tolist()
        self.numbers.update((session.started, session.last, session.windows, session.refined))
        self.arrays.update((flat(session.buffer), flat(session.filter), flat(session.reference), flat(session.running)))
        if session.recent:
            self.recent.put([(flat(c),) for c in session.recent])
        else:
            self.recent.clear()

    def _told(self, key, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in SCORES.split(", ")]
        found = pd.DataFrame(rows, columns=names)
        found["at"] = pd.to_datetime(found["at"], unit="ms")
        found = found.astype({c: float for c in names[3:]} | {"window": "int64"})
        found.insert(0, self.how.key, key[0])
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "nth"], kind="stable")
        session = self._load(int(batch["ms"].iloc[0]))
        batch = batch[batch["ms"] >= session.last]  # in order, so none is before another of them
        found = []
        if len(batch):
            session.last = int(batch["ms"].iloc[-1])
            chunks = [np.asarray(x, float).reshape(-1, CHANNELS) for x in batch["x"]]
            found = session.take(np.concatenate(chunks), np.repeat(batch["ms"].to_numpy(np.int64), [len(x) for x in chunks]))
        self._save(session)
        rearm(self.handle, session.last + self.how.idle_ms)
        yield self._told(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        windows = self.numbers.get()[2] if self.numbers.exists() else 0
        for state in (self.numbers, self.arrays, self.recent):
            state.clear()
        yield self._told(key, [(windows, expiredTimerInfo.getExpiryTimeInMs(), "silent", None, None, None, None)])

    def close(self) -> None:
        pass


def scored(stream: DataFrame, how: Scoring, late: str) -> DataFrame:
    """key, window, at, phase, to_reference, to_running, engagement, score of a stream (key, ts, nth, x).

    ``x`` are the samples of a chunk, channel by channel of each. Rows of a
    batch are put in order by time and ``nth``; rows that are older than what
    their recording has given in an earlier batch are dropped, as a filter does
    not turn back, and so are those ``late`` behind the newest of all. A recording that says nothing for ``idle_ms`` of
    event time is told as silent and its state deleted: if it speaks again it is
    calibrated again. Start the query within ``rocks``. In append mode every
    window is told once; after a restart the state goes on from the checkpoint.
    """
    rows = stream.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"), "nth", "x").withColumnRenamed("key", how.key)
    return rows.groupBy(how.key).transformWithStateInPandas(LiveScorer(how), f"{how.key} {how.key_type}, {SCORES}", "Append", "EventTime")
