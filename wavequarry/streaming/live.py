"""Live forms of the operators: Structured Streaming over a folder of event files.

Each stateful operator sorts what a batch brings per recording, goes on from
its state, and keeps no more than its window. ``drain`` runs a stream over what
is there and returns the rows it wrote, so tests can hold it against the batch.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import dsp
from ..operators.aggregates import exact_mean
from ..operators.packets import decode_frames
from ..session import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: str = "events*.parquet", per_batch: int = 1) -> DataFrame:
    """Events of the folder's files as a stream, oldest file first and ``per_batch`` to a batch, time as TIMESTAMP so that it can carry a watermark.

    A batch's rows of a recording are held while they are put in order, so the
    size of a file bounds the memory. Files must follow one another in time:
    an operator with state goes on from the last batch and does not turn back
    for a row that comes a file late.
    """
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Write all that the stream gives now as Parquet in the shared folder, exactly once, and read it.

    In complete mode the last result stays; else every batch's rows do. In
    update mode a batch has a folder of its own, so one that is repeated after
    a failure replaces its rows.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/rows")
    elif mode == "complete":
        writer = stream.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/rows"))
    else:
        writer = stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/rows/batch={n}"))
    query = writer.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows").select(stream.columns)


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    """day window start, event_type, n, mean; late rows beyond the watermark are dropped."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), exact_mean("value", 2).alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])


def gap_counts(stream: DataFrame, modulus: int = 256) -> DataFrame:
    """user_id, received, lost so far, by a packet counter that wraps; state: last counter and both counts."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, received, lost = state.get if state.exists else (None, 0, 0)
        for seq in _in_order(batches)["event_id"] % modulus:
            lost += 0 if last is None else int((seq - last - 1) % modulus)
            last, received = int(seq), received + 1
        state.update((last, received, lost))
        yield pd.DataFrame({"user_id": [key[0]], "received": [received], "lost": [lost]})

    rows = stream.select("user_id", "ts", "event_id")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, received long, lost long", "last long, received long, lost long", "update", GroupStateTimeout.NoTimeout)


def majority(stream: DataFrame, size: int = 5) -> DataFrame:
    """user_id, event_id, smoothed: majority of the last ``size`` labels, the smallest of several; null until there are so many."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows, found = _in_order(batches), []
        for label in rows["event_type"]:
            recent = (recent + [label])[-size:]
            votes = Counter(recent)
            found.append(min(votes, key=lambda c: (-votes[c], c)) if len(recent) == size else None)
        state.update((recent,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "smoothed": pd.Series(found, index=rows.index, dtype=object)})

    rows = stream.select("user_id", "ts", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, smoothed string", "recent array<string>", "append", GroupStateTimeout.NoTimeout)


def filtered(stream: DataFrame, b: np.ndarray, a: np.ndarray) -> DataFrame:
    """user_id, event_id, filtered: the causal filter with its state carried between batches."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(batches)
        out, after = dsp.run_filter(b, a, rows["value"].to_numpy(float), np.array(state.get[0]) if state.exists else None)
        state.update((after.tolist(),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "filtered": out})

    rows = stream.select("user_id", "ts", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, filtered double", "z array<double>", "append", GroupStateTimeout.NoTimeout)


def calibrated(stream: DataFrame, calibration: int = 20, alpha: float = 0.05, bound: float = 3.0) -> DataFrame:
    """user_id, event_id, phase, score: the first ``calibration`` samples set mean and deviation, the rest is scored.

    The running mean moves before the score is taken, which is its distance to
    the calibrated mean in calibrated deviations, clipped to ``bound``.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, squares, running = state.get if state.exists else (0, 0.0, 0.0, None)
        rows, found = _in_order(batches), []
        for v in rows["value"]:
            if n < calibration:
                n, total, squares = n + 1, total + v, squares + v * v
                found.append(("calibration", None))
                continue
            mean = total / n
            deviation = max(squares / n - mean * mean, 1e-12) ** 0.5
            running = (1 - alpha) * (mean if running is None else running) + alpha * v
            found.append(("inference", float(np.clip((running - mean) / deviation, -bound, bound))))
        state.update((n, float(total), float(squares), running))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "phase": [f[0] for f in found], "score": pd.Series([f[1] for f in found], index=rows.index, dtype=float)})

    rows = stream.select("user_id", "ts", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, phase string, score double", "n long, total double, squares double, running double", "append", GroupStateTimeout.NoTimeout)


def emitted(stream: DataFrame, size: int = 8, step: int = 4) -> DataFrame:
    """user_id, rn, mean, spread of the last ``size`` samples, at every ``step``-th sample once the ring is full; state: the ring and a counter."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        found = []
        for v in _in_order(batches)["value"]:
            ring, n = (ring + [float(v)])[-size:], n + 1
            if n >= size and n % step == 0:
                found.append((key[0], n, float(np.mean(ring)), max(ring) - min(ring)))
        state.update((ring, n))
        yield pd.DataFrame(found, columns=["user_id", "rn", "mean", "spread"]).astype({"user_id": "int64", "rn": "int64", "mean": float, "spread": float})

    rows = stream.select("user_id", "ts", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, rn long, mean double, spread double", "ring array<double>, n long", "append", GroupStateTimeout.NoTimeout)


def running(stream: DataFrame, alpha: float = 0.1) -> DataFrame:
    """user_id, n, ew: exponentially weighted mean so far, from the first sample; one update per recording and batch."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, m = state.get if state.exists else (0, None)
        for v in _in_order(batches)["value"]:
            n, m = n + 1, float(v) if m is None else (1 - alpha) * m + alpha * float(v)
        state.update((n, m))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ew": [m]})

    rows = stream.select("user_id", "ts", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, n long, ew double", "n long, ew double", "update", GroupStateTimeout.NoTimeout)


def running_covariance(stream: DataFrame, alpha: float = 0.1, ridge: float = 1e-6, start: float = 0.1) -> DataFrame:
    """user_id, n, mean, var_now, cov_lag, var_before so far, of each sample and the one before it (0 before the first); one update per recording and batch.

    As ``filters.running_moments``: the covariance starts at ``start`` times the
    identity; a sample adds the product of its distance from the mean before it.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, before, mean, cov = (state.get[0], state.get[1], np.array(state.get[2]), np.array(state.get[3]).reshape(2, 2)) if state.exists else (0, 0.0, None, start * np.eye(2))
        for v in _in_order(batches)["value"].astype(float):
            x = np.array([v, before])
            if mean is None:
                mean = x
            else:
                off = x - mean
                mean, cov = mean + alpha * off, (1 - alpha) * cov + alpha * np.outer(off, off) + ridge * np.eye(2)
            n, before = n + 1, float(v)
        state.update((n, before, mean.tolist(), cov.ravel().tolist()))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [mean[0]], "var_now": [cov[0, 0]], "cov_lag": [cov[0, 1]], "var_before": [cov[1, 1]]})

    rows = stream.select("user_id", "ts", "event_id", "value")
    out = "user_id long, n long, mean double, var_now double, cov_lag double, var_before double"
    return rows.groupBy("user_id").applyInPandasWithState(run, out, "n long, before double, mean array<double>, cov array<double>", "update", GroupStateTimeout.NoTimeout)


def rebaselined(stream: DataFrame, size: int = 10, bound: float = 0.5) -> DataFrame:
    """user_id, block, mean, rebased: means of blocks of ``size`` samples; one that lies over ``bound`` of the baseline away becomes the baseline."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, block, base = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, None)
        found = []
        for v in _in_order(batches)["value"]:
            rest.append(float(v))
            if len(rest) == size:
                m, rest = float(np.mean(rest)), []
                away = base is None or abs(m - base) > bound * abs(base)
                base = m if away else base
                found.append((key[0], block, m, away))
                block += 1
        state.update((rest, block, base))
        yield pd.DataFrame(found, columns=["user_id", "block", "mean", "rebased"]).astype({"user_id": "int64", "block": "int64", "mean": float, "rebased": bool})

    rows = stream.select("user_id", "ts", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, block long, mean double, rebased boolean", "rest array<double>, block long, base double", "append", GroupStateTimeout.NoTimeout)


def onboarded(stream: DataFrame, windows: int = 3, size: int = 8, most: float = 250.0) -> DataFrame:
    """user_id, window, accepted, ready: windows of ``size`` samples; one with a value above ``most`` is collected again, until enough are accepted."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, window, good = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
        found = []
        for v in _in_order(batches)["value"]:
            if good >= windows:
                break
            rest.append(float(v))
            if len(rest) == size:
                ok, rest = max(rest) <= most, []
                good += ok
                found.append((key[0], window, ok, good >= windows))
                window += 1
        state.update((rest, window, good))
        yield pd.DataFrame(found, columns=["user_id", "window", "accepted", "ready"]).astype({"user_id": "int64", "window": "int64", "accepted": bool, "ready": bool})

    rows = stream.select("user_id", "ts", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, window long, accepted boolean, ready boolean", "rest array<double>, window long, good long", "append", GroupStateTimeout.NoTimeout)


def against_baseline(stream: DataFrame, baselines: DataFrame) -> DataFrame:
    """Events with how far they lie from their recording's stored baseline (user_id, baseline); a stream-static join."""
    return stream.join(baselines, "user_id").select("user_id", "event_id", (F.col("value") - F.col("baseline")).alias("away"))


EPOCHS = "vec_id long, embedding array<float>, label int"
#: Milliseconds of sixteen samples at 250 Hz.
EPOCH_MS = 64


def epoch_stream(spark: SparkSession, folder: str, files: str = "embeddings*.parquet", per_batch: int = 1) -> DataFrame:
    """key (label), ts, nth, x of stored epochs as a stream: a label's epochs follow one another as chunks, each at the time of its number."""
    rows = spark.readStream.schema(EPOCHS).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return rows.select(F.col("label").cast("long").alias("key"), F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("vec_id") * EPOCH_MS).alias("ts"), F.col("vec_id").alias("nth"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def frame_stream(spark: SparkSession, folder: str, files: str = "*.parquet", per_batch: int = 1) -> DataFrame:
    """key, ts, nth, x of a folder of files with user_id, ts, event_id and binary frames; frames of another length are dropped."""
    rows = spark.readStream.schema("user_id long, ts timestamp, event_id long, frame binary").option("pathGlobFilter", files).option("maxFilesPerTrigger", per_batch).parquet(folder)
    channels = F.array(*[F.col(f"ch{k}").cast("double") for k in range(1, 5)])
    return decode_frames(rows, "frame").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("nth"), channels.alias("x"))
