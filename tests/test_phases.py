"""Live scoring against plain loops over all rows: many batches, late rows, silence and restarts."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.functions import dsp
from wavequarry.plans import stream_queries
from wavequarry.streaming import phases

START = 1_000_000
HOW = phases.Scoring(window=6, advance=4, calibration_ms=2_000, idle_ms=60_000, recent=3, most=4.0, weights=tuple(np.linspace(-5, 5, 10)), reference=tuple(2 * np.eye(4).ravel()))


def of_eigen(m, f):
    v, w = np.linalg.eigh(m)
    return w @ np.diag(f(v)) @ w.T


def distance(a, b):
    return np.sqrt((np.log(np.linalg.eigvals(np.linalg.solve(a, b)).real) ** 2).sum())


def towards(a, b, t):
    r, w = of_eigen(a, np.sqrt), of_eigen(a, lambda v: v**-0.5)
    return r @ of_eigen(w @ b @ w, lambda v: v**t) @ r


def loop(samples, how):
    """(window, ms, phase, numbers) of one recording's (ms, four values), a sample at a time."""
    out, buffer, kept, n, ref, run, z = [], [], [], 0, np.array(how.reference).reshape(4, 4), None, None
    if how.band:
        b, a = map(np.array, how.band)
        z = [list(dsp.steady_state(b, a)) + [0.0] for _ in range(4)]
    for ms, x in samples:
        x = list(x)
        if how.band:
            for c in range(4):
                y = b[0] * x[c] + z[c][0]
                z[c] = [z[c][k + 1] + b[k + 1] * x[c] - a[k + 1] * y for k in range(len(b) - 1)] + [0.0]
                x[c] = y
        buffer.append(np.clip(x, -how.clip, how.clip))
        if len(buffer) == how.window:
            w, buffer, n = np.array(buffer), buffer[how.advance :], n + 1
            if np.abs(w).max() > how.most:
                out.append((n, ms, "gated"))
                continue
            c = np.cov(w.T)
            c = (1 - how.shrink) * c + (how.shrink * np.trace(c) / 4 + how.ridge) * np.eye(4)
            if ms - samples[0][0] < how.calibration_ms:
                kept.append(c)
                out.append((n, ms, "calibration"))
                continue
            if run is None:
                for k in kept[-how.recent :]:
                    ref = towards(ref, k, how.rate)
                run = ref
            run = towards(run, c, how.running_rate)
            far, near = distance(ref, c), distance(run, c)
            r, i = of_eigen(ref, np.sqrt), of_eigen(ref, lambda v: v**-0.5)
            s = r @ of_eigen(i @ c @ i, np.log) @ r
            v = [s[p, q] * (1 if p == q else 2**0.5) for p in range(4) for q in range(p, 4)]
            out.append((n, ms, "inference", far, near, np.clip(2 * (far - near), -3, 3), np.clip(np.dot(v, how.weights) + how.intercept, 0, 100)))
    return out


def same(got, want, atol=1e-6):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        if len(w) > 3:
            assert np.allclose(g[3:], w[3:], atol=atol)


def told(rows, key):
    found = {}
    for r in rows.withColumn("ms", F.unix_millis("at")).collect():
        found.setdefault(r[key], []).append((r.window, r.ms, r.phase, r.to_reference, r.to_running, r.engagement, r.score))
    return {k: sorted(v, key=lambda r: (r[1], r[0])) for k, v in found.items()}


def test_epochs_over_ten_batches(spark, sf_dir, tmp_path):
    frame = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id")
    for k, part in enumerate(np.array_split(np.arange(len(frame)), 10)):
        path = f"{tmp_path}/embeddings-{k}.parquet"
        frame.iloc[part].to_parquet(path)
        os.utime(path, (1.7e9 + k, 1.7e9 + k))
    how = stream_queries.EPOCH_SCORING
    many, one = (told(catalog.queries()["stream_live_scores"](spark, d), "label") for d in (str(tmp_path), sf_dir))
    assert {p[2] for v in many.values() for p in v} == {"calibration", "gated", "inference"}
    for label, rows in frame.groupby("label"):
        samples = [(1_704_067_200_000 + int(i) * 64, s) for i, e in zip(rows.vec_id, rows.embedding) for s in np.array(e, float).reshape(16, 4)]
        want = loop(samples, how)
        same(many[label], want)
        same(one[label], want)


def test_frames_are_filtered_and_scored(spark, sf_dir):
    got = told(catalog.queries()["stream_frame_scores"](spark, sf_dir), "user_id")
    rows = stream_queries.frames_of_events(spark, sf_dir).where(F.octet_length("frame") == 14).withColumn("ms", F.unix_millis("ts")).toPandas().sort_values(["ms", "event_id"])
    assert 0 < len(rows) < spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for user, own in rows.groupby("user_id"):
        samples = [(int(ms), np.frombuffer(bytes(f)[1:9], "<i2").astype(float)) for ms, f in zip(own.ms, own.frame)]
        same(got.get(user, []), loop(samples, stream_queries.FRAME_SCORING), 1e-4)


@pytest.fixture()
def feed(spark, tmp_path):
    """Write batches of (key, ms, nth) with random chunks as files, and read them as a stream."""
    rng, made = np.random.default_rng(1), {}

    def write(k, rows, folder="in"):
        rows = [(key, START + ms, nth) for key, ms, nth in rows]
        os.makedirs(tmp_path / folder, exist_ok=True)
        for key, ms, nth in rows:
            made[key, ms, nth] = rng.normal(size=(3, 4))
        frame = pd.DataFrame([(key, ms, nth, made[key, ms, nth].ravel().tolist()) for key, ms, nth in rows], columns=["key", "ms", "nth", "x"])
        path = f"{tmp_path}/{folder}/{k:03d}.parquet"
        frame.to_parquet(path)
        os.utime(path, (1.7e9 + k, 1.7e9 + k))

    def run(checkpoint="ck", out="out", how=HOW):
        rows = spark.readStream.schema("key long, ms long, nth long, x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_millis("ms"))
        with phases.rocks(spark):
            q = phases.scored(rows, how, "5 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/{out}").option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start()
            q.awaitTermination()
        return told(spark.read.parquet(f"{tmp_path}/{out}"), "key")

    plain = lambda key, keep=lambda ms: True: [(ms, s) for (k, ms, nth), x in sorted(made.items()) if k == key and keep(ms) for s in x]
    return write, run, plain


def test_a_restart_goes_on_where_it_stopped(feed):
    write, run, plain = feed
    for k in range(3):
        write(k, [(key, 1000 * k + 100 * j, j) for j in range(9) for key in (1, 2)])
    run()
    for k in range(3, 6):
        write(k, [(key, 1000 * k + 100 * j, j) for j in range(9) for key in (1, 2)])
    got = run()
    for key in (1, 2):
        same(got[key], loop(plain(key), HOW))


def test_late_rows_are_dropped_and_unordered_ones_put_in_order(feed):
    write, run, plain = feed
    write(0, [(1, 100 * j, 0) for j in (3, 1, 0, 2, 4)])
    write(1, [(1, 20_000 + 100 * j, 0) for j in (2, 0, 1)])
    write(2, [(1, 21_000, 0), (1, 500, 0)])  # half a second after the start, but twenty seconds late
    write(3, [(1, 22_000, 0)])
    same(run()[1], loop(plain(1, lambda ms: ms != START + 500), HOW))


def test_a_silent_recording_is_told_and_calibrated_again(feed):
    write, run, plain = feed
    write(0, [(1, 500 * j, 0) for j in range(8)] + [(2, 500 * j, 0) for j in range(8)])
    for k in range(1, 5):
        write(k, [(2, 30_000 * k, 0)])
    write(5, [(1, 150_000 + 500 * j, 0) for j in range(8)] + [(2, 150_000, 0)])
    got = run()
    first, second = loop(plain(1, lambda ms: ms < START + 100_000), HOW), loop(plain(1, lambda ms: ms > START + 100_000), HOW)
    assert [r[2] for r in second][:2] == ["calibration"] * 2
    same([r for r in got[1] if r[2] != "silent"], first + second)
    assert [(r[0], r[1]) for r in got[1] if r[2] == "silent"] == [(first[-1][0], START + 3_500 + 60_000)] and not any(r[2] == "silent" for r in got[2])
