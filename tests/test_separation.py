"""Fits per recording against plain NumPy, blocks against whole recordings, and the live overlap-add against a loop over windows."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.functions import dsp
from wavequarry.operators import blocks, separation
from wavequarry.operators import keyed_separation as K
from wavequarry.plans import separation_queries as Q
from wavequarry.streaming import overlap

CHAIN = [dsp.notch(16.0, 64.0), dsp.butterworth(1.0, 20.0, 64.0)]


def whitener(x):
    v, w = np.linalg.eigh(np.cov(x.T, bias=True))
    return (w / np.sqrt(v)).T


def plain_ica(x, rounds=200):
    mean, white = x.mean(0), whitener(x)
    z = (x - mean) @ white.T
    orthogonal = lambda m: (lambda u, _, vt: u @ vt)(*np.linalg.svd(m))
    w = orthogonal(np.random.default_rng(42).normal(size=(4, 4)))
    for n in range(1, rounds + 1):
        g = np.tanh(z @ w.T)
        new = orthogonal(np.array([(g[:, k : k + 1] * z).mean(0) - (1 - g[:, k] ** 2).mean() * w[k] for k in range(4)]))
        change, w = abs(abs((new * w).sum(1)) - 1).max(), new
        if change < 1e-4:
            break
    return mean, w @ white, change < 1e-4, n


def plain_sobi(x, lags=20):
    mean, white = x.mean(0), whitener(x)
    z = (x - mean) @ white.T
    lagged = [z[k:].T @ z[:-k] / (len(z) - k) for k in range(1, lags + 1)]
    return mean, separation.joint_diagonalizer([(m + m.T) / 2 for m in lagged]).T @ white


def removed(x, mean, w, factor):
    s = (x - mean) @ w.T
    s[:, np.abs(s).max(0).argmax()] *= factor
    return s @ np.linalg.inv(w).T + mean


def snr(clean, test):
    return 10 * np.log10((clean**2).sum() / ((test - clean) ** 2).sum())


@pytest.fixture(scope="module")
def recordings(sf_dir):
    """label -> epochs' numbers, clean, noisy, and both filtered, a label at a time."""
    frame, found = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id"), {}
    for label, rows in frame.groupby("label"):
        clean = np.concatenate([np.array(e, float).reshape(16, 4) for e in rows.embedding])
        place = (rows.vec_id.to_numpy()[:, None] * 16 + np.arange(16)).ravel()
        phase = place % 160
        draws = np.array([int(md5(str(p).encode()).hexdigest()[:8], 16) for p in place]) / 2**32
        noise = np.where(phase < 32, 3.0 * (0.5 - 0.5 * np.cos(2 * np.pi * phase / 31)), 0) + 0.8 * np.where((phase >= 96) & (phase <= 127), 1.2 * 12**0.5 * (draws - 0.5), 0)
        noisy = clean + noise[:, None] * [1, 1, 0, 0]
        through = lambda x: dsp.zero_phase(*CHAIN[1], dsp.zero_phase(*CHAIN[0], x))
        found[label] = rows.vec_id.to_numpy(), clean, noisy, through(noisy), through(clean)
    return found


def test_every_recording_has_its_own_fit_and_two_references(spark, sf_dir, recordings):
    got = {(r.label, r.method): r for r in catalog.queries()["separation_by_recording"](spark, sf_dir).collect()}
    assert len(got) == 3 * len(recordings)
    settled = 0
    for label, (_, clean, noisy, x, wanted) in recordings.items():
        for method, (kind, factor) in Q.METHODS.items():
            r = got[label, method]
            mean, w, done, n = plain_ica(x) if kind == "fastica" else (*plain_sobi(x), True, 1)
            assert (r.n, r.converged) == (len(x), done)
            assert np.allclose([r.snr_raw, r.snr_filtered], [snr(clean[:, 0], noisy[:, 0]), snr(wanted[:, 0], noisy[:, 0])], atol=1e-6)
            if done:  # others turn on and on, and rounding decides where they stop
                after = removed(x, mean, w, factor)[:, 0]
                want = [np.corrcoef(clean[:, 0], after)[0, 1], np.corrcoef(wanted[:, 0], after)[0, 1]]
                assert r.rounds == n and np.allclose([r.corr_raw, r.corr_filtered], want, atol=1e-4)
                assert r.pass_raw == (-20 <= r.snr_raw <= -15 and r.corr_raw >= 0.4) and r.pass_filtered == (-20 <= r.snr_filtered <= -15 and r.corr_filtered >= 0.4)
                settled += 1
    assert settled > len(got) / 2


def test_fits_over_blocks_equal_those_over_whole_recordings(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(4, 4))
    data = {k: np.column_stack([np.sin(np.arange(n) / 7), np.sign(np.sin(np.arange(n) / 3)), rng.laplace(size=n), np.sin(np.arange(n) / 2.3) ** 3]) @ mix for k, n in ((1, 900), (2, 130), (None, 700))}
    df = spark.createDataFrame([(k, t, row.tolist()) for k, x in data.items() for t, row in enumerate(x)], "k long, t long, x array<double>").repartition(5)
    cut = blocks.stored(blocks.blocks(df, ["k"], ["t"], "x", 64), "blocks")
    assert cut.where("not (first and last)").count() > 10
    for fit, plain in ((K.sobi_by_recording(cut, ["k"], 4), plain_sobi), (K.fast_ica_by_recording(cut, ["k"], 4), plain_ica)):
        found = {r.k: r for r in fit.collect()}
        for k, x in data.items():
            mean, w = plain(x)[:2]
            assert found[k].converged and np.allclose(found[k].mean, mean) and np.allclose(np.reshape(found[k].unmixing, (4, 4)), w, atol=1e-6)


@pytest.mark.parametrize("whole", [1 << 26, 800 * 4 * 8, 0])
def test_rounds_cost_jobs_of_long_recordings_only(spark, monkeypatch, whole):
    """Recordings that fit a task cost a few jobs whatever their rounds; beyond, a round is one job, a few recordings at a time. The fits are the same."""
    monkeypatch.setattr(K, "WHOLE", whole)
    monkeypatch.setattr(K, "HELD", 2)
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(4, 4))
    data = {k: np.column_stack([np.sin(np.arange(n) / 7), np.sign(np.sin(np.arange(n) / 3)), rng.laplace(size=n), np.sin(np.arange(n) / 2.3) ** 3]) @ mix for k, n in ((1, 900), (2, 130), (None, 700), (4, 1000), (5, 198))}
    data[6] = np.random.default_rng(12).normal(size=(800, 4))  # takes 28 rounds
    df = spark.createDataFrame([(k, t, row.tolist()) for k, x in data.items() for t, row in enumerate(x)], "k long, t long, x array<double>").repartition(5)
    cut = blocks.stored(blocks.blocks(df, ["k"], ["t"], "x", 64), "blocks")
    so_far = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = so_far()
    found = {r.k: r for r in K.fast_ica_by_recording(cut, ["k"], 4).collect()}
    jobs = so_far() - before
    assert len(found) == len(data) and found[6].rounds > 20
    assert jobs < 20 if whole == 1 << 26 else jobs > found[6 if whole == 0 else 1].rounds
    for k, x in data.items():
        mean, w, done, n = plain_ica(x)
        assert (found[k].converged, found[k].rounds) == (done, n)
        assert np.allclose(found[k].mean, mean) and (not done or np.allclose(np.reshape(found[k].unmixing, (4, 4)), w, atol=1e-5))


def test_a_recording_shorter_than_the_lags(spark):
    df = spark.createDataFrame([(1, t, [float(t % 2), float(t % 3), t * 0.5, 1.0 / (t + 1)]) for t in range(5)], "k long, t long, x array<double>")
    r = K.sobi_by_recording(blocks.blocks(df, ["k"], ["t"], "x"), ["k"], 4).first()
    assert len(r.unmixing) == 16 and np.isfinite(r.unmixing).all()
    assert K.fast_ica_by_recording(blocks.blocks(df.where("false"), ["k"], ["t"], "x"), ["k"], 4).count() == 0


def overlapped(x, remover, window, step):
    """The recording, a window at a time, as one array."""
    out = np.full(x.shape, np.nan)
    last = 0
    for start in range(0, len(x) - window, step):
        part = x[start : start + window]
        clean = (part - part.mean(0)) @ remover.T + part.mean(0)
        there = ~np.isnan(out[start : start + window, 0])
        out[start : start + window][there] = 0.5 * out[start : start + window][there] + 0.5 * clean[there]
        out[start : start + window][~there] = clean[~there]
        last = start + step
    return out[:last]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
def test_windows_blend_whatever_the_chunks(chunk):
    rng = np.random.default_rng(2)
    x, remover = rng.normal(size=(333, 3)), rng.normal(size=(3, 3))
    blend, found = overlap.Blend(40, 12, 3), []
    for at in range(0, len(x), chunk):
        found += blend.take(x[at : at + chunk], remover)
    want = overlapped(x, remover, 40, 12)
    assert [f[0] for f in found] == list(range(len(want))) and np.allclose([f[1] for f in found], want)


def test_live_and_batch_removal(spark, sf_dir, recordings):
    got = {r.label: r for r in catalog.queries()["stream_overlap_add"](spark, sf_dir).collect()}
    for label, (ids, clean, _, x, _) in recordings.items():
        early = np.repeat(ids <= ids[0] + (ids[-1] - ids[0]) * Q.CALIBRATED, 16)
        mean, w = plain_sobi(x[early])
        scale = np.ones(4)
        scale[np.abs((x[early] - mean) @ w.T).max(0).argmax()] = 0
        live = overlapped(x, np.linalg.inv(w) @ np.diag(scale) @ w, Q.WINDOW, Q.STEP)[:, 0]
        n, r = len(live), got[label]
        batch, raw = removed(x, *plain_sobi(x), 0.0)[:n, 0], clean[:n, 0]
        assert r.n == n and np.allclose([r.snr_batch, r.snr_live, r.corr_batch, r.corr_live, r.difference], [snr(raw, batch), snr(raw, live), np.corrcoef(raw, batch)[0, 1], np.corrcoef(raw, live)[0, 1], np.abs(batch - live).max()], atol=1e-4)


def test_a_live_recording_goes_on_from_batch_to_batch(spark, tmp_path):
    import os

    from wavequarry.streaming import live, phases

    rng = np.random.default_rng(3)
    x = {k: rng.normal(size=(120, 2)) for k in (1, 2)}
    for b in range(6):
        rows = [(k, b * 20 + 4 * c, x[k][b * 20 + 4 * c : b * 20 + 4 * c + 4].ravel().tolist()) for k in x for c in (3, 0, 4, 1, 2)]
        pd.DataFrame(rows, columns=["key", "nth", "x"]).to_parquet(f"{tmp_path}/{b}.parquet")
        os.utime(f"{tmp_path}/{b}.parquet", (1.7e9 + b, 1.7e9 + b))
    stream = spark.readStream.schema("key long, nth long, x array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path)).withColumn("ts", F.timestamp_millis(F.col("nth") * 10 + 10**6))
    turn = np.array([[0.0, 1.0], [1.0, 0.5]])
    fits = spark.createDataFrame([(1, turn.ravel().tolist()), (2, (2 * turn).ravel().tolist())], "k long, remover array<double>")
    with phases.rocks(spark):
        rows = live.drain(overlap.cleaned(stream, fits, "k", 30, 10, 2, 10_000, "1 second")).collect()
    for k in x:
        want = overlapped(x[k], turn * k, 30, 10)
        got = sorted((r.sample, r.clean, r.blends) for r in rows if r.k == k)
        assert [g[0] for g in got] == list(range(len(want))) and np.allclose([g[1] for g in got], want) and got[-1][2] == 3
