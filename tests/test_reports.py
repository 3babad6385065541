"""The session report's parts against plain NumPy."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.operators import stats
from wavequarry.plans import report_queries as R

RNG = np.random.default_rng(21)


def plain_u(a, b):
    """U and its normal score with tie correction, by all pairs."""
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    both = np.concatenate([a, b])
    n, ties = len(both), np.unique(both, return_counts=True)[1]
    spread = math.sqrt(len(a) * len(b) / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
    return u, (u - len(a) * len(b) / 2) / spread if spread else None


def test_rank_tests_by_key(spark):
    rows = [(k, float(v), bool(up)) for k, n in ((1, 40), (2, 9), (3, 5)) for v, up in zip(RNG.integers(0, 12, n), RNG.integers(0, 2, n))] + [(4, 1.0, True), (4, 1.0, False), (5, 2.0, True)]
    df = spark.createDataFrame(rows, "k long, v double, up boolean").repartition(4)
    got = {r.k: r for r in stats.mann_whitney_by(df, "k", "v", F.col("up")).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for k, r in got.items():
        a, b = (np.array([v for g, v, up in rows if g == k and up is side]) for side in (True, False))
        assert (r.n_a, r.n_b) == (len(a), len(b))
        if len(a) and len(b):
            u, z = plain_u(a, b)
            assert r.u == u and (r.z is None) == (z is None) and (z is None or np.isclose(r.z, z))
        else:
            assert r.z is None
    whole = stats.mann_whitney(df.where("k = 1"), "v", F.col("up")).first()
    assert np.isclose(whole.z, got[1].z)


def test_resamples_by_key(spark):
    data = {1: RNG.normal(size=30), 2: RNG.normal(size=7)}
    df = spark.createDataFrame([(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)] + [(None, 0, 1.0)], "k long, t long, v double")
    got = {(r.k, r.b): r.m for r in stats.bootstrap_by(df, "k", "t", ["v"], 10, {"m": F.avg("v")}).collect()}
    assert len(got) == 20
    for k, x in data.items():
        for b in range(10):
            draws = [int(md5(f"{b // 4}-{i}".encode()).hexdigest()[8 * (b % 4) : 8 * (b % 4) + 8], 16) * len(x) >> 32 for i in range(len(x))]
            assert np.isclose(got[k, b], x[draws].mean())


def test_spectra_and_their_figures(spark):
    t = np.arange(64) / 64
    x = {1: np.sin(2 * np.pi * 10 * t)[None, :, None] + 0.1 * RNG.normal(size=(6, 64, 4)), 2: RNG.normal(size=(5, 64, 4)).cumsum(1)}
    df = spark.createDataFrame([(k, e.ravel().tolist()) for k, es in x.items() for e in es], "label long, x array<double>")
    spectrum = R.spectra(df)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    figures = {r.label: r for r in R.spectral_figures(spectrum).collect()}
    for r in spectrum.collect():
        e = x[r.label] - x[r.label].mean(1, keepdims=True)
        p = (np.abs(np.fft.rfft(e * window[:, None], axis=1)) ** 2).mean((0, 2)) / (64 * (window**2).sum())
        p[1:-1] *= 2
        assert r.n == len(e) and np.allclose(r.power, p)
        f, got = np.arange(33.0), figures[r.label]
        fit = (f >= 4) & (f <= 31)
        slope, base = np.polyfit(np.log10(f[fit]), np.log10(p[fit]), 1)
        rest = np.log10(p[fit]) - base - slope * np.log10(f[fit])
        around = p[((f >= 4) & (f < 8)) | ((f > 13) & (f <= 20))].mean()
        top = 8 + p[8:14].argmax()
        want = [slope, 1 - (rest**2).mean() / np.log10(p[fit]).var(), top, p[top] / around, p[(f >= 13) & (f < 30)].sum() / p[(f >= 4) & (f < 13)].sum()]
        assert np.allclose([got.slope, got.r2, got.peak_hz, got.prominence, got.nasa], want)
    assert figures[1].peak_hz == 10 and figures[2].slope < -1


def test_the_report_holds_its_figures(spark, sf_dir):
    rows = {r.label: r for r in catalog.queries()["session_report"](spark, sf_dir).collect()}
    windows = catalog.queries()["stream_live_scores"](spark, sf_dir).toPandas()
    assert set(rows) == set(windows.label)
    tested = 0
    for label, own in windows.groupby("label"):
        r, scored = rows[label], own[own.phase == "inference"].sort_values("window")
        ei, d = scored.engagement.to_numpy(), scored.to_reference.to_numpy()
        z = (ei - ei.mean()) / ei.std()
        assert r.windows == len(ei) and np.isclose(r.quality, (own.phase != "gated").mean())
        assert np.allclose([r.ei_mean, r.ei_min, r.ei_max, r.d_mean, r.high_share, r.low_share], [ei.mean(), ei.min(), ei.max(), d.mean(), (z > 0.8).mean(), (z < -0.6).mean()])
        assert np.allclose([r.d_p5, r.d_median, r.d_p95], np.percentile(d, [5, 50, 95])) and r.ei_lo <= r.ei_mean <= r.ei_hi and r.d_lo <= r.d_mean <= r.d_hi
        a, b = ei[z > 0.5], ei[z < -0.3]
        if len(a) > 2 and len(b) > 2:
            u, score = plain_u(a, b)
            assert r.u == u and np.isclose(r.p, 0.5 * math.erfc(score / 2**0.5)) and np.isclose(r.effect, (a.mean() - b.mean()) / np.sqrt((a.var() + b.var()) / 2))
            tested += 1
        gates = sum(lo <= getattr(r, k) <= hi for k, (lo, hi) in R.GATES.items())
        assert r.gates == gates and r.report.endswith(f"gates passed: {gates} of 5") and len(r.report.split("\n")) == 7
    assert tested


def test_distances_between_a_sessions_states(spark):
    a = [np.diag([1.0, 1, 1, 1]), np.diag([np.e, 1, 1, 1]), np.diag([1.0, np.e**2, 1, 1])]
    rows = [(label, k, (m * (label + 1)).ravel().tolist()) for label in (0, 1) for k, m in enumerate(a) for _ in range(3)] + [(2, 0, a[0].ravel().tolist())]
    got = {r.label: r for r in R.state_geometry(spark.createDataFrame(rows, "label long, state long, c array<double>")).collect()}
    for label in (0, 1):
        assert np.allclose([got[label].rest_cog, got[label].rest_motor, got[label].cog_motor], [1.0, 2.0, 5**0.5])
    assert got[2].rest_cog is None or pd.isna(got[2].rest_cog)
