"""Known answers for the numerical helpers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.functions import dsp
from wavequarry.functions import linalg as L
from wavequarry.operators import filters, joins, manifold, models, ordered, separation, windowing
from wavequarry.plans import model_queries
from wavequarry.sources.tables import epoch_arrays, samples

RNG = np.random.default_rng(5)


def spd(n=1):
    a = RNG.normal(size=(n, 4, 4))
    return a @ np.swapaxes(a, 1, 2) + 4 * np.eye(4)


def test_log_and_exp_are_inverse():
    m = spd(5)
    assert np.allclose(L.exp(L.log(m)), m)
    assert np.allclose(L.root(m) @ L.root(m), m)
    assert np.allclose(L.from_upper(L.upper(m)), m)


def test_distance_is_affine_invariant_and_halved_by_the_midpoint():
    a, b, w = spd()[0], spd()[0], RNG.normal(size=(4, 4))
    d = L.distance(a, b)
    assert np.isclose(d, L.distance(w @ a @ w.T, w @ b @ w.T))
    assert np.isclose(L.distance(a, L.along(a, b, 0.5)), d / 2)
    assert np.isclose(np.linalg.norm(L.tangent(b, a)), d)


def test_geometric_mean_of_equal_matrices_is_that_matrix(spark):
    m = spd()[0]
    df = spark.createDataFrame([(1, m.ravel().tolist())] * 10, "k long, c array<double>")
    found, rounds, done = manifold.geometric_means(df, "k", "c")[1]
    assert done and np.allclose(found, m)


def test_a_geometric_mean_that_does_not_settle_is_an_error(spark):
    rows = spark.createDataFrame([(1, m.ravel().tolist()) for m in spd(9)], "k long, c array<double>")
    with pytest.raises(RuntimeError, match="1 means have not converged in 1 rounds"):
        manifold.settled_means(rows, "k", "c", most_rounds=1)
    assert np.allclose(manifold.settled_means(rows, "k", "c")[1], manifold.geometric_means(rows, "k", "c")[1][0])


def test_geometric_mean_balances_tangents_and_has_the_mean_logdet(spark):
    ms = spd(12)
    df = spark.createDataFrame([(k % 2, m.ravel().tolist()) for k, m in enumerate(ms)], "k long, c array<double>")
    for k, (mean, _, done) in manifold.geometric_means(df, "k", "c").items():
        own = ms[k::2]
        assert done and np.linalg.norm(L.tangent(own, mean).mean(0)) < 1e-7
        assert np.isclose(np.linalg.slogdet(mean)[1], np.linalg.slogdet(own)[1].mean())


def test_transport_moves_means_together(spark, sf_dir):
    rows = epoch_arrays(spark, sf_dir).where("vec_id < 100").withColumn("c", manifold.epoch_covariance("x")).select("vec_id", "label", "c")
    means = {k: m for k, (m, _, _) in manifold.geometric_means(rows, "label", "c").items()}
    target = manifold.arithmetic_means(rows.withColumn("one", F.lit(1)), "one", "c")[1]
    for m, _, _ in manifold.geometric_means(manifold.transport(rows, "label", "c", means, target), "label", "c").values():
        assert np.allclose(m, target, rtol=1e-5)


@pytest.mark.parametrize("stop", [False, True])
def test_butterworth_gain(stop):
    b, a = dsp.butterworth(8.0, 12.0, 128.0, 4, stop)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 128)) / np.polyval(a, np.exp(2j * np.pi * f / 128)))
    inside, outside = (0.0, 1.0) if stop else (1.0, 0.0)
    assert abs(gain(9.8) - inside) < 1e-3 and abs(gain(1.0) - outside) < 1e-2 and abs(gain(50.0) - outside) < 1e-2
    assert abs(gain(8.0) - 0.5**0.5) < 1e-6 and abs(gain(12.0) - 0.5**0.5) < 1e-6


def test_filter_state_goes_on():
    b, a = dsp.butterworth(1.0, 20.0, 64.0)
    x = RNG.normal(size=200)
    whole, _ = dsp.run_filter(b, a, x)
    first, state = dsp.run_filter(b, a, x[:77])
    assert np.allclose(whole, np.concatenate([first, dsp.run_filter(b, a, x[77:], state)[0]]))
    direct = np.zeros(200)
    for t in range(200):
        direct[t] = sum(b[k] * x[t - k] for k in range(len(b)) if t >= k) - sum(a[k] * direct[t - k] for k in range(1, len(a)) if t >= k)
    assert np.allclose(whole, direct)


def test_zero_phase_keeps_a_sine_in_place():
    t = np.arange(512) / 64
    x = np.sin(2 * np.pi * 6 * t)
    y = dsp.zero_phase(*dsp.butterworth(2.0, 15.0, 64.0, 2), x)
    assert np.abs(y - x)[100:-100].max() < 0.02


def test_resample_and_welch():
    t = np.arange(128) / 128
    x = np.sin(2 * np.pi * 5 * t)
    assert np.allclose(dsp.resample(x, 250), np.sin(2 * np.pi * 5 * np.arange(250) / 250), atol=1e-9)
    f, p = dsp.welch(np.sin(2 * np.pi * 16 * np.arange(1024) / 128), 128, 256)
    assert f[p.argmax()] == 16 and abs((p.sum() * (f[1] - f[0])) - 0.5) < 0.01


def test_ordered_fold_carries_state_over_small_batches(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id", F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = ordered.ordered_fold(df, ["k"], ["id"], lambda: 0.0, lambda s, rows: (s + rows["v"].sum(), rows[["k", "id"]].assign(total=s + rows["v"].cumsum())), "k long, id long, total double")
        assert [r.m for r in out.groupBy("k").agg(F.max("total").alias("m")).orderBy("k").collect()] == [1667.0, 1667.0, 1666.0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_separation_finds_mixed_sources(spark):
    t = np.arange(1500) / 250
    s = np.stack([np.sin(2 * np.pi * 7 * t), np.sign(np.sin(2 * np.pi * 3 * t)), RNG.laplace(size=1500)], 1)
    x = s @ RNG.normal(size=(3, 3)).T
    df = spark.createDataFrame([(0, k, *map(float, row)) for k, row in enumerate(x)], "k long, i long, a double, b double, c double")
    for mean, w in (separation.sobi(df, ["k"], ["i"], ["a", "b", "c"], 10), separation.fast_ica(df, ["a", "b", "c"], 30)):
        r = np.abs(np.corrcoef(((x - mean) @ w.T).T, s.T)[:3, 3:])
        assert (r.max(0) > 0.95).all()
        back = separation.suppress(df, ["a", "b", "c"], mean, w, np.ones(3)).select("a", "b", "c").toPandas().to_numpy()
        assert np.allclose(np.sort(back, 0), np.sort(x, 0))


def test_net_gradient_matches_differences():
    net, x, y = models.WaveNet(), RNG.normal(size=(3, 16, 4)), RNG.normal(size=3)
    _, found = net.gradient(x, y)
    for name, value in net.parameters.items():
        for at in [(0,) * value.ndim, tuple(n - 1 for n in value.shape)]:
            keep, sides = value[at], []
            for h in (1e-5, -1e-5):
                value[at] = keep + h
                sides.append(net.gradient(x, y)[0])
            value[at] = keep
            assert abs((sides[0] - sides[1]) / 2e-5 - found[name][at]) < 1e-3


def test_left_out_ridge_is_the_fit_on_the_others(spark):
    x = RNG.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + RNG.normal(scale=0.1, size=60)
    df = spark.createDataFrame([(k % 4, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y))], "g long, v array<double>, y double")
    got = models.leave_out_ridge(df, "v", "y", "g", 3, 0.0).toPandas()
    for g in range(4):
        other = np.arange(60) % 4 != g
        w = np.linalg.lstsq(np.column_stack([np.ones(other.sum()), x[other]]), y[other], rcond=None)[0]
        assert np.allclose(np.sort(got[got.g == g].predicted), np.sort(np.column_stack([np.ones((~other).sum()), x[~other]]) @ w))


def test_stream_filter_equals_batch(spark, sf_dir):
    from wavequarry.plans import stream_queries

    live = stream_queries.stream_filter(spark, sf_dir)
    batch = model_queries.causal_iir(spark, sf_dir).join(samples(spark, sf_dir).select("user_id", "idx", "event_id"), ["user_id", "idx"])
    both = live.withColumnRenamed("filtered", "live").join(batch, ["user_id", "event_id"])
    assert both.count() == samples(spark, sf_dir).count() and both.where("abs(live - filtered) > 1e-3").count() == 0


def test_interval_slice_equals_plain_range_join(spark):
    s = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("idx"))
    iv = spark.createDataFrame([(1, 3, 17), (1, 50, 51), (1, 90, 140), (2, 0, 9)], "k int, a long, b long")
    got = joins.interval_slice(s, iv, ["k"], "idx", "a", "b", 7).count()
    assert got == 14 + 1 + 10


def test_windows_end_before_the_last_sample(spark):
    df = spark.range(16).select(F.lit(1).alias("k"), "id")
    assert windowing.sliding_windows(df, ["k"], "id", 8, 4).select("win").distinct().count() == 2  # starts 0 and 4; 8 would end at the last sample
    assert filters.causal(df.withColumn("v", F.lit(0.0)), ["k"], ["id"], "v", np.array([1.0]), np.array([1.0, 0.0])).count() == 16


def test_running_moments_carry_over_batches(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    rows = [(key, i, float(a), float(b)) for key in (None, 1) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "key long, i long, a double, b double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = filters.running_moments(df, ["key"], ["i"], ["a", "b"]).where("i = 499").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mean, cov = x[0], 0.1 * np.eye(2)
    for row in x[1:]:
        cov = 0.9 * cov + 0.1 * np.outer(row - mean, row - mean) + 1e-6 * np.eye(2)
        mean = 0.9 * mean + 0.1 * row
    assert sorted(r["key"] is None for r in found) == [False, True]
    for r in found:
        np.testing.assert_allclose(r["mean"], mean)
        np.testing.assert_allclose(r["cov"], cov.ravel())
