"""Queries that SQL cannot say, against plain NumPy over the collected rows: one matrix, one fold, one sample at a time."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.functions import dsp
from wavequarry.operators import manifold, models
from wavequarry.plans import model_queries
from wavequarry.sources.tables import samples



def plain(name):
    """The query that a test is the twin of."""
    return catalog.queries()[name]


@pytest.fixture(scope="module")
def epochs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float).reshape(-1, 16, 4)
    return np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), x, np.array([np.cov(e.T) + 1e-6 * np.eye(4) for e in x])


def power(m, p):
    v, w = np.linalg.eigh(m)
    return w @ np.diag(v**p) @ w.T


def logm(m):
    v, w = np.linalg.eigh(m)
    return w @ np.diag(np.log(v)) @ w.T


def expm(m):
    v, w = np.linalg.eigh(m)
    return w @ np.diag(np.exp(v)) @ w.T


def dist(a, b):
    return np.sqrt((np.log(np.linalg.eigvals(np.linalg.solve(a, b)).real) ** 2).sum())


def tangent(m, ref):
    w = power(ref, -0.5)
    s = logm(w @ m @ w)
    n = len(s)
    return np.array([s[i, j] * (1 if i == j else 2**0.5) for i in range(n) for j in range(i, n)])


def frechet(ms):
    m = ms.mean(0)
    for _ in range(50):
        w, r = power(m, -0.5), power(m, 0.5)
        step = np.mean([logm(w @ c @ w) for c in ms], axis=0)
        m = r @ expm(step) @ r
        if np.linalg.norm(step) < 1e-10:
            break
    return m


def ridge(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda new: y.mean() + ((new - mean) / sd) @ w


def rows(query, spark, sf_dir, key):
    return sorted(query(spark, sf_dir).collect(), key=lambda r: tuple(r[k] for k in key))


def test_distances_and_tangents(spark, sf_dir, epochs):
    ids, _, _, c = epochs
    pooled = c.mean(0)
    got = rows(plain("spd4_distance"), spark, sf_dir, ["vec_id"])
    assert np.allclose([r.d for r in got], [dist(pooled, m) for m in c], atol=2e-5)
    got = rows(plain("spd4_tangent"), spark, sf_dir, ["vec_id"])
    assert np.allclose([r.v for r in got], [tangent(m, pooled) for m in c], atol=2e-5)
    shares = np.linalg.eigvalsh(np.cov(np.array([tangent(m, pooled) for m in c]).T))[::-1]
    got = rows(plain("principal_shares"), spark, sf_dir, ["axis"])
    assert np.allclose([r.share for r in got], shares / shares.sum(), atol=2e-5)


def test_geometric_means_themselves_swelling_and_transport(spark, sf_dir, epochs):
    _, labels, _, c = epochs
    found = manifold.geometric_means(model_queries._covariances(spark, sf_dir), "label", "c")
    swell = {r.label: r for r in plain("spd4_swelling")(spark, sf_dir).collect()}
    moved = {r.label: r for r in plain("transport_align")(spark, sf_dir).collect()}
    pooled = c.mean(0)
    for k in np.unique(labels):
        own = c[labels == k]
        g, a = frechet(own), own.mean(0)
        assert np.allclose(found[k][0], g, rtol=1e-5, atol=1e-9) and found[k][2]
        assert np.isclose(swell[k].det_ratio, np.linalg.det(a) / np.linalg.det(g), rtol=1e-5) and swell[k].converged
        assert np.isclose(swell[k].eigen_ratio, np.linalg.eigvalsh(a)[-1] / np.linalg.eigvalsh(g)[-1], rtol=1e-5) and np.isclose(swell[k].distance, dist(a, g), atol=1e-5)
        e = power(pooled, 0.5) @ power(g, -0.5)
        assert np.isclose(moved[k].before, np.mean([dist(m, pooled) for m in own]), atol=2e-5)
        assert np.isclose(moved[k].after, np.mean([dist(e @ m @ e.T, pooled) for m in own]), atol=2e-5)


@pytest.mark.parametrize(("name", "rate", "adaptive"), [("geodesic_ema", 0.05, None), ("adaptive_mean", 0.02, 2.0)])
def test_running_means(spark, sf_dir, epochs, name, rate, adaptive):
    ids, labels, _, c = epochs
    got = {r.vec_id: r for r in plain(name)(spark, sf_dir).collect()}
    for k in np.unique(labels):
        m = None
        for i in np.flatnonzero(labels == k):
            m = c[i] if m is None else m
            d = dist(m, c[i]) if not np.allclose(m, c[i]) else 0.0
            step = rate if adaptive is None else min(0.15, max(rate, rate * (1 + 5 * d / adaptive)))
            w, r = power(m, -0.5), power(m, 0.5)
            m = r @ power(w @ c[i] @ w, step) @ r
            assert np.isclose(got[ids[i]].distance, d, atol=1e-5) and np.isclose(got[ids[i]].logdet, np.linalg.slogdet(m)[1], atol=1e-6)


CHAINS = {
    "filtfilt_bandpass": [dsp.notch(16.0, 64.0), dsp.butterworth(1.0, 20.0, 64.0, order=2)],
    "cleaning_chain": [dsp.notch(50.0, 250.0), dsp.notch(60.0, 250.0), dsp.butterworth(1.0, 30.0, 250.0)],
    "wearable_chain": [dsp.butterworth(49.0, 51.0, 110.0, 2, stop=True), dsp.butterworth(1.0, 30.0, 110.0)],
}


@pytest.mark.parametrize("name", CHAINS)
def test_zero_phase_filters(spark, sf_dir, name):
    got = plain(name)(spark, sf_dir).toPandas()
    raw = samples(spark, sf_dir).select("user_id", "idx", "value").toPandas()
    stages = CHAINS[name]

    def once(b, a, x, z):
        out = []
        for v in x:
            y = b[0] * v + z[0]
            z = [b[k] * v - a[k] * y + (z[k] if k < len(z) else 0.0) for k in range(1, len(b))]
            out.append(y)
        return np.array(out)

    for user in got.user_id.unique()[:5]:
        x = raw[raw.user_id == user].sort_values("idx").value.to_numpy()
        for b, a in stages:
            edge = min(3 * len(b), len(x) - 1)
            wide = np.concatenate([2 * x[0] - x[1 : edge + 1][::-1], x, 2 * x[-1] - x[-edge - 1 : -1][::-1]])
            n = len(b) - 1
            steady = np.linalg.solve(np.eye(n) - np.array([[-a[i + 1] * (j == 0) + (j == i + 1) for j in range(n)] for i in range(n)]), [b[i + 1] - a[i + 1] * b[0] for i in range(n)])
            for _ in range(2):
                wide = once(b, a, wide, list(steady * wide[0]))[::-1]
            x = wide[edge : len(wide) - edge]
        assert np.allclose(got[got.user_id == user].sort_values("idx").filtered, x, atol=2e-4)


def left_out_predictions(epochs, at, alpha, y, groups):
    _, _, _, c = epochs
    out = np.zeros(len(c))
    for g in np.unique(groups):
        train = groups != g
        ref = c[train].mean(0)
        x = np.array([at(m, ref) for m in c])
        out[~train] = ridge(x[train], y[train], alpha)(x[~train])
    return out


def test_left_out_models_see_nothing_of_their_group(spark, sf_dir, epochs):
    ids, labels, x, c = epochs
    y = (ids % 2).astype(float)
    want = left_out_predictions(epochs, tangent, 1.0, y, labels)
    got = rows(plain("loso_ridge"), spark, sf_dir, ["label"])
    assert np.allclose([r.accuracy for r in got], [np.mean((want[labels == r.label] >= 0.5) == (y[labels == r.label] >= 0.5)) for r in got], atol=1e-4)
    scored = left_out_predictions(epochs, tangent, 10.0, y * 100, labels)
    got = rows(plain("focus_score"), spark, sf_dir, ["vec_id"])
    assert np.allclose([r.score for r in got], np.clip(scored, 0, 100), atol=2e-3)
    folds = {r.vec_id: r.f for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(5)).alias("f")).collect()}
    fold, target = np.array([folds[i] for i in ids]), (x[:, :, 0] ** 2).sum(1)
    e = left_out_predictions(epochs, tangent, 1.0, target, fold) - target
    assert np.isclose(plain("kfold_r2")(spark, sf_dir).first().r2, 1 - (e**2).sum() / ((target - target.mean()) ** 2).sum(), atol=1e-4)
    logs, upper = (lambda m, _: np.log(np.diag(m))), (lambda m, _: m[np.triu_indices(4)])
    got = {(r.features, r.labels): r.accuracy for r in plain("tournament")(spark, sf_dir).collect()}
    for name, at in (("tangent", tangent), ("log_variance", logs), ("raw", upper)):
        assert np.isclose(got[name, "true"], np.mean((left_out_predictions(epochs, at, 1.0, y, labels) >= 0.5) == (y >= 0.5)), atol=1e-4)
    p = np.array([r.p for r in rows(plain("calibrated_probability"), spark, sf_dir, ["vec_id"])])
    for half in (labels % 2 == 1, labels % 2 == 0):
        own, other = want[half], want[~half]
        up, down = (y[~half] > 0.5).sum(), (y[~half] <= 0.5).sum()
        goal = np.where(y[~half] > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
        a = np.column_stack([other, np.ones(len(other))])
        w = np.zeros(2)
        for _ in range(50):
            q = 1 / (1 + np.exp(-a @ w))
            w += np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + 1e-9 * np.eye(2), a.T @ (goal - q))
        assert np.allclose(p[half], 1 / (1 + np.exp(-(w[0] * own + w[1]))), atol=1e-4)


def test_changing_a_held_out_group_leaves_its_model_alone(spark, sf_dir):
    table = model_queries._targets(spark, sf_dir)
    changed = table.withColumn("y", F.when(F.col("label") == 3, 1 - F.col("y")).otherwise(F.col("y"))).withColumn("c", F.when(F.col("label") == 3, F.transform("c", lambda v: v * 7)).otherwise(F.col("c")))
    fitted = []
    for df in (table, changed):
        references = manifold.references_without(df, "label", "c")
        grams = models.fold_grams(df.withColumn("_part", F.lit(0)), "c", manifold.tangents, {3: references[3]}, "y", "label", 10)
        fitted.append(models.solve_ridge(grams[3][0], 1.0))
    assert np.allclose(fitted[0], fitted[1])


def test_nested_search(spark, sf_dir, epochs):
    ids, labels, _, c = epochs
    y, part, alphas = (ids % 2).astype(float), labels % 3, np.logspace(-3, 5, 9)
    got = {r.label: r for r in plain("nested_ridge")(spark, sf_dir).collect()}
    upper = np.triu_indices(4)
    for g in np.unique(labels):
        train, best = labels != g, None
        ref = c[train].mean(0)
        for name, x in (("tangent", np.array([tangent(m, ref) for m in c])), ("raw", np.array([m[upper] for m in c]))):
            for alpha in alphas:
                error = sum(((ridge(x[train & (part != k)], y[train & (part != k)], alpha)(x[train & (part == k)]) - y[train & (part == k)]) ** 2).sum() for k in np.unique(part[train])) / train.sum()
                if best is None or error < best[0] - 1e-12:
                    best = (error, name, alpha, ((ridge(x[train], y[train], alpha)(x[~train]) - y[~train]) ** 2).mean())
        assert (got[g].features, got[g].alpha) == (best[1], pytest.approx(best[2])) and np.isclose(got[g].inner_mse, best[0], atol=1e-5) and np.isclose(got[g].outer_mse, best[3], atol=1e-5)


def test_ridge_path(spark, sf_dir, epochs):
    ids, labels, _, c = epochs
    x, y = np.array([tangent(m, c.mean(0)) for m in c]), (ids % 2).astype(float)
    for r in plain("ridge_path")(spark, sf_dir).collect():
        errors = [((ridge(x[labels != g], y[labels != g], r.alpha)(x[labels == g]) - y[labels == g]) ** 2).sum() for g in np.unique(labels)]
        assert np.isclose(r.mse, sum(errors) / len(y), atol=1e-5)


def test_fused_and_whitened_vectors(spark, sf_dir, epochs):
    ids, labels, _, c = epochs
    sides = [[0, 1, 2, 3], [0, 2], [1, 3]]
    fused = {r.vec_id: r.v for r in plain("fused_tangent")(spark, sf_dir).collect()}
    blend = {r.vec_id: r.v for r in plain("whitened_blend")(spark, sf_dir).collect()}
    for k in np.unique(labels):
        own = c[labels == k]
        blocks = [own[:, s][:, :, s] for s in sides]
        w = np.exp([-np.std([dist(b.mean(0), m) for m in b]) for b in blocks])
        w /= w.sum()
        v = np.array([tangent(m, c.mean(0)) for m in own])
        norm = np.linalg.norm(v, axis=1)
        a = np.clip(0.2 + 0.6 * norm.std() / (norm.mean() + 1e-12), 0.2, 0.95)
        mixed = (1 - a) * v + a * v @ power(np.cov(v.T) + 1e-4 * np.eye(10), -0.5).T
        for n, i in enumerate(np.flatnonzero(labels == k)):
            assert np.allclose(fused[ids[i]], np.concatenate([u * tangent(b[n], b.mean(0)) for u, b in zip(w, blocks)]), atol=2e-5)
            assert np.allclose(blend[ids[i]], mixed[n], atol=1e-4)


def test_separated_sources(spark, sf_dir, epochs):
    ids, labels, x, _ = epochs
    order = np.lexsort((ids, labels))
    flat = {k: x[[i for i in order if labels[i] == k]].reshape(-1, 4) for k in np.unique(labels)}
    whole = np.concatenate(list(flat.values()))
    mean = whole.mean(0)
    for name in ("sobi_sources", "fastica_sources"):
        got = rows(plain(name), spark, sf_dir, ["component"])
        assert np.allclose([r.variance for r in got], 1.0, atol=1e-3)  # sources have unit variance
    df = model_queries._wide(spark, sf_dir)
    m, w = model_queries.BS.sobi(df, ["label"], ["vec_id", "t"], model_queries.CH, 8)
    assert np.allclose(m, mean)
    lagged = []
    for lag in range(1, 9):
        pairs = np.concatenate([np.einsum("ti,tj->tij", f[lag:] - mean, f[:-lag] - mean) for f in flat.values()]).mean(0)
        lagged.append(w @ ((pairs + pairs.T) / 2) @ w.T)
    cross = lambda ms: sum((a**2).sum() - (np.diag(a) ** 2).sum() for a in ms)
    white = np.diag(np.linalg.eigvalsh(np.cov(whole.T, bias=True)) ** -0.5) @ np.linalg.eigh(np.cov(whole.T, bias=True))[1].T
    back = np.linalg.inv(w)
    assert cross(lagged) <= cross([white @ back @ a @ back.T @ white.T for a in lagged]) + 1e-12
    s = (whole - mean) @ w.T
    z = s - s.mean(0)
    kurtosis = (z**4).mean(0) / (z**2).mean(0) ** 2 - 3
    clean = mean + (s * np.where(np.abs(kurtosis) > 1.0, 0.0, 1.0)) @ back.T
    r = plain("artifact_zeroed")(spark, sf_dir).first()
    assert np.allclose([r[f"x{k}"] for k in range(4)], clean.var(0), atol=2e-5)


def test_network_and_forests(spark, sf_dir, epochs):
    ids, _, x, _ = epochs
    y, net, want = (ids % 2).astype(float), models.WaveNet(4), []
    for _ in range(5):
        loss, g = net.gradient(x, y)
        want.append(loss / len(y))
        net.parameters = {k: v - 0.1 * g[k] / len(y) for k, v in net.parameters.items()}
    assert np.allclose([r.loss for r in rows(plain("wavenet_loss"), spark, sf_dir, ["step"])], want, atol=2e-6) and want[-1] < want[0]
    for name in ("loso_rf", "loso_rbf"):
        got = plain(name)(spark, sf_dir).collect()
        assert sum(r.n for r in got) == len(ids) and all(0.0 <= r.accuracy <= 1.0 for r in got)
    r = plain("loso_forest_regression")(spark, sf_dir).first()
    assert r.n == len(ids) and r.r2 > 0.3


def test_swelling_of_noisy_copies(spark, sf_dir):
    r = plain("swelling_seeds")(spark, sf_dir).first()
    assert r.n_seeds == 20 and 1 <= r.min_ratio <= r.mean_ratio <= r.max_ratio and np.isclose(r.cv, r.std_ratio / r.mean_ratio, atol=1e-4)


def test_every_query_without_sql_has_a_twin():
    text = "".join(f.read_text() for f in Path(__file__).parent.glob("test_*.py"))
    assert [q for q in sorted(set(catalog.queries()) - set(catalog.oracle_sql())) if f'"{q}"' not in text] == []
