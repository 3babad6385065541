"""Means as tables, nested samples and polynomial ridge fits against plain NumPy."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.operators import manifold, mean_tables, polynomial
from wavequarry.plans import model_queries

RNG = np.random.default_rng(12)


def of_eigen(m, f):
    v, w = np.linalg.eigh(m)
    return w @ np.diag(f(v)) @ w.T


def spd(n):
    a = RNG.normal(size=(n, 4, 4))
    return a @ np.swapaxes(a, 1, 2) + 0.5 * np.eye(4)


def test_a_mean_per_key_null_keys_too(spark):
    groups = {(1, "a"): spd(7), (1, "b"): spd(1), (2, None): spd(30), (None, None): np.repeat(spd(1), 5, 0)}
    rows = [(*k, m.ravel().tolist()) for k, ms in groups.items() for m in ms]
    got = {(r.k, r.s): r for r in mean_tables.geometric_mean_table(spark.createDataFrame(rows, "k long, s string, c array<double>").repartition(3), ["k", "s"], "c").collect()}
    assert set(got) == set(groups)
    for k, ms in groups.items():
        m = np.reshape(got[k].mean, (4, 4))
        w = of_eigen(m, lambda v: v**-0.5)
        assert got[k].converged and got[k].n == len(ms) and np.allclose(np.reshape(got[k].arithmetic, (4, 4)), ms.mean(0))
        assert np.abs(np.mean([of_eigen(w @ c @ w, np.log) for c in ms], axis=0)).max() < 1e-6  # tangents balance at the mean
        assert np.isclose(np.linalg.slogdet(m)[1], np.mean(np.linalg.slogdet(ms)[1]))


def test_a_mean_that_is_not_there_yet_says_so(spark):
    rows = [(1, m.ravel().tolist()) for m in spd(20)]
    assert not mean_tables.geometric_mean_table(spark.createDataFrame(rows, "k long, c array<double>"), ["k"], "c", most_rounds=1).first().converged
    assert mean_tables.geometric_mean_table(spark.createDataFrame([], "k long, c array<double>"), ["k"], "c").count() == 0


def test_matrices_that_are_no_covariances_are_left_out(spark):
    good, flat = spd(1)[0], np.diag([1.0, 1.0, 1.0, 0.0])
    skew = good.copy()
    skew[0, 1] += 0.2
    rows = [(0, good), (1, flat), (2, -good), (3, skew), (4, np.full((4, 4), np.nan))]
    df = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in rows] + [(5, None)], "k long, c array<double>")
    got = {r.k: np.reshape(r.c, (4, 4)) for r in mean_tables.usable(df, "c").collect()}
    assert set(got) == {0, 3} and np.allclose(got[3], (skew + skew.T) / 2)


def test_samples_nest_and_have_their_sizes(spark):
    df = spark.range(50).withColumnRenamed("id", "vec_id")
    found = {}
    for r in mean_tables.nested_samples(df, "vec_id", [5, 20, 50], 3).collect():
        found.setdefault((r.seed, r.size), set()).add(r.vec_id)
    for seed in range(3):
        order = sorted(range(50), key=lambda i: (int(md5(f"{seed}-{i}".encode()).hexdigest()[:8], 16), i))
        assert [found[seed, s] for s in (5, 20, 50)] == [set(order[:s]) for s in (5, 20, 50)]
    assert found[0, 5] != found[1, 5]


def test_penalties_equal_refits(spark, sf_dir):
    table = model_queries._stored(model_queries.contrasts(spark, sf_dir))
    references = {k: v for k, v in manifold.references_without(table, "label", "c").items() if k in (1, 4)}
    scores, done = polynomial.left_out_polynomial(table, "c", "y", "label", manifold.tangents, references)
    gcv = {(r.fold, round(np.log10(r.alpha), 6)): r.gcv for r in scores.collect()}
    rows = done.collect()
    c, y, g = np.array([r.c for r in rows]), np.where(np.array([r.y for r in rows]) > 0.5, 1.0, -1.0), np.array([r.label for r in rows])
    standard = lambda x, own: (x - x[own].mean(0)) / x[own].std(0)
    for fold, reference in references.items():
        own = g != fold
        x = standard(manifold.tangents(c, reference), own)
        i, j = np.triu_indices(10)
        x = standard(np.column_stack([x, x[:, i] * x[:, j]]), own)
        best = (np.inf, None)
        for alpha in polynomial.ALPHAS:
            z, n = x[own], own.sum()
            solve = np.linalg.solve(z.T @ z + alpha * np.eye(65), z.T)
            hat = z @ solve + 1 / n
            error = ((y[own] - hat @ y[own]) ** 2).mean() / (1 - np.trace(hat) / n) ** 2
            assert np.isclose(gcv[fold, round(np.log10(alpha), 6)], error, rtol=1e-6)
            if error < best[0]:
                best = error, alpha, x[~own] @ (solve @ y[own]) + y[own].mean()
        assert np.allclose([r.decision for r in rows if r.label == fold], best[2], atol=1e-6) and all(np.isclose(r.alpha, best[1]) for r in rows if r.label == fold)
    assert all(r.decision is None or np.isnan(r.decision) for r in rows if r.label not in references)


def test_polynomial_ridge_finds_the_stronger_channel(spark, sf_dir):
    rows = catalog.queries()["polynomial_ridge"](spark, sf_dir).agg(F.sum("n"), F.sum(F.col("n") * F.col("accuracy"))).first()
    assert rows[0] == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() and rows[1] / rows[0] > 0.8
