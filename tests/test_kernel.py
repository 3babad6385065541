"""The kernel grid against plain Newton steps on explicit features, a fit at a time."""

from __future__ import annotations

import numpy as np
import pytest

from wavequarry import catalog
from wavequarry.operators import kernel, manifold
from wavequarry.plans import model_queries


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(kernel, "LANDMARKS", 12)
    monkeypatch.setattr(kernel, "CS", (0.5, 10.0))
    monkeypatch.setattr(kernel, "GAMMAS", (0.005, 0.1))


def fitted(phi, y, weight, c):
    """Weights of least |w|^2 / 2 + c sum of weight * hinge^2, by steps that are halved until they help."""
    s, held = np.where(y > 0.5, 1.0, -1.0), np.append(np.ones(phi.shape[1] - 1), 1e-6)
    loss = lambda w: 0.5 * (held * w * w).sum() + c * (weight * np.maximum(1 - s * (phi @ w), 0) ** 2).sum()
    w = np.zeros(phi.shape[1])
    for _ in range(200):
        short = np.maximum(1 - s * (phi @ w), 0)
        on = phi[short > 0]
        gradient = held * w - 2 * c * phi.T @ (weight * s * short)
        step = np.linalg.solve(np.diag(held) + 2 * c * on.T @ (on * weight[short > 0][:, None]), -gradient)
        t = 1.0
        while loss(w + t * step) > loss(w) and t > 1e-9:
            t /= 2
        w = w + t * step
        if np.abs(gradient).max() < 1e-9:
            break
    return w


@pytest.mark.parametrize("view", ["raw", "tangent"])
def test_every_setting_equals_its_own_fit(spark, sf_dir, small, view):
    table = model_queries._stored(model_queries.contrasts(spark, sf_dir))
    references = {k: v for k, v in manifold.references_without(table, "label", "c").items() if k in (0, 3)}
    at = {"raw": model_queries.raw_view, "tangent": manifold.tangents}[view]
    got = {(r.fold, r.c, r.gamma, r.class_weight): r for r in kernel.kernel_grid(table, "c", "y", "label", "_part", 3, at, references, view == "raw").collect()}
    assert len(got) == 2 * 2 * 2 * 2
    folds = kernel._folds(table, "c", "y", "label", "_part", at, references, view == "raw", 3, kernel.LANDMARKS)
    rows = table.collect()
    c, y, g, part = np.array([r.c for r in rows]), np.array([r.y for r in rows]), np.array([r.label for r in rows]), np.array([r._part for r in rows])
    for (fold, cost, gamma, kind), r in got.items():
        phi, train, right = folds[fold].features(at(c, references[fold]), gamma), g != fold, 0
        for p in (*range(3), None):
            own = train & (part != p) if p is not None else train
            n = np.array([(y[own] < 0.5).sum(), (y[own] > 0.5).sum()])
            weight = np.where(y[own] > 0.5, *(own.sum() / (2 * n[::-1]))) if kind == "balanced" else np.ones(own.sum())
            w = fitted(phi[own], y[own], weight, cost)
            tried = train & (part == p) if p is not None else ~train
            hits = ((phi[tried] @ w > 0) == (y[tried] > 0.5)).sum()
            if p is None:
                assert (r.n_outer, r.outer) == (tried.sum(), pytest.approx(hits / tried.sum(), abs=1.01 / tried.sum()))
            else:
                right += hits
        assert (r.n_inner, r.inner) == (train.sum(), pytest.approx(right / train.sum(), abs=1.01 / train.sum()))  # a row on the edge may fall to either side


def test_landmark_features_are_the_kernel_among_landmarks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, 3))
    f = kernel.kernel_fold(x, None, np.zeros(3), np.ones(3), np.ones((3, 2)), (0.3,))
    phi = f.features(x, 0.3)[:, :-1]
    assert np.allclose(phi @ phi.T, np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1)), atol=1e-6)


def test_all_98_settings_are_scored_and_the_best_is_kept(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(kernel, "LANDMARKS", 10)
    scores = catalog.queries()["kernel_grid"](spark, sf_dir)
    rows = scores.collect()
    assert len(rows) == 98 * len({r.fold for r in rows}) and len({(r.c, r.gamma, r.class_weight) for r in rows}) == 98
    best = {r.fold: r for r in kernel.best_of(scores).collect()}
    for fold in {r.fold for r in rows}:
        own = [r for r in rows if r.fold == fold]
        want = min(own, key=lambda r: (-r.inner, r.c, r.gamma, r.class_weight != "none"))
        assert (best[fold].c, best[fold].gamma, best[fold].class_weight, best[fold].outer) == (want.c, want.gamma, want.class_weight, want.outer)
    assert np.mean([b.outer for b in best.values()]) > 0.9


def test_a_fold_falls_back_to_raw_features(spark, sf_dir, small):
    for r in catalog.queries()["nested_kernel"](spark, sf_dir).collect():
        assert r.features == ("raw" if r.tangent_inner < r.raw_inner else "tangent") and r.gated_outer == (r.raw_outer if r.features == "raw" else r.tangent_outer)
