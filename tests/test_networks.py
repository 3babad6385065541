"""Local steps, out-of-fold predictions and saliency against plain loops and finite differences."""

from __future__ import annotations

import numpy as np
import pytest

from wavequarry import catalog
from wavequarry.operators import models, networks
from wavequarry.operators.blocks import stored
from wavequarry.plans import network_queries


@pytest.fixture(scope="module")
def epochs(spark, sf_dir):
    return stored(network_queries.long_epochs(spark, sf_dir).coalesce(1), "epochs")


def arrays(rows):
    rows = rows.collect()
    return np.array([r.x for r in rows]).reshape(-1, 64, 4), np.array([r.y for r in rows]), np.array([r.fold for r in rows])


def test_one_task_takes_the_steps_of_a_plain_loop(epochs):
    nets, losses, scales = networks.train_out_of_fold(epochs, "x", "y", "fold", 5, 64, 4, epochs=3)
    x, y, fold = arrays(epochs)
    met = np.zeros(3)
    for k in range(5):
        train = fold != k
        mean, sd = y[train].mean(), y[train].std()
        assert np.allclose(scales[k], (mean, sd))
        net, z = models.WaveNet(4, width=25), (y[train] - mean) / sd
        for epoch in range(3):
            for at in range(0, train.sum(), 16):
                part, target = x[train][at : at + 16], z[at : at + 16]
                met[epoch] += ((net.predict(part) - target) ** 2).sum()
                _, g = net.gradient(part, target)
                net.parameters = {n: v - 0.05 * g[n] / len(part) for n, v in net.parameters.items()}
        assert all(np.allclose(net.parameters[n], nets[k].parameters[n]) for n in networks.NAMES)
    assert np.allclose(losses, met / (4 * len(y)))


def test_several_tasks_are_averaged_by_rows(spark, epochs):
    parts = stored(epochs.repartition(3), "parts")
    nets, _, scales = networks.train_out_of_fold(parts, "x", "y", "fold", 5, 64, 4, epochs=1)
    total, rows = 0, 0
    for task in parts.rdd.glom().collect():
        own = [r for r in task if r.fold != 0]
        if own:
            x, y = np.array([r.x for r in own]).reshape(-1, 64, 4), (np.array([r.y for r in own]) - scales[0][0]) / scales[0][1]
            net, _ = networks.local_steps(models.WaveNet(4, width=25), x, y, 0.05, 16)
            total, rows = total + len(own) * networks.flat(net), rows + len(own)
    assert np.allclose(networks.flat(nets[0]), total / rows)


def test_predictions_are_out_of_fold_and_beat_full_batch_descent(spark, sf_dir, epochs):
    rows = catalog.queries()["wavenet_folds"](spark, sf_dir).collect()
    x, y, fold = arrays(epochs)
    assert sum(r.n for r in rows) == len(y) and {r.fold for r in rows} == set(fold.tolist())
    net, z = models.WaveNet(4, width=25), (y - y.mean()) / y.std()
    for _ in range(60):
        _, g = net.gradient(x, z)
        net.parameters = {n: v - 0.05 * g[n] / len(x) for n, v in net.parameters.items()}
    assert rows[0].last_loss < ((net.predict(x) - z) ** 2).mean() and rows[0].last_loss < rows[0].first_loss


def test_each_row_is_predicted_by_the_network_that_has_not_seen_it(epochs):
    nets, _, scales = networks.train_out_of_fold(epochs, "x", "y", "fold", 5, 64, 4, epochs=2)
    for r in networks.predictions(epochs, "x", "fold", nets, scales, 64, 4).collect():
        mean, sd = scales[r.fold]
        assert np.isclose(r.predicted, mean + sd * nets[r.fold].predict(np.array(r.x).reshape(1, 64, 4))[0])


def test_input_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    net, x = models.WaveNet(4, width=25), rng.normal(size=(3, 64, 4))
    got = networks.input_gradient(net, x)
    for k, t, c in [(0, 0, 0), (1, 30, 2), (2, 63, 3), (0, 24, 1), (1, 40, 0)]:
        up, down = x.copy(), x.copy()
        up[k, t, c] += 1e-6
        down[k, t, c] -= 1e-6
        assert np.isclose(got[k, t, c], (net.predict(up)[k] - net.predict(down)[k]) / 2e-6, atol=1e-6)


def test_saliency_is_the_mean_absolute_gradient(spark, sf_dir, epochs):
    nets, _, _ = networks.train_out_of_fold(epochs, "x", "y", "fold", 5, 64, 4, epochs=2)
    x, _, fold = arrays(epochs)
    want = np.mean([np.abs(networks.input_gradient(nets[f], e[None])[0]) for e, f in zip(x, fold)], axis=0)
    got = {(r.t, r.ch): r.saliency for r in networks.saliency(epochs, "x", "fold", nets, 64, 4).collect()}
    assert len(got) == 256 and all(np.isclose(got[t, c], want[t, c]) for t in range(64) for c in range(4))
    assert "wavenet_saliency" in catalog.queries()
    found = network_queries.wavenet_saliency(spark, sf_dir, epochs=2)
    assert found.count() == 256 and found.where("saliency < 0").count() == 0
