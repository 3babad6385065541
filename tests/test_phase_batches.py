"""Samples that come at once are judged as those that come one by one, with far fewer calls."""

from __future__ import annotations

import numpy as np
import pytest

from wavequarry.functions import linalg as L
from wavequarry.plans.stream_queries import FRAME_SCORING
from wavequarry.streaming import phases


def test_many_samples_at_once(monkeypatch):
    """matrices of all windows are taken apart together; only the running mean goes window by window."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 80, (600, 4))
    at = 1_704_067_200_000 + np.sort(rng.integers(0, 30 * 86_400_000, 600))
    one, rows = phases.Session(FRAME_SCORING, int(at[0])), []
    for v, t in zip(x, at):
        rows += one.take(v[None], int(t))
    calls = []
    monkeypatch.setattr(L, "distance", lambda *a, f=L.distance: calls.append(1) or f(*a))
    several = phases.Session(FRAME_SCORING, int(at[0]))
    got = several.take(x[:251], at[:251]) + several.take(x[251:], at[251:])
    assert len(calls) <= 4 and len(got) == len(rows) == 149
    assert [r[:3] for r in got] == [r[:3] for r in rows] and {r[2] for r in rows} == {"calibration", "inference"}
    for a, b in zip(got, rows):
        assert a[3:] == (None,) * 4 == b[3:] or a[3:] == pytest.approx(b[3:], abs=1e-9)
    assert np.allclose(one.buffer, several.buffer) and np.allclose(one.running, several.running)
