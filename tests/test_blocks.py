"""Filters over blocks of long recordings equal those over whole arrays, at every border."""

from __future__ import annotations

import numpy as np
import pytest

from wavequarry.functions import dsp
from wavequarry.operators import blocks, filters

RNG = np.random.default_rng(8)
LENGTHS = {1: 1, 2: 2, 3: 20, 4: 54, 5: 108, 6: 109, 7: 162, 8: 230, 9: 1000, None: 3100}
STAGES = [(dsp.notch(50.0, 250.0), dsp.line_notches(250.0, (50.0,))[0]), (dsp.butterworth(1.0, 30.0, 250.0), dsp.butterworth_sections(1.0, 30.0, 250.0))]


@pytest.fixture(scope="module")
def recordings(spark):
    values = {k: RNG.normal(size=n).cumsum() for k, n in LENGTHS.items()}
    rows = [(k, t, float(v), "x") for k, x in values.items() for t, v in enumerate(x)]
    RNG.shuffle(rows)
    rows = [(None if k is None else int(k), int(t), float(v), x) for k, t, v, x in rows]
    return values, spark.createDataFrame(rows, "k long, t long, v double, block string").repartition(7)


def test_blocks_hold_every_sample_once_and_in_order(recordings):
    values, df = recordings
    found = {}
    for r in blocks.blocks(df, ["k"], ["t"], "v", 50).collect():
        found.setdefault(r.k, []).append((r.block, r["first"], r["last"], [a.t for a in r["at"]], r.x))
    for k, x in values.items():
        parts = sorted(found[k], key=lambda p: p[0])
        assert [t for p in parts for t in p[3]] == list(range(len(x))) and np.allclose(np.concatenate([p[4] for p in parts]), x)
        assert [p[1] for p in parts] == [True] + [False] * (len(parts) - 1) and [p[2] for p in parts] == [False] * (len(parts) - 1) + [True]
        assert all(len(p[3]) >= 50 for p in parts) or len(parts) == 1


@pytest.mark.parametrize("size", [54, 100, 4096])
def test_chains_over_blocks_equal_those_over_whole_recordings(recordings, size):
    values, df = recordings
    got = {(r.k, r.t): r.filtered for r in filters.zero_phase_chain(df, ["k"], ["t"], "v", [s for _, s in STAGES], size).collect()}
    assert len(got) == sum(LENGTHS.values())
    for k, x in values.items():
        for (b, a), _ in STAGES:
            x = dsp.zero_phase(b, a, x)
        assert np.allclose([got[k, t] for t in range(len(x))], x, atol=1e-6)


def test_an_empty_table_stays_empty(spark):
    none = spark.createDataFrame([], "k long, t long, v double")
    assert filters.zero_phase_chain(none, ["k"], ["t"], "v", [STAGES[0][1]]).count() == 0


@pytest.mark.parametrize("design", [(1.0, 45.0, 250.0, 4), (8.0, 30.0, 250.0, 5), (2.0, 100.0, 250.0, 3), (49.0, 51.0, 250.0, 2, True)])
def test_sections_are_the_same_filter(design):
    b, a = dsp.butterworth(*design)
    f = dsp.Recursion(dsp.butterworth_sections(*design))
    x = RNG.normal(size=777)
    assert np.allclose(f.run(x)[0], dsp.run_filter(b, a, x)[0], atol=1e-8)
    parts, z = [], None
    for part in np.split(x, [1, 70, 300]):
        y, z = f.run(part, z)
        parts.append(y)
    assert np.allclose(np.concatenate(parts), f.run(x)[0])
    ones = f.run(np.ones(500), f.steady)[0]
    assert np.allclose(ones, ones[0])
    assert np.allclose(f.run(x, f.steady)[1], f.power(len(x)) @ f.steady + f.run(x)[1])


def test_notches_only_below_half_the_rate():
    assert [len(dsp.line_notches(r)) for r in (90.0, 110.0, 250.0)] == [0, 1, 2] and len(dsp.cleaning_chain(250.0)) == 3
