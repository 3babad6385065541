"""Resamples and sign flips spread as theory says, at every number of rows."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.operators import stats

DRAWS = 400


@pytest.mark.parametrize("n", [50, 150, 1_500, 20_000])
def test_spread_of_resampled_means_and_of_sign_flips(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(k, n, float(x)) for k, x in enumerate(v)], "i long, n long, v double")
    means = [r.mean for r in stats.bootstrap_means(rows, "v", DRAWS).collect()]
    flips = [r.mean for r in stats.sign_flip_means(rows, "v", DRAWS).collect()]
    assert len(means) == len(flips) == DRAWS
    assert 0.9 < np.std(means) / (v.std() / n**0.5) < 1.1 and 0.9 < np.std(flips) / (np.sqrt((v**2).mean()) / n**0.5) < 1.1


def test_spread_over_many_rows(spark, monkeypatch):
    rows = spark.range(200_000).select(F.col("id").alias("i"), F.lit(200_000).cast("long").alias("n"), (stats.scattered(F.col("id")) / stats.BOUND).alias("v"))
    monkeypatch.setattr(stats, "FEW_VALUES", 1000)  # by a shuffle
    means = [r.mean for r in stats.bootstrap_means(rows, "v", 200).collect()]
    assert 0.87 < np.std(means) / (12**-0.5 / 200_000**0.5) < 1.13


def test_neighbouring_draws_and_positions_have_nothing_in_common(spark):
    rows = {(r.b, r.i): r.draw for r in stats.drawn(spark.range(300).select(F.col("id").alias("i")), 10).collect()}
    assert len(rows) == 3000 and rows[6, 7] == int(md5(b"1-7").hexdigest()[16:24], 16)
    m = np.array([[rows[b, i] for i in range(300)] for b in range(10)]) / stats.BOUND
    assert abs(np.corrcoef(m) - np.eye(10)).max() < 0.25 and abs(np.corrcoef(m[:, :-1].ravel(), m[:, 1:].ravel())[0, 1]) < 0.08
    steps = np.diff(m, axis=1) % 1
    assert np.std(steps) > 0.25  # no arithmetic progression
