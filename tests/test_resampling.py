"""Resamples made in tasks are those of the join, and no plan makes a row for each draw and position."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.operators import stats


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(k, 300, round(float(a), 4), round(float(a + c), 4)) for k, (a, c) in enumerate(rng.normal(size=(300, 2)))], "i long, n long, a double, c double").repartition(5)


def test_resamples_are_those_of_the_join(spark, rows, monkeypatch):
    """F6, F8: 10 draws are two blocks of four and a half one."""
    how = [(["a"], F.avg("a"), np.mean), (["a"], F.median("a"), np.median), (["a", "c"], F.corr("a", "c"), stats.correlation)]
    fast = [stats.bootstrap(rows, columns, 10, column, of_arrays) for columns, column, of_arrays in how]
    assert not any("Generate" in plan(f) or "Join" in plan(f) for f in fast)
    fast = [dict(map(tuple, f.collect())) for f in fast]
    monkeypatch.setattr(stats, "FEW_VALUES", 0)
    for got, (columns, column, of_arrays) in zip(fast, how):
        assert got == pytest.approx(dict(map(tuple, stats.bootstrap(rows, columns, 10, column, of_arrays).collect()))) and len(got) == 10


def test_sign_flips_are_those_of_the_draws(spark, rows):
    """sums per task of what one digest after another gives."""
    fast = stats.sign_flip_means(rows, "a", 10)
    assert "Generate" not in plan(fast)
    sign = F.when(F.col("draw") >= stats.BOUND // 2, 1.0).otherwise(-1.0)
    slow = stats.drawn(rows.select("i", "a"), 10).groupBy("b").agg(F.avg(sign * F.col("a")))
    assert dict(map(tuple, fast.collect())) == pytest.approx(dict(map(tuple, slow.collect())))


def test_few_or_no_values(spark):
    one = spark.createDataFrame([(0, 1, 2.5, 1.0)], "i long, n long, a double, c double")
    none = one.where("i < 0")
    assert [r.statistic for r in stats.bootstrap(one, ["a", "c"], 3, F.corr("a", "c"), stats.correlation).collect()] == [None] * 3
    assert {abs(r.mean) for r in stats.sign_flip_means(one, "a", 9).collect()} == {2.5}
    assert stats.bootstrap_means(none, "a", 9).count() == stats.sign_flip_means(none, "a", 9).count() == 0
