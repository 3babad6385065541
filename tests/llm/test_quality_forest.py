"""The forest's scores and the rejecting score against plain versions, and held-out labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavequarry.llm import quality
from wavequarry.llm.common import held_out


def test_scores_are_those_of_walking_each_tree():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(600, 4))
    forest = quality.IsolationForest(20, 64).fit(rows, np.full(4, -5.0), np.full(4, 5.0))
    new = np.vstack([rows[:40], rng.uniform(-5, 5, size=(40, 4)), rows[:1]])
    for row, score in zip(new, forest.score(new)):
        total = 0.0
        for feature, value, left, path in forest.grown:
            node = 0
            while left[node]:
                node = left[node] + int(row[feature[node]] > value[node])
            total += path[node]
        assert np.isclose(score, 2 ** (-total / 20 / forest.norm))


def test_the_rejecting_score_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for _ in range(30):
        rows = pd.DataFrame({"bin": rng.integers(300, 700, 60), "good": rng.integers(0, 2, 60), "n": rng.integers(1, 50, 60)})
        limit = quality.reject_above(rows, 0.05)
        lost = lambda t: (rows.n * (rows.good == 1) * (rows.bin >= t)).sum()
        hit = lambda t: (rows.n * (rows.good == 0) * (rows.bin >= t)).sum()
        allowed = [t for t in range(1002) if lost(t) <= 0.05 * rows.n[rows.good == 1].sum()]
        at = int(np.ceil(limit * 1000 - 1e-9))
        assert lost(at) <= 0.05 * rows.n[rows.good == 1].sum() and hit(at) == max(hit(t) for t in allowed)


def test_held_out_labels(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = held_out(F.col("doc_id"), 3, 1)
    got = quality.judge(d, y.where(~out)).where("not base_failed").join(y.where(out), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).collect()
    by = {r.quality: r for r in got}
    assert by[1].kept >= 0.98 * by[1].n and by[0].kept <= 0.1 * by[0].n
