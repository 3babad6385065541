"""Means on a half, on a whole number and variances on a bound come out the same in whatever order rows are summed."""

from __future__ import annotations

from datetime import datetime, timedelta
from fractions import Fraction
from math import floor
from random import Random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.operators import aggregates as A


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def events(spark, folder, rows):
    """Rows (user_id, minute, event_type, value) as an events table of one file, which streams read too."""
    users, minutes, kinds, values = zip(*rows)
    start = datetime(2024, 1, 1)
    ts = pa.array([start + timedelta(minutes=m) for m in minutes], pa.timestamp("us"))
    frame = pa.table({"event_id": range(len(rows)), "ts": ts, "user_id": users, "event_type": kinds, "value": values, "props": ["{}"] * len(rows)})
    pq.write_table(frame, f"{folder}/events.parquet")
    return str(folder)


def test_blink_clench_on_the_bound(spark, tmp_path):
    """windows whose variance is 2500, four samples each of two values 100 apart, in every order of two."""
    rng, rows = Random(1), []
    for user in range(300):
        low = rng.randrange(5_100, 30_000) / 100
        window = [low] * 4 + [round(low + 100, 2)] * 4
        rng.shuffle(window)
        rows += [(user, t, "view", v) for t, v in enumerate(window)]
    folder = events(spark, tmp_path, rows)
    got = {tuple(r) for r in catalog.queries()["blink_clench"](spark, folder).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert got == set(con.sql(catalog.oracle_sql()["blink_clench"]).fetchall())


def test_fold_log_parse_on_halves(spark, tmp_path):
    """mean discounts of k + 1/2 thousandths."""
    rng, rows, want = Random(2), [], {}
    for supplier in range(60):
        n = 20
        cents = [rng.randrange(11) for _ in range(n - 1)]
        cents.append((1 - sum(cents)) % 2)  # 10 times an odd sum over 20 lies on a half
        rows += [(supplier, "A", float(rng.randrange(1, 51)), c / 100) for c in cents]
        assert Fraction(sum(cents) * 10, n).denominator == 2
        want[supplier] = float(floor(Fraction(sum(cents) * 10, n) + Fraction(1, 2)))
    folder = written(spark, tmp_path, "lineitem", rows, "l_suppkey long, l_returnflag string, l_quantity double, l_discount double")
    assert {r.subject: r.tangent for r in catalog.queries()["fold_log_parse"](spark, folder).collect()} == want


def test_static_baseline_on_whole_means(spark, tmp_path):
    """recordings whose mean is a whole number keep it, wherever sums of parts would end."""
    rng, rows = Random(3), []
    for user in range(60):
        cents = [rng.randrange(1, 30_000) for _ in range(19)]
        cents.append(-sum(cents) % 2_000 + 2_000)
        rng.shuffle(cents)
        rows += [(user, t, "view", c / 100) for t, c in enumerate(cents)]
    folder = events(spark, tmp_path, rows)
    want = {}
    for k, (user, _, _, _) in enumerate(rows):
        want.setdefault(user, []).append(k)
    got = {r.event_id: r.away for r in catalog.queries()["stream_static_baseline"](spark, folder).collect()}
    for ids in want.values():
        cents = [round(rows[k][3] * 100) for k in ids]
        base = Fraction(sum(cents), 100 * len(cents))
        assert base.denominator == 1
        assert [got[k] for k in ids] == [float(round(Fraction(c, 100) - base, 2)) for c in cents]


def test_differences_on_halves(spark, tmp_path):
    """differences of means on a half of the fourth place are rounded away from zero, so that equal ones stay tied."""
    rng, rows, want = Random(4), [], []
    for user in range(80):
        n = 8  # eighths of a hundredth: 0.00125 and its odd multiples lie on a half of the fourth place
        a, b = ([rng.randrange(1, 20_000) for _ in range(n)] for _ in range(2))
        a[0] += 1 - (sum(a) - sum(b)) % 2
        rows += [(user, 2 * t, "click", c / 100) for t, c in enumerate(a)] + [(user, 2 * t + 1, "view", c / 100) for t, c in enumerate(b)]
        d = Fraction(sum(a) - sum(b), 100 * n)
        assert (d * 20_000).denominator == 1 and (d * 20_000) % 2 == 1
        sign = 1 if d > 0 else -1
        want.append(sign * floor(abs(d) * 10_000 + Fraction(1, 2)) / 10_000)
    from wavequarry.plans.stat_queries import _differences

    folder = events(spark, tmp_path, rows)
    assert {r.user_id: r.d for r in _differences(spark, folder).collect()} == dict(enumerate(want))
    size = sorted((abs(d), d > 0) for d in want)
    ranks = {v: sum(k + 1 for k, (x, _) in enumerate(size) if x == v) / sum(x == v for x, _ in size) for v, _ in size}
    sums = [sum(ranks[v] for v, up in size if up == way) for way in (True, False)]
    assert catalog.queries()["wilcoxon_signed"](spark, folder).first().w == min(sums)


@pytest.mark.parametrize("values", [[1e-9, 2.5], [1e30, 1.0], [float("inf"), 1.0], [1 / 3, 2 / 3, 1.0]])
def test_means_of_other_numbers_are_plain(spark, values):
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    got = rows.agg(A.ordered_mean(F.col("v")).alias("m"), A.rounded_mean(F.col("v"), 4).alias("r"), F.avg("v").alias("m0"), F.round(F.avg("v"), 4).alias("r0")).first()
    assert (got.m, got.r) == (got.m0, got.r0)


def test_means_of_nothing_are_null(spark):
    got = spark.createDataFrame([(None,)], "v double").agg(A.ordered_mean(F.col("v")).alias("m"), A.rounded_mean(F.col("v"), 4).alias("r"), A.rounded_difference(F.col("v"), F.col("v"), 4).alias("d")).first()
    assert tuple(got) == (None, None, None)
