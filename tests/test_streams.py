"""Streams over many files, a file to a batch: each stateful operator equals its batch form; sinks and stores of live rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.operators import ordered, stats
from wavequarry.sources import sinks
from wavequarry.streaming import live

STREAMS = sorted(q for q in catalog.oracle_sql() if q.startswith("stream_"))


@pytest.fixture(scope="module")
def split(spark, sf_dir, tmp_path_factory):
    """The events in ten files, one after another in time."""
    folder = tmp_path_factory.mktemp("split")
    frame = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    import os

    for k, part in enumerate(np.array_split(np.arange(len(frame)), 10)):
        path = f"{folder}/events-{k}.parquet"
        con = duckdb.connect()
        rows = frame.iloc[part]
        con.register("rows", rows)
        con.sql("COPY (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props FROM rows) TO '" + path + "' (FORMAT parquet)")
        os.utime(path, (1.7e9 + k, 1.7e9 + k))
    return str(folder)


def test_there_are_ten_batches(spark, split):
    seen = []
    q = live.event_stream(spark, split).writeStream.foreachBatch(lambda rows, n: seen.append((n, rows.count()))).trigger(availableNow=True).option("checkpointLocation", split + "-ck").start()
    q.awaitTermination()
    assert len(seen) == 10 and all(n > 0 for _, n in seen)


@pytest.mark.parametrize("name", [s for s in STREAMS if s != "stream_static_baseline"])
def test_many_batches_equal_one_table(spark, sf_dir, split, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    got, want = catalog.queries()[name](spark, split).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    text = lambda f: sorted(map(str, f[sorted(want.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert len(got) and text(got) == text(want)


def test_a_repeated_update_batch_replaces_its_rows(spark, split):
    rows = live.drain(live.gap_counts(live.event_stream(spark, split)), "update")
    assert rows.groupBy("user_id", "received").count().where("count > 1").count() == 0
    assert rows.columns == ["user_id", "received", "lost"]


def test_null_keys_are_one_recording(spark):
    df = spark.range(1000).select(F.lit(None).cast("long").alias("k"), "id", F.lit(1.0).alias("v")).union(spark.range(50).select(F.lit(5).cast("long"), "id", F.lit(1.0)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = ordered.ordered_fold(df, ["k"], ["id"], lambda: 0.0, lambda s, rows: (s + rows["v"].sum(), rows[["id"]].assign(total=s + rows["v"].cumsum())), "id long, total double")
        assert out.agg(F.max("total")).first()[0] == 1000.0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_subscribers_get_every_row_however_many(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.txt").write_text("\n".join(str(k) for k in range(2500)))
    calls: list[list[str]] = []
    sinks.publish(spark.readStream.text(str(tmp_path / "in")), lambda lines: calls.append(list(lines)), str(tmp_path / "ck"), at_once=1000).awaitTermination()
    assert [len(c) for c in calls] == [1000, 1000, 500] and len({x for c in calls for x in c}) == 2500


def test_a_ledger_keeps_the_last_row_of_a_key(spark, tmp_path):
    ledger = sinks.Ledger(spark, str(tmp_path / "ledger"), ["k"])
    for rows in ([(1, "a"), (2, "a"), (None, "a")], [(2, "b"), (3, "b"), (None, "b")], [(1, "c")]):
        ledger.upsert(spark.createDataFrame(rows, "k int, v string"))
    again = sinks.Ledger(spark, str(tmp_path / "ledger"), ["k"])
    assert {tuple(r) for r in again.read().collect()} == {(1, "c"), (2, "b"), (3, "b"), (None, "b")} and again.read().count() == 4 and again.version == 2


def test_ten_rows_touch_ten_buckets_at_most(spark, tmp_path):
    ledger = sinks.Ledger(spark, f"file://{tmp_path}/ledger", ["k", "s"], buckets=200)
    every = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("s"), F.lit(0).alias("v"))
    ledger.upsert(every)
    before, earlier = ledger.folders(), ledger.read()
    ledger.upsert(every.where("k < 8").withColumn("v", F.lit(1)).union(spark.createDataFrame([(9001, None, 1), (9002, "x", 1)], "k long, s string, v int")))
    after = ledger.folders()
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 10 and len(before) == 200
    assert {f.split("/_bucket=")[0] for f in ledger._rows(sorted(changed)).inputFiles()}.isdisjoint({p.split("/_bucket=")[0] for p in before.values()})
    assert ledger.read().where("v = 1").count() == 10 and ledger.read().count() == 5002 and earlier.count() == 5000


def test_the_second_of_two_writers_fails_and_changes_nothing(spark, tmp_path):
    first, second = (sinks.Ledger(spark, str(tmp_path / "ledger"), ["k"]) for _ in range(2))
    first.upsert(spark.createDataFrame([(1, "first")], "k int, v string"))
    with pytest.raises(sinks.Conflict):
        second.upsert(spark.createDataFrame([(1, "second")], "k int, v string"))
    again = sinks.Ledger(spark, str(tmp_path / "ledger"), ["k"])
    assert [tuple(r) for r in again.read().collect()] == [(1, "first")]
    again.upsert(spark.createDataFrame([(1, "second", 5)], "k int, v string, more int"))
    assert [tuple(r) for r in again.read().collect()] == [(1, "second", 5)]
    again.upsert(spark.createDataFrame([], "k int, v string, more int"))
    assert again.read().count() == 1


def test_a_baseline_is_an_array_of_doubles_with_its_distances(spark, tmp_path):
    states = {"REST": np.eye(2), "COGNITIVE": np.diag([np.e, 1.0]), "MOTOR": np.diag([1.0, np.e**2])}
    rows = spark.createDataFrame([(k, m.ravel().tolist(), 5) for k, m in states.items()], "state string, matrix array<double>, n long")
    sinks.write_baselines(sinks.state_distances(rows, "state"), str(tmp_path / "b"), "state")
    found = {r.state: r for r in sinks.read_baselines(spark, str(tmp_path / "b")).collect()}
    assert found["REST"].matrix == [1.0, 0.0, 0.0, 1.0] and found["REST"].n == 5
    assert found["REST"].distances == pytest.approx({"COGNITIVE": 1.0, "MOTOR": 2.0}) and found["MOTOR"].distances == pytest.approx({"REST": 2.0, "COGNITIVE": 5**0.5})
    held = sinks.read_baselines(spark, str(tmp_path / "b"))
    sinks.write_baselines(held.where("state = 'REST'"), str(tmp_path / "b"), "state")  # read and written over
    assert [r.state for r in sinks.read_baselines(spark, str(tmp_path / "b")).collect()] == ["REST"] and held.count() == 3
    with pytest.raises(ValueError, match="array of doubles"):
        sinks.write_baselines(rows.withColumn("matrix", F.lit("x")), str(tmp_path / "b"), "state")


def test_shared_folder_of_a_cluster_must_be_named(monkeypatch):
    from wavequarry import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_ranks_numbers_and_tails(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2, 2, 5, 5, 5]], "v double")
    assert sorted((r.v, r["rank"], r.ties) for r in stats.average_ranks(df, "v").collect()) == [(1, 1, 1), (2, 2.5, 2), (2, 2.5, 2), (3, 4, 1), (5, 6, 3), (5, 6, 3), (5, 6, 3)]
    assert sorted((r.id, r.i, r.n) for r in stats.numbered(spark.range(100, 150), ["id"]).collect()) == [(100 + k, k, 50) for k in range(50)]
    p = {(r.k, r.n): r.p for r in stats.binomial_tail(spark.createDataFrame([(0, 0), (0, 4), (3, 4), (4, 4), (600, 1000)], "k long, n long"), "k", "n").collect()}
    assert p[0, 0] == 1 and abs(p[0, 4] - 1) < 1e-12 and abs(p[3, 4] - 5 / 16) < 1e-12 and abs(p[4, 4] - 1 / 16) < 1e-12 and 1.3e-10 < p[600, 1000] < 1.4e-10
    equal = stats.wilcoxon(spark.createDataFrame([(0.0,), (0.0,)], "d double"), "d").first()
    assert (equal.n, equal.w, equal.z) == (0, None, None)
