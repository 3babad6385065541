"""Files of the feeds, read and written."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.operators import aggregates
from wavequarry.operators.packets import parse_fold_lines
from wavequarry.sources import files, generators, sinks


def test_csv_with_broken_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,c1,c2\n0.0,1.5,2\n0.1,oops,3\n0.2,4\n0.3,5,6e1\nTimestamp,c1,c2\n")
    got = files.read_signal_csv(spark, str(tmp_path), ["c1", "c2"]).collect()
    assert [tuple(r) for r in got] == [(1.5, 2.0), (5.0, 60.0)]


def test_matrix_text_and_pairs(spark, tmp_path):
    (tmp_path / "s1_lo.txt").write_text("  1 2  3\n4 5\n6 7 x\n8 9 10\n")
    (tmp_path / "s1_hi.txt").write_text("1 1 1\n")
    (tmp_path / "s2_hi.txt").write_text("2 2 2\n")
    rows = files.read_matrix_text(spark, str(tmp_path), 3).where("file = 's1_lo.txt'").collect()
    assert [list(r.x) for r in rows] == [[1, 2, 3], [8, 9, 10]]
    assert [tuple(r) for r in files.paired_files(spark, str(tmp_path), "_lo.txt", "_hi.txt").collect()] == [("s1", "s1_lo.txt", "s1_hi.txt")]


def test_latest_file(spark, tmp_path):
    import os

    for k, name in enumerate(["a.csv", "b.csv", "c.txt"]):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1e9 + k, 1e9 + k))
    assert files.latest_file(spark, str(tmp_path), ".csv").first().path.endswith("b.csv")
    assert files.latest_file(spark, str(tmp_path), ".none").count() == 0


def test_log_blocks(spark, tmp_path):
    (tmp_path / "log.txt").write_text("start\n=== RUN\n[block 1] subject 007: raw=61.5 tangent=70.0\nnoise\n=== RUN\n[block 2] subject 008: raw=50.0 tangent=51.25\n")
    rows = files.read_log_blocks(spark, str(tmp_path), "=== RUN")
    assert {r.block for r in rows.collect()} == {1, 2}
    assert [tuple(r) for r in parse_fold_lines(rows, "line").orderBy("block").collect()] == [(1, 7, 61.5, 70.0), (2, 8, 50.0, 51.25)]


def test_frames(spark, tmp_path):
    sent = [(k % 256, -5 * k, 300 * k - 9000, 32767, -32768, 4_000_000_000 + k, k % 3) for k in range(40)]
    (tmp_path / "f.bin").write_bytes(b"".join(struct.pack("<BhhhhIB", *s) for s in sent) + b"\x01\x02")
    got = files.read_frames(spark, str(tmp_path)).orderBy("at").drop("file", "at").collect()
    assert [tuple(r) for r in got] == sent


def test_json_packets_and_publish(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text('{"seq": 1, "v": 2.5}\nnot json\n{"seq": 2}\n')
    assert [tuple(r) for r in files.read_json_packets(spark, str(tmp_path / "in"), "seq long, v double").orderBy("seq").collect()] == [(1, 2.5), (2, None)]
    sent: list[str] = []
    stream = files.read_json_packets(spark, str(tmp_path / "in"), "seq long, v double", stream=True)
    sinks.publish(stream, sent.extend, str(tmp_path / "ck")).awaitTermination()
    assert sorted(json.loads(s)["seq"] for s in sent) == [1, 2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("REST", 1, 0.5), ("TASK", 2, 1.5)], "state string, n int, v double")
    sinks.write_by_state(df, str(tmp_path / "s"), "state")
    assert spark.read.parquet(str(tmp_path / "s" / "state=TASK")).first().v == 1.5
    for _ in range(2):
        sinks.append_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4
    assert {r.value for r in sinks.report_lines(df, "%-6s|%3d|%.2f").collect()} == {"REST  |  1|0.50", "TASK  |  2|1.50"}


def test_generators(spark):
    rows = generators.mixed_rhythms(spark, 10)
    assert rows.count() == 2500 and rows.exceptAll(generators.mixed_rhythms(spark, 10)).count() == 0
    snr = rows.agg(aggregates.snr_db(F.col("ch3"), F.col("x3")).alias("s")).first().s
    assert 0 < snr < 40
    assert generators.detached_electrode(spark).where("t >= 6 and signal != 187.5").count() == 0
    focus = generators.focus_sessions(spark, 4).groupBy("session").agg(F.max("focus").alias("f"), F.min("focus").alias("g"))
    assert focus.where("f != g").count() == 0 and focus.count() == 4
    m, sd = generators.autoregressive(spark, 2, 2000).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(m) < 0.5 and 1 < sd < 10 and not math.isnan(sd)


@pytest.mark.parametrize("n", [1000])
def test_noise_is_normal(spark, n):
    m, sd = spark.range(n * 20).select(generators.unit_noise(F.col("id"), 1).alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(m) < 0.03 and abs(sd - 1) < 0.03


def test_markov_states(spark):
    rows = generators.markov_states(spark, 40, 500).toPandas().sort_values(["chain", "second"])
    assert len(rows) == 20_000 and (rows[rows.second == 0].state == "REST").all()
    rows["next"] = rows.groupby("chain").state.shift(-1)
    pairs = rows.dropna()
    for state, chances in zip(generators.STATES, generators.NEXT_STATE):
        after = pairs[pairs.state == state].next.value_counts(normalize=True)
        assert all(abs(after.get(s, 0.0) - p) < 0.03 for s, p in zip(generators.STATES, chances))
    assert generators.markov_states(spark, 2, 3, ((0.0, 1.0), (0.0, 1.0)), ("a", "b")).where("(second = 0) != (state = 'a')").count() == 0
    with pytest.raises(ValueError):
        generators.markov_states(spark, 1, 1, ((0.0, 1.0), (1.0, 0.0)), ("a", "b"))


def test_pink_noise_and_pulses(spark):
    x = spark.range(1 << 14).select("id", generators.pink_noise(F.col("id"), 1).alias("x")).toPandas().sort_values("id").x.to_numpy()
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    low, high = power[16:64].mean(), power[1024:4096].mean()
    assert 20 < low / high < 200  # 64 for exactly 1/f
    pulses = generators.poisson_pulses(spark, 200, 0.5).toPandas()
    area = pulses.x.sum() / generators.RATE / (0.1 * np.sqrt(np.pi))
    assert 60 < area < 140 and (pulses.x >= 0).all()
    assert generators.poisson_pulses(spark, 1, 0.0).where("x != 0").count() == 0
