"""Streams over the events file; each must equal its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import packets
from ..operators.aggregates import ordered_mean
from ..session import shared_dir
from ..streaming import live, phases
from .registry import query
from .model_queries import BAND
from .window_queries import S


@query("stream_tumbling", "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    rows = live.drain(live.tumbling(live.event_stream(spark, sf_dir), "1 day", "1 day"), "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean")


@query(
    "stream_gap_detect",
    f"""WITH {S}, g AS (SELECT user_id, event_id % 256 AS seq, lag(event_id % 256) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM s)
SELECT user_id, count(*) AS received, CAST(sum(coalesce(((seq - prev - 1) % 256 + 256) % 256, 0)) AS BIGINT) AS lost FROM g GROUP BY 1""",
)
def stream_gap_detect(spark, sf_dir):
    """The last update of each recording's counts."""
    rows = live.drain(live.gap_counts(live.event_stream(spark, sf_dir)), "update")
    return rows.groupBy("user_id").agg(F.max("received").alias("received"), F.max("lost").alias("lost"))


@query(
    "stream_majority",
    f"""WITH {S}, c AS (SELECT a.user_id, a.event_id, b.event_type, count(*) AS votes FROM s a JOIN s b ON a.user_id = b.user_id AND b.idx BETWEEN a.idx - 4 AND a.idx WHERE a.idx >= 4 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY votes DESC, event_type) AS k FROM c)
SELECT s.user_id, s.event_id, r.event_type AS smoothed FROM s LEFT JOIN r ON r.user_id = s.user_id AND r.event_id = s.event_id AND r.k = 1""",
)
def stream_majority(spark, sf_dir):
    return live.drain(live.majority(live.event_stream(spark, sf_dir)))


@query("stream_filter", f"WITH RECURSIVE {S}, {BAND} SELECT user_id, event_id, round(y, 4) AS filtered FROM r")
def stream_filter(spark, sf_dir):
    b, a = dsp.butterworth(1.0, 20.0, 64.0)
    return live.drain(live.filtered(live.event_stream(spark, sf_dir), b, a)).withColumn("filtered", F.round("filtered", 4))


@query(
    "stream_calibration",
    f"""WITH {S}, k AS (SELECT user_id, avg(value) AS m, sqrt(greatest(avg(value * value) - avg(value) * avg(value), 1e-12)) AS sd FROM s WHERE idx < 20 GROUP BY 1),
x AS (SELECT user_id, event_id, idx, value FROM s WHERE idx >= 20), w AS (SELECT a.user_id, a.idx, a.event_id, sum(b.value * 0.05 * pow(0.95, a.idx - b.idx)) AS acc FROM x a JOIN x b ON a.user_id = b.user_id AND b.idx <= a.idx GROUP BY 1, 2, 3)
SELECT s.user_id, s.event_id, CASE WHEN s.idx < 20 THEN 'calibration' ELSE 'inference' END AS phase, CASE WHEN s.idx >= 20 THEN round(greatest(-3, least(3, (acc + m * pow(0.95, s.idx - 19) - m) / sd)), 4) END AS score FROM s LEFT JOIN w ON w.user_id = s.user_id AND w.idx = s.idx JOIN k ON k.user_id = s.user_id""",
)
def stream_calibration(spark, sf_dir):
    return live.drain(live.calibrated(live.event_stream(spark, sf_dir))).withColumn("score", F.round("score", 4))


@query(
    "stream_emit",
    f"""WITH {S}, r AS (SELECT user_id, idx + 1 AS rn, avg(value) OVER w AS mean, max(value) OVER w - min(value) OVER w AS spread FROM s
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT user_id, rn, round(mean, 6) AS mean, round(spread, 6) AS spread FROM r WHERE rn >= 8 AND rn % 4 = 0""",
)
def stream_emit(spark, sf_dir):
    rows = live.drain(live.emitted(live.event_stream(spark, sf_dir)))
    return rows.select("user_id", "rn", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query(
    "stream_ew_mean",
    f"""WITH {S}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id)
SELECT s.user_id, any_value(n) AS n, round(sum(value * CASE WHEN idx = 0 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - 1 - idx) END), 4) AS ew FROM s JOIN n USING (user_id) GROUP BY s.user_id""",
)
def stream_ew_mean(spark, sf_dir):
    rows = live.drain(live.running(live.event_stream(spark, sf_dir)), "update")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("ew", "n"), 4).alias("ew"))


@query(
    "stream_rebaseline",
    f"""WITH RECURSIVE {S}, w AS (SELECT user_id, idx // 10 AS block, avg(value) AS m FROM s GROUP BY 1, 2 HAVING count(*) = 10),
r(user_id, block, m, base, rebased) AS (SELECT user_id, block, m, m, true FROM w WHERE block = 0 UNION ALL SELECT w.user_id, w.block, w.m, CASE WHEN abs(w.m - r.base) > 0.5 * abs(r.base) THEN w.m ELSE r.base END, abs(w.m - r.base) > 0.5 * abs(r.base) FROM r JOIN w ON w.user_id = r.user_id AND w.block = r.block + 1)
SELECT user_id, block, round(m, 5) AS mean, rebased FROM r""",
)
def stream_rebaseline(spark, sf_dir):
    return live.drain(live.rebaselined(live.event_stream(spark, sf_dir))).withColumn("mean", F.round("mean", 5))


@query(
    "stream_onboarding",
    f"""WITH {S}, w AS (SELECT user_id, idx // 8 AS win, count(*) AS n, max(value) <= 250 AS ok FROM s GROUP BY 1, 2 HAVING count(*) = 8), g AS (SELECT *, sum(CAST(ok AS BIGINT)) OVER (PARTITION BY user_id ORDER BY win) AS good FROM w)
SELECT user_id, win AS "window", ok AS accepted, good >= 3 AS ready FROM g WHERE good - CAST(ok AS BIGINT) < 3""",
)
def stream_onboarding(spark, sf_dir):
    return live.drain(live.onboarded(live.event_stream(spark, sf_dir)))


@query("stream_static_baseline", "WITH b AS (SELECT user_id, floor(avg(value)) AS baseline FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id, event_id, round(value - baseline, 2) AS away FROM events JOIN b USING (user_id)")
def stream_static_baseline(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    baselines = events.where("event_type = 'view'").groupBy("user_id").agg(F.floor(ordered_mean(F.col("value"))).alias("baseline"))
    return live.drain(live.against_baseline(live.event_stream(spark, sf_dir), baselines)).withColumn("away", F.round("away", 2))


@query(
    "stream_quality_gate",
    f"""WITH {S}, r AS (SELECT user_id, idx + 1 AS rn, avg(value) OVER w AS mean, max(value) OVER w - min(value) OVER w AS spread FROM s
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT user_id, rn, round(mean, 6) AS mean FROM r WHERE rn >= 8 AND rn % 4 = 0 AND spread <= 150""",
)
def stream_quality_gate(spark, sf_dir):
    """Windows of a live recording whose spread shows no artifact; the others are dropped before they are scored."""
    rows = live.drain(live.emitted(live.event_stream(spark, sf_dir)).where("spread <= 150"))
    return rows.select("user_id", "rn", F.round("mean", 6).alias("mean"))


EPOCH_SCORING = phases.Scoring(window=32, advance=16, calibration_ms=3_000, idle_ms=20_000, reference=tuple(0.015 * v for v in phases.Scoring.reference), most=0.45, weights=(-900.0, 300.0, 0.0, 200.0, 500.0, 0.0, -250.0, 700.0, 100.0, 600.0), key="label")


@query("stream_live_scores")
def stream_live_scores(spark, sf_dir):
    """Epochs of a label as a live recording: three seconds of calibration, then each window's distances to the refined reference and the running mean."""
    with phases.rocks(spark):
        return live.drain(phases.scored(live.epoch_stream(spark, sf_dir), EPOCH_SCORING, "1 second"))


DAY_MS = 86_400_000
FRAME_SCORING = phases.Scoring(window=8, advance=4, calibration_ms=5 * DAY_MS, idle_ms=30 * DAY_MS, shrink=0.0, ridge=1e-6, reference=tuple(5000.0 * v for v in phases.Scoring.reference), weights=tuple(w / 5000 for w in (-1.5, -0.5, 2.0, 2.5, -0.2, 0.4, 1.8, -0.1, 0.5, 2.2)), intercept=45.0, band=tuple(tuple(c.tolist()) for c in dsp.butterworth(4.0, 40.0, 250.0)), clip=300.0, key="user_id")


def frames_of_events(spark, sf_dir):
    """user_id, ts, event_id and a frame of four channels for each event; every tenth comes short."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e, x = F.col("event_id"), F.round(F.col("value") * 10).cast("long")
    channels = [(x * a + e * b) % 600 - 300 for a, b in ((1, 7), (3, 31), (7, 57), (11, 113))]
    rows = packets.encode_frames(events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"), e % 256, channels, e * 4000, e % 3)
    return rows.select("user_id", "ts", "event_id", F.when(e % 10 == 9, F.substring("frame", 1, 13)).otherwise(F.col("frame")).alias("frame"))


@query("stream_frame_scores")
def stream_frame_scores(spark, sf_dir):
    """Frames decoded, filtered sample by sample, clamped and scored by windows of eight."""
    folder = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    frames_of_events(spark, sf_dir).write.parquet(folder)
    with phases.rocks(spark):  # these files do not follow one another in time, so one batch has them all
        return live.drain(phases.scored(live.frame_stream(spark, folder, per_batch=1_000_000), FRAME_SCORING, "1 day"))
