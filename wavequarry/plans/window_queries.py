"""Ledger, count windows, time windows and packet counters over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windowing as W
from ..operators.aggregates import exact_mean
from ..sources.tables import samples, sessions, table, telemetry
from .registry import query

S = "s AS (SELECT user_id, event_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
WIN = f"""{S}, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
w AS (SELECT n.user_id, k.k AS win FROM n, LATERAL (SELECT unnest(range(0, n.n // 4 + 1)) AS k) k WHERE k.k * 4 < n.n - 8),
ws AS (SELECT w.user_id, w.win, s.idx, s.event_type, s.value FROM w JOIN s ON s.user_id = w.user_id AND s.idx >= w.win * 4 AND s.idx < w.win * 4 + 8)"""


@query(
    "ledger_trend",
    """
WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('click', 'purchase') THEN 'ENGAGED' ELSE 'RESTING' END AS decoded_state, value FROM events),
s AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_type, (ts, event_id)) AS activity_name FROM events GROUP BY 1, 2)
SELECT activity_name, round(avg(value), 4) AS avg_stability, count(*) AS n_rows FROM t JOIN s USING (user_id, day) WHERE decoded_state = 'ENGAGED' GROUP BY activity_name
""",
)
def ledger_trend(spark, sf_dir):
    """Mean stability and rows per activity, of engaged telemetry."""
    rows = telemetry(spark, sf_dir).where("decoded_state = 'ENGAGED'").join(sessions(spark, sf_dir), ["user_id", "day"])
    return rows.groupBy("activity_name").agg(F.round(F.avg("stability_score"), 4).alias("avg_stability"), F.count(F.lit(1)).alias("n_rows"))


@query("window_count_slide", f"WITH {WIN} SELECT user_id, win, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(sqrt(avg(value * value)), 6) AS rms FROM ws GROUP BY user_id, win")
def window_count_slide(spark, sf_dir):
    rows = W.sliding_windows(samples(spark, sf_dir), ["user_id"], "idx", 8, 4)
    v = F.col("value")
    return rows.groupBy("user_id", "win").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.round(F.sqrt(F.avg(v * v)), 6).alias("rms"))


@query(
    "window_emit_every_k",
    f"""WITH {S}, r AS (SELECT user_id, idx + 1 AS rn, avg(value) OVER w AS mean, max(value) OVER w - min(value) OVER w AS spread FROM s
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT user_id, rn, round(mean, 6) AS mean, round(spread, 6) AS spread FROM r WHERE rn >= 8 AND rn % 4 = 0""",
)
def window_emit_every_k(spark, sf_dir):
    rows = W.emit_every(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 8, 4, mean=F.avg("value"), low=F.min("value"), high=F.max("value"))
    return rows.select("user_id", "rn", F.round("mean", 6).alias("mean"), F.round(F.col("high") - F.col("low"), 6).alias("spread"))


@query(
    "window_majority_label",
    f"""WITH {WIN}, c AS (SELECT user_id, win, event_type, count(*) AS votes FROM ws GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, win ORDER BY votes DESC, event_type) AS k FROM c)
SELECT user_id, win, event_type AS majority, votes FROM r WHERE k = 1""",
)
def window_majority_label(spark, sf_dir):
    return W.majority(W.sliding_windows(samples(spark, sf_dir), ["user_id"], "idx", 8, 4), ["user_id", "win"], "event_type")


@query(
    "majority_smoother",
    f"""WITH {S}, c AS (SELECT a.user_id, a.idx, b.event_type, count(*) AS votes FROM s a JOIN s b ON a.user_id = b.user_id AND b.idx BETWEEN a.idx - 4 AND a.idx WHERE a.idx >= 4 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, idx ORDER BY votes DESC, event_type) AS k FROM c)
SELECT s.user_id, s.idx, r.event_type AS smoothed FROM s LEFT JOIN r ON r.user_id = s.user_id AND r.idx = s.idx AND r.k = 1""",
)
def majority_smoother(spark, sf_dir):
    return W.smooth_majority(samples(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type", 5).select("user_id", "idx", "smoothed")


TRAIL = f"WITH {S}, r AS (SELECT user_id, idx, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"


def _trail(spark, sf_dir):
    w = W.trailing(["user_id"], ["ts", "event_id"], 5)
    return samples(spark, sf_dir).withColumn("m", F.avg("value").over(w)).withColumn("sd", F.stddev_pop("value").over(w))


@query("rolling5_zscore", f"{TRAIL} SELECT user_id, idx, CASE WHEN sd > 1e-6 THEN round((value - m) / sd, 4) ELSE 0.0 END AS z FROM r")
def rolling5_zscore(spark, sf_dir):
    return _trail(spark, sf_dir).select("user_id", "idx", F.when(F.col("sd") > 1e-6, F.round((F.col("value") - F.col("m")) / F.col("sd"), 4)).otherwise(F.lit(0.0)).alias("z"))


@query("rolling5_dispersion", f"{TRAIL} SELECT user_id, idx, round(sd / (abs(m) + 1e-9), 4) AS dispersion, round(value / (1 + sd), 4) AS scaled FROM r")
def rolling5_dispersion(spark, sf_dir):
    return _trail(spark, sf_dir).select("user_id", "idx", F.round(F.col("sd") / (F.abs("m") + 1e-9), 4).alias("dispersion"), F.round(F.col("value") / (1 + F.col("sd")), 4).alias("scaled"))


@query("tumbling_time", "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean FROM events GROUP BY 1, 2")
def tumbling_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), exact_mean("value", 2).alias("mean"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean")


@query(
    "sliding_time",
    """WITH x AS (SELECT CAST(date_trunc('day', ts) AS DATE) - k.k AS day, value FROM events, (SELECT unnest([0, 1]) AS k) k)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean FROM x GROUP BY 1""",
)
def sliding_time(spark, sf_dir):
    """Windows of two days, one starting every day."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 days", "1 day")).agg(F.count(F.lit(1)).alias("n"), exact_mean("value", 2).alias("mean"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "mean")


@query(
    "sessionize",
    """WITH g AS (SELECT user_id, ts, value, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)), 0) > 21600 AS fresh FROM events),
x AS (SELECT *, sum(CAST(fresh AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(max(epoch(ts)) - min(epoch(ts)), 3) AS seconds, round(sum(value), 2) AS total FROM x GROUP BY user_id, session""",
)
def sessionize(spark, sf_dir):
    rows = W.sessions_by_gap(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600)
    t = F.col("ts").cast("timestamp").cast("double")
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(t) - F.min(t), 3).alias("seconds"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "gap_detect_mod256",
    f"""WITH {S}, g AS (SELECT user_id, idx, event_id % 256 AS seq, lag(event_id % 256) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM s),
l AS (SELECT user_id, coalesce(((seq - prev - 1) % 256 + 256) % 256, 0) AS lost FROM g)
SELECT user_id, count(*) AS received, CAST(sum(lost) AS BIGINT) AS lost, round(100.0 * sum(lost) / (sum(lost) + count(*)), 4) AS loss_pct FROM l GROUP BY user_id""",
)
def gap_detect_mod256(spark, sf_dir):
    rows = W.lost_packets(samples(spark, sf_dir).withColumn("seq", F.col("event_id") % 256), ["user_id"], ["ts", "event_id"], "seq", 256)
    lost, n = F.sum("lost"), F.count(F.lit(1))
    return rows.groupBy("user_id").agg(n.alias("received"), lost.alias("lost"), F.round(100.0 * lost / (lost + n), 4).alias("loss_pct"))


@query(
    "overlap_add_merge",
    f"""WITH {WIN}, v AS (SELECT user_id, idx, win, value + win AS v FROM ws), c AS (SELECT user_id, idx, list(v ORDER BY win) AS l FROM v GROUP BY user_id, idx)
SELECT user_id, idx, round(CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN 0.5 * l[1] + 0.5 * l[2] ELSE 0.5 * (0.5 * l[1] + 0.5 * l[2]) + 0.5 * l[3] END, 4) AS merged FROM c""",
)
def overlap_add_merge(spark, sf_dir):
    """Overlap-add of windows whose values are shifted by the window number."""
    rows = W.sliding_windows(samples(spark, sf_dir), ["user_id"], "idx", 8, 4).withColumn("v", F.col("value") + F.col("win"))
    return W.overlap_add(rows, ["user_id"], "idx", "win", "v").withColumn("merged", F.round("merged", 4))


@query(
    "ew_mean",
    f"""WITH {S}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY user_id)
SELECT s.user_id, any_value(n) AS n, round(sum(value * CASE WHEN idx = 0 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - 1 - idx) END), 4) AS ew FROM s JOIN n USING (user_id) GROUP BY s.user_id""",
)
def ew_mean(spark, sf_dir):
    return W.exponential_mean(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 0.1).withColumn("ew", F.round("ew", 4))


@query(
    "topk_latest",
    "WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, k, event_id, value FROM r WHERE k <= 5",
)
def topk_latest(spark, sf_dir):
    """The last five rows of every recording."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w).cast("long")).where("k <= 5").select("user_id", "k", "event_id", "value")


@query(
    "second_extremes",
    "WITH m AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS m FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY m DESC, user_id) AS hi, row_number() OVER (ORDER BY m, user_id) AS lo FROM m) SELECT CASE WHEN hi = 2 THEN 'second_largest' ELSE 'second_smallest' END AS what, user_id, m FROM r WHERE hi = 2 OR lo = 2",
)
def second_extremes(spark, sf_dir):
    """The second largest and second smallest recording by mean: the top two each way, without a global window."""
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(exact_mean("value", 2).alias("m"))
    high = means.orderBy(F.desc("m"), "user_id").limit(2).orderBy("m", F.desc("user_id")).limit(1)
    low = means.orderBy("m", "user_id").limit(2).orderBy(F.desc("m"), F.desc("user_id")).limit(1)
    return high.select(F.lit("second_largest").alias("what"), "user_id", "m").union(low.select(F.lit("second_smallest").alias("what"), "user_id", "m"))
