"""Gates, encodings, fusion weights, set operations and baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spd
from ..operators import aggregates as A
from ..sources.tables import ENGAGED, epoch_arrays, epoch_samples, samples, table
from .registry import query
from .signal_queries import C, D, E, _bins
from .window_queries import S


@query("amplitude_gate", f"WITH {E} SELECT vec_id, round(max(abs(x)), 6) AS peak, max(abs(x)) <= 0.3 AS kept FROM e GROUP BY 1")
def amplitude_gate(spark, sf_dir):
    """Epochs whose largest absolute value passes the bound."""
    peak = F.array_max(F.transform("x", lambda v: F.abs(v)))
    return epoch_arrays(spark, sf_dir).select("vec_id", F.round(peak, 6).alias("peak"), (peak <= 0.3).alias("kept"))


@query("hard_clip", "SELECT event_id, greatest(-100.0, least(100.0, value - 50)) AS v FROM events")
def hard_clip(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("value") - 50)).alias("v"))


@query("label_encode", "SELECT event_type, CASE WHEN event_type IN ('click', 'purchase') THEN 100 ELSE 0 END AS target, count(*) AS n FROM events GROUP BY 1, 2")
def label_encode(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.when(F.col("event_type").isin(*ENGAGED), 100).otherwise(0).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("channel_names", "SELECT DISTINCT event_type AS raw, upper(trim(event_type, '.')) AS name, lpad(CAST(length(event_type) AS VARCHAR), 3, '0') AS size, repeat('#', CAST(length(event_type) AS INT)) AS bar FROM events WHERE upper(trim(event_type, '.')) IN ('CLICK', 'VIEW', 'ERROR')")
def channel_names(spark, sf_dir):
    """Channels matched by name, whatever their case and dots."""
    name = F.upper(F.trim(F.col("event_type"), F.lit(".")))
    rows = table(spark, sf_dir, "events").select("event_type").distinct().where(name.isin("CLICK", "VIEW", "ERROR"))
    return rows.select(F.col("event_type").alias("raw"), name.alias("name"), F.lpad(F.length("event_type").cast("string"), 3, "0").alias("size"), F.repeat(F.lit("#"), F.length("event_type")).alias("bar"))


@query("channel_subset", f"WITH {E} SELECT vec_id, ch IN (0, 2) AS is_left, round(sum(x) * 1e6, 1) AS microvolts FROM e GROUP BY 1, 2")
def channel_subset(spark, sf_dir):
    """Left (0, 2) and right (1, 3) channels, in other units."""
    return epoch_samples(spark, sf_dir).groupBy("vec_id", F.col("ch").isin(0, 2).alias("is_left")).agg(F.round(F.sum("x") * 1e6, 1).alias("microvolts"))


@query("index_shares", "SELECT user_id, count(*) AS n, count(*) FILTER (value > 80) AS high, count(*) FILTER (value < 20) AS low, round(avg(CASE WHEN value > 80 THEN 1.0 ELSE 0.0 END), 6) AS high_share FROM events GROUP BY 1")
def index_shares(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(v > 80).alias("high"), F.count_if(v < 20).alias("low"), F.round(F.avg((v > 80).cast("double")), 6).alias("high_share"))


@query("minimum_trials", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 15")
def minimum_trials(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")


@query("non_stationary", f"WITH {S}, h AS (SELECT user_id, avg(CASE WHEN idx % 2 = 0 THEN value END) AS a, stddev_pop(value) AS sd, avg(value) AS m FROM s GROUP BY 1) SELECT user_id, round(sd / m, 5) AS spread, sd / m > 1.0 AS force_raw, round(greatest(0.2, least(0.95, 0.2 + 0.6 * sd / m)), 5) AS alpha FROM h")
def non_stationary(spark, sf_dir):
    """Unsteady recordings are marked; the blend weight grows with the spread."""
    s = samples(spark, sf_dir).groupBy("user_id").agg((F.stddev_pop("value") / F.avg("value")).alias("r"))
    return s.select("user_id", F.round("r", 5).alias("spread"), (F.col("r") > 1.0).alias("force_raw"), F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.95), 0.2 + 0.6 * F.col("r"))), 5).alias("alpha"))


@query(
    "softmax_fusion",
    f"WITH {E}, d AS (SELECT vec_id, stddev_pop(x) AS g, stddev_pop(CASE WHEN ch IN (0, 2) THEN x END) AS l, stddev_pop(CASE WHEN ch IN (1, 3) THEN x END) AS r FROM e GROUP BY 1) SELECT vec_id, round(exp(-g) / (exp(-g) + exp(-l) + exp(-r)), 6) AS w_global, round(exp(-l) / (exp(-g) + exp(-l) + exp(-r)), 6) AS w_left, round(exp(-r) / (exp(-g) + exp(-l) + exp(-r)), 6) AS w_right FROM d",
)
def softmax_fusion(spark, sf_dir):
    """Weights of the global, left and right scales: softmax of the negative dispersion."""
    x, left = F.col("x"), F.col("ch").isin(0, 2)
    d = epoch_samples(spark, sf_dir).groupBy("vec_id").agg(F.exp(-F.stddev_pop(x)).alias("g"), F.exp(-F.stddev_pop(F.when(left, x))).alias("l"), F.exp(-F.stddev_pop(F.when(~left, x))).alias("r"))
    total = F.col("g") + F.col("l") + F.col("r")
    return d.select("vec_id", *(F.round(F.col(c) / total, 6).alias(n) for c, n in (("g", "w_global"), ("l", "w_left"), ("r", "w_right"))))


@query("standardised_norm", f"WITH {E}, m AS (SELECT t, ch, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY 1, 2) SELECT vec_id, round(sqrt(sum(pow((x - m) / sd, 2))), 5) AS norm FROM e JOIN m USING (t, ch) GROUP BY 1")
def standardised_norm(spark, sf_dir):
    """Norm of each epoch after standardising every element over all epochs; 64 rows of means are broadcast."""
    rows = epoch_samples(spark, sf_dir)
    m = rows.groupBy("t", "ch").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = (F.col("x") - F.col("m")) / F.col("sd")
    return rows.join(F.broadcast(m), ["t", "ch"]).groupBy("vec_id").agg(F.round(F.sqrt(F.sum(z * z)), 5).alias("norm"))


@query("log_variance", f"WITH {E} SELECT vec_id, ch, round(ln(var_pop(x) + 1e-12), 5) AS v FROM e GROUP BY 1, 2")
def log_variance(spark, sf_dir):
    return epoch_samples(spark, sf_dir).groupBy("vec_id", "ch").agg(F.round(F.log(F.var_pop("x") + 1e-12), 5).alias("v"))


@query("variance_matching", f"WITH {E}, b AS (SELECT var_pop(CASE WHEN ch < 2 THEN x END) AS va, var_pop(CASE WHEN ch >= 2 THEN x END) AS vb FROM e) SELECT vec_id, round(sum(CASE WHEN ch < 2 THEN x ELSE x * sqrt(va / vb) END), 6) AS s FROM e, b GROUP BY 1")
def variance_matching(spark, sf_dir):
    """The second block of channels scaled to the first one's variance; the scale is one row."""
    rows, x, first = epoch_samples(spark, sf_dir), F.col("x"), F.col("ch") < 2
    scale = rows.agg(F.sqrt(F.var_pop(F.when(first, x)) / F.var_pop(F.when(~first, x))).alias("k"))
    return rows.crossJoin(F.broadcast(scale)).groupBy("vec_id").agg(F.round(F.sum(F.when(first, x).otherwise(x * F.col("k"))), 6).alias("s"))


@query("spd_validity", f"WITH {C}, m AS (SELECT vec_id, min(CASE WHEN i = j THEN c END) AS least FROM c GROUP BY 1) SELECT least > 0 AS valid, count(*) AS n FROM m GROUP BY 1")
def spd_validity(spark, sf_dir):
    """Epochs whose variances are all positive."""
    m = spd.epoch_moments(epoch_samples(spark, sf_dir)).where("i = j").groupBy("vec_id").agg(F.min("c").alias("least"))
    return m.groupBy((F.col("least") > 0).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("matrix_mean", f"WITH {C} SELECT label, i, j, round(avg(c), 6) AS c FROM c GROUP BY 1, 2, 3")
def matrix_mean(spark, sf_dir):
    """Arithmetic mean covariance of each label."""
    return spd.epoch_moments(epoch_samples(spark, sf_dir)).groupBy("label", "i", "j").agg(F.round(F.avg("c"), 6).alias("c"))


@query("beta_alpha_ratio", f"WITH {D}, m AS (SELECT vec_id, sqrt(sum(CASE WHEN k = 1 THEN p END)) AS alpha, sqrt(sum(CASE WHEN k BETWEEN 2 AND 3 THEN p END)) AS beta FROM f GROUP BY 1) SELECT vec_id, round(alpha / (beta + 1e-9), 5) AS ratio, alpha / (beta + 1e-9) < 0.85 AS engaged FROM m")
def beta_alpha_ratio(spark, sf_dir):
    k, p = F.col("k"), F.col("p")
    m = _bins(spark, sf_dir).groupBy("vec_id").agg((F.sqrt(F.sum(F.when(k == 1, p))) / (F.sqrt(F.sum(F.when(k.between(2, 3), p))) + 1e-9)).alias("r"))
    return m.select("vec_id", F.round("r", 5).alias("ratio"), (F.col("r") < 0.85).alias("engaged"))


@query("blink_clench", f"WITH {S}, w AS (SELECT user_id, idx // 8 AS win, max(value) AS peak, var_pop(value) AS v FROM s GROUP BY 1, 2) SELECT user_id, count(*) FILTER (peak > 150 AND v <= 2500) AS blinks, count(*) FILTER (v > 2500) AS clenches FROM w GROUP BY 1")
def blink_clench(spark, sf_dir):
    """Windows of eight samples: a variance on the bound depends on the order of its sum, which is the samples' order."""
    ordered = F.filter(F.array_sort(F.collect_list(F.struct("idx", "value")))["value"], lambda v: v.isNotNull())
    w = samples(spark, sf_dir).groupBy("user_id", F.floor(F.col("idx") / 8)).agg(F.max("value").alias("peak"), A.running_variance(ordered).alias("v"))
    return w.groupBy("user_id").agg(F.count_if((F.col("peak") > 150) & (F.col("v") <= 2500)).alias("blinks"), F.count_if(F.col("v") > 2500).alias("clenches"))


@query("baseline_drift", "WITH d AS (SELECT user_id, avg(CASE WHEN ts < TIMESTAMP '2024-01-15' THEN value END) AS a, stddev_pop(CASE WHEN ts < TIMESTAMP '2024-01-15' THEN value END) AS sd, avg(CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value END) AS b FROM events GROUP BY 1) SELECT user_id, round((b - a) / sd, 5) AS z, abs((b - a) / sd) > 0.5 AS recalibrate FROM d WHERE sd > 1e-6 AND b IS NOT NULL")
def baseline_drift(spark, sf_dir):
    """Later samples against the first weeks' mean, in standard deviations."""
    early, v = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), F.col("value")
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(early, v)).alias("a"), F.stddev_pop(F.when(early, v)).alias("sd"), F.avg(F.when(~early, v)).alias("b")).where("sd > 1e-6 and b is not null")
    z = (F.col("b") - F.col("a")) / F.col("sd")
    return d.select("user_id", F.round(z, 5).alias("z"), (F.abs(z) > 0.5).alias("recalibrate"))


@query("baseline_or_default", "WITH b AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'signup' GROUP BY 1 HAVING count(*) >= 12) SELECT u.user_id, coalesce(round(m, 6), 50.0) AS baseline FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b USING (user_id)")
def baseline_or_default(spark, sf_dir):
    """A stored baseline where there is one, else the default."""
    events = table(spark, sf_dir, "events")
    b = events.where("event_type = 'signup'").groupBy("user_id").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 12")
    return events.select("user_id").distinct().join(b, "user_id", "left").select("user_id", F.coalesce(F.round("m", 6), F.lit(50.0)).alias("baseline"))


@query(
    "set_operations",
    "WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 200), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 100) SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
)
def set_operations(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    a, b = events.where("value > 200").select("user_id").distinct(), events.where("event_type = 'error' and value > 100").select("user_id").distinct()
    found = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "except": a.subtract(b)}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, df in found.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query("channels_present", "SELECT user_id, count(DISTINCT event_type) AS channels FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1")
def channels_present(spark, sf_dir):
    """Recordings that have the error channel, and how many channels they have."""
    events = table(spark, sf_dir, "events")
    return events.join(events.where("event_type = 'error'").select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.count_distinct("event_type").alias("channels"))


@query("state_pair_gaps", "WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1) SELECT a.event_type AS a, b.event_type AS b, round(abs(a.m - b.m) / sqrt((a.sd * a.sd + b.sd * b.sd) / 2), 5) AS d FROM m a JOIN m b ON a.event_type < b.event_type")
def state_pair_gaps(spark, sf_dir):
    """Standardised gaps between all pairs of states; there is one row per state."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    a, b = m.select(F.col("event_type").alias("a"), F.col("m").alias("ma"), F.col("sd").alias("sa")), m.select(F.col("event_type").alias("b"), F.col("m").alias("mb"), F.col("sd").alias("sb"))
    d = F.abs(F.col("ma") - F.col("mb")) / F.sqrt((F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / 2)
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(d, 5).alias("d"))


@query("time_offsets", f"WITH {S} SELECT user_id, idx, round(idx * 0.2, 4) AS offset_seconds, CAST(floor(epoch(ts)) AS BIGINT) AS unix, (CAST(floor(epoch(ts)) AS BIGINT) * 1000000) % 4294967296 AS hw_time FROM s")
def time_offsets(spark, sf_dir):
    """Offsets by sample number, whole seconds, and a 32-bit microsecond clock that wraps."""
    unix = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return samples(spark, sf_dir).select("user_id", "idx", F.round(F.col("idx") * 0.2, 4).alias("offset_seconds"), unix.alias("unix"), ((unix * 1000000) % 4294967296).alias("hw_time"))


@query("effective_rate", "SELECT user_id, count(*) AS n, round(count(*) / ((max(epoch(ts)) - min(epoch(ts))) / 86400), 4) AS per_day FROM events GROUP BY 1 HAVING max(ts) > min(ts)")
def effective_rate(spark, sf_dir):
    t = F.col("ts").cast("timestamp").cast("double")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t)).alias("seconds")).where("seconds > 0")
    return e.select("user_id", "n", F.round(F.col("n") / (F.col("seconds") / 86400), 4).alias("per_day"))


@query("variation_by_channel", "SELECT event_type, round(CASE WHEN avg(value) <> 0 THEN stddev_pop(value) / avg(value) ELSE 0 END, 6) AS cv FROM events GROUP BY 1")
def variation_by_channel(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(A.variation(F.col("value")), 6).alias("cv"))


@query("conversation_states", "WITH r AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) AS turns, count(*) FILTER (before IS NOT NULL AND before <> role) AS changes FROM r GROUP BY 1")
def conversation_states(spark, sf_dir):
    """State changes along an ordered history."""
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("before") != F.col("role")).alias("changes"))
