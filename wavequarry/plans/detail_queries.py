"""Smaller forms beside those of the other modules: full quality index, channel-wise engagement, centre times, joined views, overlapping intervals, 4x4 geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import spd, spectral
from ..operators import manifold as M
from ..operators import mean_tables
from ..operators import windowing as W
from ..sources.tables import epoch_samples, samples, table
from ..streaming import live
from .model_queries import _covariances, _pooled, _stored
from .registry import query
from .session_queries import ew_covariance_sql
from .signal_queries import C, D, _bins, _spectra
from .window_queries import WIN

#: What counts as the amplifier's rail for stored epochs.
RAIL = 0.4


@query(
    "quality_index",
    f"""WITH {D}, r AS (SELECT vec_id, ch, max(abs(x)) >= {RAIL} AS railed FROM e GROUP BY 1, 2), q AS (SELECT vec_id, ch, k, p, p / sum(CASE WHEN k > 0 THEN p END) OVER (PARTITION BY vec_id, ch) AS q FROM f),
s AS (SELECT vec_id, ch, sum(CASE WHEN k >= 5 THEN p END) / (sum(CASE WHEN k BETWEEN 1 AND 3 THEN p END) + 1e-12) AS noise, -sum(CASE WHEN k > 0 AND q > 0 THEN q * log2(q) ELSE 0 END) / log2(8) AS h FROM q GROUP BY 1, 2)
SELECT vec_id, ch, round(CASE WHEN railed THEN 0 ELSE least(greatest(0, least(1, 1 - noise)), greatest(0, least(1, 1 - h))) END, 5) AS sqi FROM s JOIN r USING (vec_id, ch)""",
)
def quality_index(spark, sf_dir):
    """The lesser of 1 - high over low power and 1 - spectral entropy, and 0 where a sample is at the rail."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    at = lambda ks: sum((F.get("power", F.lit(k)) for k in ks[1:]), F.get("power", F.lit(ks[0])))
    index = F.least(clip(1 - at([5, 6, 7, 8]) / (at([1, 2, 3]) + 1e-12)), clip(1 - spectral.entropy(F.col("power"))))
    railed = epoch_samples(spark, sf_dir).groupBy("vec_id", "ch").agg((F.max(F.abs("x")) >= RAIL).alias("railed"))
    return _spectra(spark, sf_dir).join(railed, ["vec_id", "ch"]).select("vec_id", "ch", F.round(F.when(F.col("railed"), 0.0).otherwise(index), 5).alias("sqi"))


@query("engagement_by_channel", f"WITH {D}, r AS (SELECT vec_id, ch, sum(CASE WHEN k BETWEEN 2 AND 3 THEN p END) / (sum(CASE WHEN k = 1 THEN p END) + 1e-12) AS ei FROM f GROUP BY 1, 2) SELECT vec_id, round(avg(ei), 4) AS ei FROM r GROUP BY 1")
def engagement_by_channel(spark, sf_dir):
    """Mean over the channels of each one's own ratio, where ``engagement_index`` has the ratio of their sums."""
    p, k = F.col("p"), F.col("k")
    own = _bins(spark, sf_dir).groupBy("vec_id", "ch").agg((F.sum(F.when(k.between(2, 3), p)) / (F.sum(F.when(k == 1, p)) + 1e-12)).alias("ei"))
    return own.groupBy("vec_id").agg(F.round(F.avg("ei"), 4).alias("ei"))


@query("extreme_ratios", "SELECT event_type, min(value) AS low, max(value) AS high, round(max(value) - min(value), 2) AS spread, round(max(value) / nullif(min(value), 0), 4) AS ratio FROM events GROUP BY 1")
def extreme_ratios(spark, sf_dir):
    """Range and ratio of the extremes of each channel; no ratio to a smallest value of 0."""
    low, high = F.min("value"), F.max("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(low.alias("low"), high.alias("high"), F.round(high - low, 2).alias("spread"), F.round(high / F.nullif(low, F.lit(0.0)), 4).alias("ratio"))


@query("window_centres", f"WITH {WIN} SELECT ws.user_id, win, (min(epoch_us(s.ts)) + max(epoch_us(s.ts))) / 2000000.0::DOUBLE AS centre, round(avg(s.value), 6) AS mean FROM ws JOIN s ON s.user_id = ws.user_id AND s.idx = ws.idx GROUP BY 1, 2")
def window_centres(spark, sf_dir):
    """Sliding windows by the time half way between their first and last sample, in seconds."""
    rows = W.sliding_windows(samples(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), ["user_id"], "idx", 8, 4)
    return rows.groupBy("user_id", "win").agg(((F.min("us") + F.max("us")) / 2000000.0).alias("centre"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "joined_views",
    f"""WITH {C}, b AS (SELECT unnest(range(1, 4)) AS k), f AS (SELECT vec_id, ch, k, pow(sum(x * cos(2 * pi() * k * t / 16)), 2) + pow(sum(x * sin(2 * pi() * k * t / 16)), 2) AS p FROM e, b GROUP BY ALL),
v AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY i, j) - 1 AS place, c AS value FROM c UNION ALL SELECT vec_id, 9 + row_number() OVER (PARTITION BY vec_id ORDER BY ch, k) AS place, p AS value FROM f) SELECT vec_id, place, round(value, 5) AS value FROM v""",
)
def joined_views(spark, sf_dir):
    """Covariance triangle and band powers of an epoch as one vector of 22 features, a row per place."""
    triangle = spd.epoch_moments(epoch_samples(spark, sf_dir)).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "c")))["c"].alias("a"))  # ten cells
    powers = _spectra(spark, sf_dir).groupBy("vec_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("ch", F.slice("power", 2, 3).alias("p"))))["p"]).alias("b"))  # four channels
    both = triangle.join(powers, "vec_id").select("vec_id", F.posexplode(F.concat("a", "b")).alias("place", "value"))
    return both.select("vec_id", F.col("place").cast("long").alias("place"), F.round("value", 5).alias("value"))


@query(
    "interval_overlap",
    "WITH m AS (SELECT event_type AS a, avg(value) AS m, 1.96 * stddev_samp(value) / sqrt(count(*)) AS h FROM events GROUP BY 1) SELECT x.a, y.a AS b, x.m - x.h <= y.m + y.h AND y.m - y.h <= x.m + x.h AS overlap, round(greatest(0, least(x.m + x.h, y.m + y.h) - greatest(x.m - x.h, y.m - y.h)), 5) AS shared FROM m x JOIN m y ON x.a < y.a",
)
def interval_overlap(spark, sf_dir):
    """Whether the 95% intervals of two channels' means overlap, and how much they share; a row per pair of channels."""
    half = 1.96 * F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))
    m = table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg("value") - half).alias("lo"), (F.avg("value") + half).alias("hi"))
    x, y = m.alias("x"), m.alias("y")
    shared = F.least("x.hi", "y.hi") - F.greatest("x.lo", "y.lo")
    return x.join(y, F.col("x.event_type") < F.col("y.event_type")).select(F.col("x.event_type").alias("a"), F.col("y.event_type").alias("b"), (shared >= 0).alias("overlap"), F.round(F.greatest(F.lit(0.0), shared), 5).alias("shared"))


@query("stream_ew_covariance", f"WITH RECURSIVE {ew_covariance_sql()} SELECT user_id, max(idx) + 1 AS n, arg_max(mx, idx) AS mean, arg_max(vx, idx) AS var_now, arg_max(vxy, idx) AS cov_lag, arg_max(vy, idx) AS var_before FROM r GROUP BY 1")
def stream_ew_covariance(spark, sf_dir):
    """Live mean and covariance of each sample and the one before it, as they are after a recording's last sample."""
    rows = live.drain(live.running_covariance(live.event_stream(spark, sf_dir)), "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("n", "mean", "var_now", "cov_lag", "var_before"), "n").alias("l"))
    return last.select("user_id", "l.*")


@query("guarded_means")
def guarded_means(spark, sf_dir):
    """Log determinant of each label's geometric mean over matrices that are positive definite once made symmetric; none of fewer than three."""
    rows = _covariances(spark, sf_dir).select("label", F.when(F.col("vec_id") % 7 == 3, F.transform("c", lambda v: -v)).otherwise(F.col("c")).alias("c"))
    means = mean_tables.geometric_mean_table(mean_tables.usable(rows, "c"), ["label"], "c").where("n >= 3")

    @F.pandas_udf("double")
    def logdet(m: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.slogdet(np.stack(m.to_numpy()).astype(float).reshape(-1, M.N, M.N))[1])

    return means.select("label", "n", "rounds", "converged", logdet("mean").alias("logdet"))


@query("fault_gate4")
def fault_gate4(spark, sf_dir):
    """Epochs whose whole covariance lies further from their label's geometric mean than three deviations beyond the mean distance."""
    rows = _stored(_covariances(spark, sf_dir).select("vec_id", "label", "c"))
    means = mean_tables.geometric_mean_table(rows, ["label"], "c").select("label", "mean")

    @F.pandas_udf("double")
    def distance(c: pd.Series, m: pd.Series) -> pd.Series:
        square = lambda v: np.stack(v.to_numpy()).astype(float).reshape(-1, M.N, M.N)
        return pd.Series(L.distance(square(m), square(c)))

    d = _stored(rows.join(means, "label").select("vec_id", "label", distance("c", "mean").alias("dist")))
    bound = d.groupBy("label").agg((F.avg("dist") + 3 * F.stddev_pop("dist")).alias("bound"))
    return d.join(bound, "label").select("vec_id", "label", "dist", (F.col("dist") > F.col("bound")).alias("fault"))


@query("log_maps4")
def log_maps4(spark, sf_dir):
    """Log-Euclidean triangle of each covariance, and its log map at the pooled mean, brought back to the mean's own scale."""
    rows = _covariances(spark, sf_dir)
    reference = _pooled(rows)
    root, upper = L.root(reference), np.triu_indices(M.N)

    @F.pandas_udf("plain array<double>, mapped array<double>")
    def maps(c: pd.Series) -> pd.DataFrame:
        m = np.stack(c.to_numpy()).astype(float).reshape(-1, M.N, M.N)
        return pd.DataFrame({"plain": list(L.log(m)[:, upper[0], upper[1]]), "mapped": list(L.upper(root @ L.log(L.whiten(m, reference)) @ root))})

    return rows.withColumn("_m", maps("c")).select("vec_id", "label", "_m.plain", "_m.mapped")
