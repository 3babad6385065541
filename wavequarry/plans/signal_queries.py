"""Joins, aggregates, spectra and covariances over events and embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spd, spectral
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators.windowing import sliding_windows
from ..sources.tables import CHANNELS, EPOCH_SAMPLES, channel, epoch_arrays, epoch_samples, samples, table
from .registry import query
from .window_queries import S

E = "e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, p // 4 AS t, p % 4 AS ch, x FROM (SELECT vec_id, label, unnest(range(0, 64)) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))"
C = f"{E}, c AS (SELECT a.vec_id, a.label, a.ch AS i, b.ch AS j, covar_pop(a.x, b.x) AS c FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.t = b.t AND a.ch <= b.ch GROUP BY ALL)"


@query(
    "annotation_slice",
    f"""WITH {S}, a AS (SELECT user_id, event_id AS annotation, idx AS onset, idx + 5 AS stop FROM s WHERE event_type = 'error'),
j AS (SELECT a.user_id, a.annotation, s.value FROM a JOIN s ON s.user_id = a.user_id AND s.idx >= a.onset AND s.idx < a.stop)
SELECT user_id, annotation, count(*) AS n, round(avg(value), 6) AS mean FROM j GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def annotation_slice(spark, sf_dir):
    """Five samples from each error event on; shorter trials are dropped."""
    rows = samples(spark, sf_dir)
    marks = rows.where("event_type = 'error'").select("user_id", F.col("event_id").alias("annotation"), F.col("idx").alias("onset"), (F.col("idx") + 5).alias("stop"))
    found = J.interval_slice(rows, marks, ["user_id"], "idx", "onset", "stop", 5)
    return found.groupBy("user_id", "annotation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).where("n >= 3")



@query(
    "paired_anti_report",
    """WITH a AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'signup' AND value > 60 GROUP BY 1), b AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1)
SELECT 'paired' AS part, count(*) AS n FROM a JOIN b USING (user_id) UNION ALL SELECT 'left_only', count(*) FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT 'right_only', count(*) FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""",
)
def paired_anti_report(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value > 60")
    a, b = (events.where(F.col("event_type") == k).select("user_id").distinct() for k in ("signup", "error"))
    parts = zip(("paired", "left_only", "right_only"), J.paired(a, b, "user_id"))
    found = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, rows in parts]
    return found[0].union(found[1]).union(found[2])


@query("channel_pair_corr", f"WITH {E} SELECT a.vec_id, a.ch AS i, b.ch AS j, round(corr(a.x, b.x), 6) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.t = b.t AND a.ch < b.ch GROUP BY ALL")
def channel_pair_corr(spark, sf_dir):
    rows = epoch_samples(spark, sf_dir)
    other = rows.select("vec_id", "t", F.col("ch").alias("j"), F.col("x").alias("y"))
    return rows.join(other, ["vec_id", "t"]).where("ch < j").groupBy("vec_id", F.col("ch").alias("i"), "j").agg(F.round(F.corr("x", "y"), 6).alias("r"))


@query(
    "zip_pairs",
    """WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'view'), b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'click')
SELECT user_id, i, a.value AS lo, b.value AS hi FROM a JOIN b USING (user_id, i)""",
)
def zip_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    found = J.zipped(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), ["user_id"], ["ts", "event_id"])
    return found.select("user_id", "i", F.col("a_value").alias("lo"), F.col("b_value").alias("hi"))


@query("grid_cross", "SELECT c.c, g.g AS gamma, w.w AS class_weight FROM (SELECT unnest([0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0]) AS c) c, (SELECT unnest([0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]) AS g) g, (SELECT unnest(['none', 'balanced']) AS w) w")
def grid_cross(spark, sf_dir):
    """The 98 settings of the kernel grid."""
    one = spark.range(1)
    cs = one.select(F.explode(F.array(*map(F.lit, [0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0]))).alias("c"))
    gammas = one.select(F.explode(F.array(*map(F.lit, [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]))).alias("gamma"))
    return cs.crossJoin(gammas).crossJoin(one.select(F.explode(F.array(F.lit("none"), F.lit("balanced"))).alias("class_weight")))


@query("rms_by_channel", "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def rms_by_channel(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(A.rms(v), 6).alias("rms"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.round(F.max(v) - F.min(v), 6).alias("spread"))


@query(
    "mad_gate",
    """WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY 1), d AS (SELECT user_id, abs(value - med) AS away FROM events JOIN m USING (user_id)), k AS (SELECT user_id, median(away) AS mad FROM d GROUP BY 1)
SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN 0.6745 * away / (mad + 1e-12) <= 2.5 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM d JOIN k USING (user_id) GROUP BY 1""",
)
def mad_gate(spark, sf_dir):
    rows = A.mad_scores(table(spark, sf_dir, "events").select("user_id", "value"), ["user_id"], "value")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("robust_z") <= 2.5).alias("kept"))


@query(
    "kurtosis_pick",
    f"WITH {E}, k AS (SELECT vec_id, ch, round(kurtosis_pop(x), 6) AS k FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(k) DESC, ch) AS n FROM k) SELECT vec_id, ch, k FROM r WHERE n = 1",
)
def kurtosis_pick(spark, sf_dir):
    """The channel with the largest absolute kurtosis, the first of several."""
    k = epoch_samples(spark, sf_dir).groupBy("vec_id", "ch").agg(F.round(F.kurtosis("x"), 6).alias("k"))
    return k.groupBy("vec_id").agg(F.max_by(F.struct("ch", "k"), F.struct(F.abs("k"), -F.col("ch"))).alias("best")).select("vec_id", "best.ch", "best.k")


@query("percentile_band", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, round(quantile_cont(value, 0.5), 6) AS mid FROM events GROUP BY 1")
def percentile_band(spark, sf_dir):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.025).alias("lo"), p(0.975).alias("hi"), p(0.5).alias("mid"))


@query("cov4_pop", f"WITH {C} SELECT vec_id, i, j, round(c, 6) AS c FROM c")
def cov4_pop(spark, sf_dir):
    return spd.epoch_moments(epoch_samples(spark, sf_dir)).select("vec_id", "i", "j", F.round("c", 6).alias("c"))


@query("cov4_samp_reg", f"WITH {C} SELECT vec_id, i, j, round(c * 16 / 15 + CASE WHEN i = j THEN 1e-6 ELSE 0 END, 6) AS c FROM c")
def cov4_samp_reg(spark, sf_dir):
    """Sample covariances with 1e-6 on the diagonal."""
    c = F.col("c") * 16 / 15 + F.when(F.col("i") == F.col("j"), 1e-6).otherwise(0.0)
    return spd.epoch_moments(epoch_samples(spark, sf_dir)).select("vec_id", "i", "j", F.round(c, 6).alias("c"))


@query("cov4_shrink15", f"WITH {C}, m AS (SELECT vec_id, sum(c) * 16 / 15 / 4 AS mu FROM c WHERE i = j GROUP BY 1) SELECT vec_id, i, j, round(0.85 * c * 16 / 15 + CASE WHEN i = j THEN 0.15 * mu ELSE 0 END, 6) AS c FROM c JOIN m USING (vec_id)")
def cov4_shrink15(spark, sf_dir):
    """Shrinkage of 0.15 towards the mean variance."""
    rows = spd.epoch_moments(epoch_samples(spark, sf_dir))
    mu = rows.where("i = j").groupBy("vec_id").agg((F.sum("c") * 16 / 15 / 4).alias("mu"))
    c = 0.85 * F.col("c") * 16 / 15 + F.when(F.col("i") == F.col("j"), 0.15 * F.col("mu")).otherwise(0.0)
    return rows.join(mu, "vec_id").select("vec_id", "i", "j", F.round(c, 6).alias("c"))


@query(
    "ledoit_wolf",
    f"""WITH {C}, z AS (SELECT vec_id, ch, t, x - avg(x) OVER (PARTITION BY vec_id, ch) AS z FROM e), q AS (SELECT vec_id, t, sum(z * z) AS q FROM z GROUP BY 1, 2), f AS (SELECT vec_id, sum(q * q) AS fourth FROM q GROUP BY 1),
s AS (SELECT vec_id, sum(CASE WHEN i = j THEN c * c ELSE 2 * c * c END) AS s2, sum(CASE WHEN i = j THEN c ELSE 0 END) / 4 AS mu FROM c GROUP BY 1),
b AS (SELECT vec_id, mu, (fourth / 16 - s2) / (4 * 16) AS beta, (s2 - 4 * mu * mu) / 4 AS delta FROM f JOIN s USING (vec_id))
SELECT vec_id, round(mu, 6) AS mu, round(CASE WHEN least(beta, delta) = 0 THEN 0 ELSE least(beta, delta) / delta END, 6) AS shrinkage FROM b""",
)
def ledoit_wolf(spark, sf_dir):
    """Ledoit-Wolf shrinkage and its target, from second and fourth moments."""
    rows = epoch_samples(spark, sf_dir)
    means = rows.groupBy("vec_id", "ch").agg(F.avg("x").alias("m"))
    z = F.col("x") - F.col("m")
    squares = rows.join(means, ["vec_id", "ch"]).groupBy("vec_id", "t").agg(F.sum(z * z).alias("q"))
    fourth = squares.groupBy("vec_id").agg(F.sum(F.col("q") * F.col("q")).alias("fourth"))
    c, same = F.col("c"), F.col("i") == F.col("j")
    second = spd.epoch_moments(rows).groupBy("vec_id").agg(F.sum(F.when(same, c * c).otherwise(2 * c * c)).alias("s2"), (F.sum(F.when(same, c).otherwise(0.0)) / 4).alias("mu"))
    both = fourth.join(second, "vec_id").withColumn("beta", (F.col("fourth") / 16 - F.col("s2")) / 64).withColumn("delta", (F.col("s2") - 4 * F.col("mu") * F.col("mu")) / 4)
    least = F.least("beta", "delta")
    return both.select("vec_id", F.round("mu", 6).alias("mu"), F.round(F.when(least == 0, 0.0).otherwise(least / F.col("delta")), 6).alias("shrinkage"))


@query("uppertri_raw", f"WITH {C} SELECT vec_id, i * 4 - i * (i - 1) // 2 + j - i AS k, round(c, 6) AS v FROM c")
def uppertri_raw(spark, sf_dir):
    i, j = F.col("i"), F.col("j")
    return spd.epoch_moments(epoch_samples(spark, sf_dir)).select("vec_id", (i * 4 - F.floor(i * (i - 1) / 2) + j - i).alias("k"), F.round("c", 6).alias("v"))


@query("uppertri_sqrt2", f"WITH {C} SELECT vec_id, i * 4 - i * (i - 1) // 2 + j - i AS k, round(c * CASE WHEN i = j THEN 1 ELSE sqrt(2) END, 6) AS v FROM c")
def uppertri_sqrt2(spark, sf_dir):
    i, j = F.col("i"), F.col("j")
    weighted = F.col("c") * F.when(i == j, 1.0).otherwise(math.sqrt(2))
    return spd.epoch_moments(epoch_samples(spark, sf_dir)).select("vec_id", (i * 4 - F.floor(i * (i - 1) / 2) + j - i).alias("k"), F.round(weighted, 6).alias("v"))


P2 = f"{C}, p AS (SELECT vec_id, max(CASE WHEN i = 0 AND j = 0 THEN c END) * 16 / 15 + 1e-6 AS pa, max(CASE WHEN i = 0 AND j = 2 THEN c END) * 16 / 15 AS pb, max(CASE WHEN i = 2 AND j = 2 THEN c END) * 16 / 15 + 1e-6 AS pd, max(CASE WHEN i = 1 AND j = 1 THEN c END) * 16 / 15 + 1e-6 AS qa, max(CASE WHEN i = 1 AND j = 3 THEN c END) * 16 / 15 AS qb, max(CASE WHEN i = 3 AND j = 3 THEN c END) * 16 / 15 + 1e-6 AS qd FROM c GROUP BY 1), g AS (SELECT vec_id, (pd * qa - 2 * pb * qb + pa * qd) / (pa * pd - pb * pb) AS tr, (qa * qd - qb * qb) / (pa * pd - pb * pb) AS det FROM p)"


def _sides(spark, sf_dir):
    """Left (channels 0, 2) and right (1, 3) sample covariances as (a, b, d), straight from the epoch array."""
    c = lambda i, j: spd.covariance(F.col("x"), i, j, EPOCH_SAMPLES, 1) + (1e-6 if i == j else 0.0)
    cells = {"pa": c(0, 0), "pb": c(0, 2), "pd": c(2, 2), "qa": c(1, 1), "qb": c(1, 3), "qd": c(3, 3)}
    rows = epoch_arrays(spark, sf_dir).select("vec_id", *(v.alias(k) for k, v in cells.items()))
    return rows, tuple(map(F.col, ("pa", "pb", "pd"))), tuple(map(F.col, ("qa", "qb", "qd")))


@query("spd2_distance", f"WITH {P2} SELECT vec_id, round(sqrt(pow(ln(tr / 2 + sqrt(greatest(tr * tr / 4 - det, 0))), 2) + pow(ln(tr / 2 - sqrt(greatest(tr * tr / 4 - det, 0))), 2)), 5) AS d FROM g")
def spd2_distance(spark, sf_dir):
    rows, p, q = _sides(spark, sf_dir)
    return rows.select("vec_id", F.round(spd.distance2(p, q), 5).alias("d"))


@query("spd2_logdet_div", f"WITH {P2} SELECT vec_id, round(greatest(tr - ln(det) - 2, 0), 5) AS d FROM g")
def spd2_logdet_div(spark, sf_dir):
    rows, p, q = _sides(spark, sf_dir)
    return rows.select("vec_id", F.round(spd.logdet_divergence2(p, q), 5).alias("d"))


@query(
    "spd2_tangent",
    f"""WITH {P2}, l AS (SELECT *, (pa + pd) / 2 + sqrt((pa - pd) * (pa - pd) / 4 + pb * pb) AS hi, (pa + pd) / 2 - sqrt((pa - pd) * (pa - pd) / 4 + pb * pb) AS lo FROM p), k AS (SELECT *, (ln(hi) - ln(lo)) / (hi - lo) AS sl FROM l)
SELECT vec_id, round(ln(hi) - sl * hi + sl * pa, 5) AS v0, round(sqrt(2) * sl * pb, 5) AS v1, round(ln(hi) - sl * hi + sl * pd, 5) AS v2 FROM k""",
)
def spd2_tangent(spark, sf_dir):
    rows, p, _ = _sides(spark, sf_dir)
    return rows.select("vec_id", *(F.round(v, 5).alias(f"v{k}") for k, v in enumerate(spd.log2x2(*p))))


D = f"{E}, b AS (SELECT unnest(range(0, 9)) AS k), f AS (SELECT vec_id, label, ch, k, pow(sum(x * cos(2 * pi() * k * t / 16)), 2) + pow(sum(x * sin(2 * pi() * k * t / 16)), 2) AS p FROM e, b GROUP BY ALL)"


def _spectra(spark, sf_dir):
    """vec_id, label, ch, power: array of 9."""
    rows = epoch_arrays(spark, sf_dir).select("vec_id", "label", F.posexplode(F.array(*[channel(F.col("x"), c) for c in range(CHANNELS)])).alias("ch", "s"))
    return rows.select("vec_id", "label", F.col("ch").cast("long").alias("ch"), spectral.powers(F.col("s")).alias("power"))


def _bins(spark, sf_dir):
    return _spectra(spark, sf_dir).select("vec_id", "label", "ch", F.posexplode("power").alias("k", "p")).withColumn("k", F.col("k").cast("long"))


@query("dft_psd", f"WITH {D} SELECT vec_id, ch, k, round(p, 4) AS p FROM f")
def dft_psd(spark, sf_dir):
    return _bins(spark, sf_dir).select("vec_id", "ch", "k", F.round("p", 4).alias("p"))


B = f"{D}, bands AS (SELECT * FROM (VALUES ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 45.0)) v(band, lo, hi))"


@query("band_power", f"WITH {B} SELECT vec_id, ch, band, count(*) AS bins, round(sum(p), 4) AS power FROM f JOIN bands ON k * 8 >= lo AND k * 8 < hi GROUP BY 1, 2, 3")
def band_power(spark, sf_dir):
    rows = J.band_join(_bins(spark, sf_dir).withColumn("freq", F.col("k") * 8.0), spectral.bands(spark), "freq")
    return rows.groupBy("vec_id", "ch", "band").agg(F.count(F.lit(1)).alias("bins"), F.round(F.sum("p"), 4).alias("power"))


@query("band_range_join", f"WITH {B} SELECT band, k, count(*) AS n FROM f JOIN bands ON k * 8 >= lo AND k * 8 < hi GROUP BY 1, 2")
def band_range_join(spark, sf_dir):
    return J.band_join(_bins(spark, sf_dir).withColumn("freq", F.col("k") * 8.0), spectral.bands(spark), "freq").groupBy("band", "k").agg(F.count(F.lit(1)).alias("n"))


@query("engagement_index", f"WITH {D} SELECT vec_id, round(sum(CASE WHEN k BETWEEN 2 AND 3 THEN p END) / (sum(CASE WHEN k = 1 THEN p END) + 1e-12), 4) AS ei FROM f GROUP BY 1")
def engagement_index(spark, sf_dir):
    """Beta power over alpha and theta power (the theta band holds no bin here)."""
    p, k = F.col("p"), F.col("k")
    return _bins(spark, sf_dir).groupBy("vec_id").agg(F.round(F.sum(F.when(k.between(2, 3), p)) / (F.sum(F.when(k == 1, p)) + 1e-12), 4).alias("ei"))


@query("spectral_entropy", f"WITH {D}, s AS (SELECT vec_id, ch, k, p / sum(p) OVER (PARTITION BY vec_id, ch) AS q FROM f WHERE k > 0) SELECT vec_id, ch, round(-sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / log2(8), 5) AS h FROM s GROUP BY 1, 2")
def spectral_entropy(spark, sf_dir):
    return _spectra(spark, sf_dir).select("vec_id", "ch", F.round(spectral.entropy(F.col("power")), 5).alias("h"))


@query("one_over_f", f"WITH {D}, m AS (SELECT vec_id, k, avg(p) AS p FROM f WHERE k BETWEEN 1 AND 5 GROUP BY 1, 2) SELECT vec_id, round(regr_slope(log10(p + 1e-30), log10(k * 8 + 1e-9)), 5) AS slope, round(regr_r2(log10(p + 1e-30), log10(k * 8 + 1e-9)), 5) AS r2 FROM m GROUP BY 1")
def one_over_f(spark, sf_dir):
    """Log-log slope of the mean spectrum from 8 to 40 Hz."""
    m = _bins(spark, sf_dir).where("k between 1 and 5").groupBy("vec_id", "k").agg(F.avg("p").alias("p"))
    x, y = F.log10(F.col("k") * 8 + 1e-9), F.log10(F.col("p") + 1e-30)
    return m.groupBy("vec_id").agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_r2(y, x), 5).alias("r2"))


@query("alpha_peak", f"WITH {D}, m AS (SELECT vec_id, k, avg(p) AS p FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS n FROM m WHERE k BETWEEN 1 AND 4) SELECT vec_id, k * 8.0 AS peak_hz, round(p, 4) AS p FROM r WHERE n = 1")
def alpha_peak(spark, sf_dir):
    m = _bins(spark, sf_dir).where("k between 1 and 4").groupBy("vec_id", "k").agg(F.avg("p").alias("p"))
    best = F.max_by(F.struct("k", "p"), F.struct("p", -F.col("k"))).alias("b")
    return m.groupBy("vec_id").agg(best).select("vec_id", (F.col("b.k") * 8.0).cast("decimal(21,1)").cast("double").alias("peak_hz"), F.round("b.p", 4).alias("p"))


@query(
    "sqi_badge",
    f"""WITH {D}, s AS (SELECT vec_id, ch, sum(CASE WHEN k >= 5 THEN p END) / (sum(CASE WHEN k BETWEEN 1 AND 4 THEN p END) + 1e-12) AS ratio FROM f GROUP BY 1, 2), q AS (SELECT vec_id, ch, greatest(0.0, least(1.0, 1 - ratio)) AS sqi FROM s)
SELECT vec_id, ch, round(sqi, 5) AS sqi, CASE WHEN sqi >= 0.7 THEN 'good' WHEN sqi >= 0.3 THEN 'fair' ELSE 'poor' END AS badge FROM q""",
)
def sqi_badge(spark, sf_dir):
    """Signal quality 1 - high / low frequency power, clipped, with a badge."""
    p, k = F.col("p"), F.col("k")
    s = _bins(spark, sf_dir).groupBy("vec_id", "ch").agg((F.sum(F.when(k >= 5, p)) / (F.sum(F.when(k.between(1, 4), p)) + 1e-12)).alias("ratio"))
    sqi = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("ratio")))
    badge = F.when(sqi >= 0.7, "good").when(sqi >= 0.3, "fair").otherwise("poor")
    return s.select("vec_id", "ch", F.round(sqi, 5).alias("sqi"), badge.alias("badge"))


@query("erd_change", f"WITH {D}, m AS (SELECT ch, k, avg(CASE WHEN label % 2 = 0 THEN p END) AS rest, avg(CASE WHEN label % 2 = 1 THEN p END) AS task FROM f GROUP BY 1, 2) SELECT ch, k, round(100 * (task - rest) / rest, 3) AS change_pct FROM m")
def erd_change(spark, sf_dir):
    """Change of power in percent, odd labels (task) against even ones (rest)."""
    p, odd = F.col("p"), F.col("label") % 2 == 1
    m = _bins(spark, sf_dir).groupBy("ch", "k").agg(F.avg(F.when(~odd, p)).alias("rest"), F.avg(F.when(odd, p)).alias("task"))
    return m.select("ch", "k", F.round(100 * (F.col("task") - F.col("rest")) / F.col("rest"), 3).alias("change_pct"))


@query("snr_corr", f"WITH {E}, m AS (SELECT label, t, ch, avg(x) AS clean FROM e GROUP BY 1, 2, 3) SELECT vec_id, round(10 * log10(sum(clean * clean) / sum((x - clean) * (x - clean))), 4) AS snr_db, round(corr(clean, x), 5) AS r FROM e JOIN m USING (label, t, ch) GROUP BY 1")
def snr_corr(spark, sf_dir):
    """Each epoch against its label's mean epoch."""
    rows = epoch_samples(spark, sf_dir)
    clean = rows.groupBy("label", "t", "ch").agg(F.avg("x").alias("clean"))
    c, x = F.col("clean"), F.col("x")
    return rows.join(clean, ["label", "t", "ch"]).groupBy("vec_id").agg(F.round(A.snr_db(c, x), 4).alias("snr_db"), F.round(F.corr(c, x), 5).alias("r"))


@query("dc_removed", f"WITH {E}, m AS (SELECT ch, avg(x) AS m FROM e GROUP BY 1) SELECT vec_id, ch, round(avg(x - m), 6) AS mean FROM e JOIN m USING (ch) GROUP BY 1, 2")
def dc_removed(spark, sf_dir):
    """Channel means after taking off the pooled channel mean; the pool is one row per channel."""
    rows = epoch_samples(spark, sf_dir)
    pooled = rows.groupBy("ch").agg(F.avg("x").alias("m"))
    return rows.join(F.broadcast(pooled), "ch").groupBy("vec_id", "ch").agg(F.round(F.avg(F.col("x") - F.col("m")), 6).alias("mean"))


@query(
    "attenuation_integrity",
    f"""WITH {E}, f AS (SELECT vec_id, ch, t, x, avg(x) OVER (PARTITION BY vec_id, ch ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y FROM e), c AS (SELECT vec_id, ch, var_pop(x) AS vx, var_pop(y) AS vy, corr(x, y) AS r FROM f GROUP BY 1, 2)
SELECT vec_id, round(10 * log10(sum(vx) / sum(vy)), 4) AS attenuation_db, round(avg(r), 5) AS integrity FROM c GROUP BY 1""",
)
def attenuation_integrity(spark, sf_dir):
    """What a three-sample mean takes off the power, and how far the channels still look like themselves."""
    w = Window.partitionBy("vec_id", "ch").orderBy("t").rowsBetween(-1, 1)
    f = epoch_samples(spark, sf_dir).withColumn("y", F.avg("x").over(w))
    c = f.groupBy("vec_id", "ch").agg(F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.corr("x", "y").alias("r"))
    return c.groupBy("vec_id").agg(F.round(10 * F.log10(F.sum("vx") / F.sum("vy")), 4).alias("attenuation_db"), F.round(F.avg("r"), 5).alias("integrity"))


@query(
    "welch_psd",
    f"""WITH {S}, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT n.user_id, k.k AS win FROM n, LATERAL (SELECT unnest(range(0, n.n // 8 + 1)) AS k) k WHERE k.k * 8 < n.n - 16),
x AS (SELECT w.user_id, w.win, s.idx - w.win * 8 AS t, s.value - avg(s.value) OVER (PARTITION BY w.user_id, w.win) AS v FROM w JOIN s ON s.user_id = w.user_id AND s.idx >= w.win * 8 AND s.idx < w.win * 8 + 16),
h AS (SELECT user_id, win, t, v * (0.5 - 0.5 * cos(2 * pi() * t / 16)) AS v FROM x), b AS (SELECT unnest(range(0, 9)) AS k),
f AS (SELECT user_id, win, k, (pow(sum(v * cos(2 * pi() * k * t / 16)), 2) + pow(sum(v * sin(2 * pi() * k * t / 16)), 2)) / (64 * 6.0) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END AS p FROM h, b GROUP BY 1, 2, 3)
SELECT user_id, k, k * 4.0 AS hz, round(avg(p), 4) AS density FROM f GROUP BY 1, 2""",
)
def welch_psd(spark, sf_dir):
    """Power density of recordings: Hann windows of 16 samples, half overlapping, each without its mean, at 64 Hz."""
    rows = sliding_windows(samples(spark, sf_dir), ["user_id"], "idx", 16, 8)
    x = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"])
    win = rows.groupBy("user_id", "win").agg(x.alias("x"), F.avg("value").alias("m"))
    hann = F.array(*[F.lit(0.5 - 0.5 * math.cos(2 * math.pi * t / 16)) for t in range(16)])
    tapered = win.select("user_id", F.zip_with("x", hann, lambda v, h: (v - F.col("m")) * h).alias("x"))
    bins = tapered.select("user_id", F.posexplode(spectral.powers(F.col("x"))).alias("k", "p"))
    p = F.col("p") / (64 * 6.0) * F.when(F.col("k").isin(0, 8), 1.0).otherwise(2.0)
    return bins.groupBy("user_id", F.col("k").cast("long").alias("k")).agg(F.round(F.avg(p), 4).alias("density")).withColumn("hz", F.col("k") * 4.0).select("user_id", "k", F.col("hz").cast("double").alias("hz"), "density")
