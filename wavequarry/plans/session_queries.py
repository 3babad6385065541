"""Session work: geodesic gates, adaptive weights, confidence, narration by priority, feature tables, reports, stored baselines."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spd
from ..operators import aggregates as A
from ..operators import filters
from ..operators import packets as P
from ..operators import stats as ST
from ..operators import windowing as W
from ..session import shared_dir
from ..sources import sinks
from ..sources.tables import CHANNELS, ENGAGED, epoch_samples, samples, table
from .registry import query
from .signal_queries import C, D, E, P2, _bins, _sides
from .stat_queries import PICK, U, _differences, scattered_sql
from .window_queries import S

PAIRS = [(i, j) for i in range(CHANNELS) for j in range(i + 1, CHANNELS)]


def _labelled(spark, sf_dir):
    """vec_id, label and the left 2x2 covariance a, b, d."""
    rows, (a, b, d), _ = _sides(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return rows.select("vec_id", a.alias("a"), b.alias("b"), d.alias("d")).join(labels, "vec_id")


#: Distance of each epoch's left covariance to its label's mean one.
GEO = f"""{P2}, l AS (SELECT p.vec_id, CAST(v.label AS BIGINT) AS label, pa AS a, pb AS b, pd AS d FROM p JOIN embeddings v USING (vec_id)), m AS (SELECT label, avg(a) AS ma, avg(b) AS mb, avg(d) AS md FROM l GROUP BY 1),
x AS (SELECT vec_id, label, (md * a - 2 * mb * b + ma * d) / (ma * md - mb * mb) AS tr, (a * d - b * b) / (ma * md - mb * mb) AS det FROM l JOIN m USING (label)),
geo AS (SELECT vec_id, label, sqrt(pow(ln(tr / 2 + sqrt(greatest(tr * tr / 4 - det, 0))), 2) + pow(ln(tr / 2 - sqrt(greatest(tr * tr / 4 - det, 0))), 2)) AS dist FROM x)"""


def _geodesic(spark, sf_dir):
    """vec_id, label, dist; there is one mean per label."""
    rows = _labelled(spark, sf_dir)
    means = rows.groupBy("label").agg(*[F.avg(c).alias(f"m{c}") for c in "abd"])
    col = lambda prefix: tuple(F.col(f"{prefix}{c}") for c in "abd")
    return rows.join(means, "label").select("vec_id", "label", spd.distance2(col("m"), col("")).alias("dist"))


@query("geodesic_fault_gate", f"WITH {GEO}, t AS (SELECT label, avg(dist) + 3 * stddev_pop(dist) AS lim FROM geo GROUP BY 1) SELECT vec_id, label, round(dist, 5) AS dist, dist > lim AS fault FROM geo JOIN t USING (label)")
def geodesic_fault_gate(spark, sf_dir):
    """Epochs further from their label's mean than three standard deviations beyond the mean distance are faults."""
    rows = _geodesic(spark, sf_dir)
    bound = rows.groupBy("label").agg((F.avg("dist") + 3 * F.stddev_pop("dist")).alias("bound"))
    return rows.join(bound, "label").select("vec_id", "label", F.round("dist", 5).alias("dist"), (F.col("dist") > F.col("bound")).alias("fault"))


@query("adaptive_alpha", f"WITH {GEO} SELECT label, round(greatest(0.2, least(0.95, 0.2 + 0.6 * stddev_pop(dist) / (avg(dist) + 1e-12))), 5) AS alpha, round(greatest(0.2, least(0.95, 0.3 + 1.8 * stddev_pop(dist))), 5) AS alpha_plain FROM geo GROUP BY 1")
def adaptive_alpha(spark, sf_dir):
    """Blend weights that grow with the dispersion of a label's distances, relative and absolute, within 0.2 and 0.95."""
    sd, clip = F.stddev_pop("dist"), lambda c: F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.95), c)), 5)
    return _geodesic(spark, sf_dir).groupBy("label").agg(clip(0.2 + 0.6 * sd / (F.avg("dist") + 1e-12)).alias("alpha"), clip(0.3 + 1.8 * sd).alias("alpha_plain"))


@query(
    "log_euclid2",
    f"""WITH {P2}, l AS (SELECT *, (pa + pd) / 2 + sqrt((pa - pd) * (pa - pd) / 4 + pb * pb) AS hi, (pa + pd) / 2 - sqrt((pa - pd) * (pa - pd) / 4 + pb * pb) AS lo FROM p), k AS (SELECT *, (ln(hi) - ln(lo)) / (hi - lo) AS sl FROM l)
SELECT vec_id, round(ln(hi) - sl * hi + sl * pa, 5) AS v0, round(sl * pb, 5) AS v1, round(ln(hi) - sl * hi + sl * pd, 5) AS v2 FROM k""",
)
def log_euclid2(spark, sf_dir):
    """Log-Euclidean vector: the triangle of the matrix logarithm, no reference, no weight off the diagonal."""
    rows, p, _ = _sides(spark, sf_dir)
    v0, v1, v2 = spd.log2x2(*p)
    return rows.select("vec_id", F.round(v0, 5).alias("v0"), F.round(v1 / F.sqrt(F.lit(2.0)), 5).alias("v1"), F.round(v2, 5).alias("v2"))


@query("confidence_gate", "SELECT event_id, round(50 + least(10 * abs((value - 50) / 20), 45), 4) AS confidence, 50 + least(10 * abs((value - 50) / 20), 45) >= 75 AS kept FROM events")
def confidence_gate(spark, sf_dir):
    """Confidence from the decision's distance to the boundary; decisions under 75 are not kept."""
    c = P.confidence((F.col("value") - 50) / 20)
    return table(spark, sf_dir, "events").select("event_id", F.round(c, 4).alias("confidence"), (c >= 75).alias("kept"))


@query("bankers_rounding", "SELECT event_id, round_even(floor(value) / 2, 0) AS half_even, round(floor(value) / 2) AS half_up FROM events")
def bankers_rounding(spark, sf_dir):
    """Halves go to the even neighbour, and away from zero."""
    half = F.floor("value").cast("double") / 2
    return table(spark, sf_dir, "events").select("event_id", F.bround(half, 0).alias("half_even"), F.round(half, 0).alias("half_up"))


LINES = ("A clear run.", "All channels are steady.", "The signal holds.")


@query("template_choice", f"SELECT event_id, ['{LINES[0]}', '{LINES[1]}', '{LINES[2]}'][CAST({scattered_sql('event_id')} % 3 AS INT) + 1] AS line FROM events")
def template_choice(spark, sf_dir):
    """One of several sentences, drawn by the row's number so that every run draws the same."""
    nth = ST.scattered(F.col("event_id")) % len(LINES) + 1
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, LINES)), nth.cast("int")).alias("line"))


@query("max_abs_pick", f"WITH {E}, m AS (SELECT vec_id, ch, max(abs(x)) AS peak FROM e GROUP BY 1, 2) SELECT vec_id, arg_max(ch, peak) AS ch, round(max(peak), 6) AS peak FROM m GROUP BY 1")
def max_abs_pick(spark, sf_dir):
    """The channel with the largest absolute value of each epoch, which an artifact would be in."""
    m = epoch_samples(spark, sf_dir).groupBy("vec_id", "ch").agg(F.max(F.abs("x")).alias("peak"))
    return m.groupBy("vec_id").agg(F.max_by("ch", F.struct("peak", -F.col("ch"))).alias("ch"), F.round(F.max("peak"), 6).alias("peak"))


NARRATED = """CASE WHEN clenches >= 2 THEN 'muscle' WHEN blinks >= 10 THEN 'eyes' WHEN state = 'ENGAGED' AND before = 'ENGAGED' AND {past} = 'RESTING' THEN 'onset' WHEN state = 'RESTING' AND before = 'RESTING' AND {past} = 'ENGAGED' THEN 'fading' {rest} END"""


@query(
    "narrate_priority",
    f"""WITH {S}, x AS (SELECT user_id, idx, value, CASE WHEN event_type IN ('click', 'purchase') THEN 'ENGAGED' ELSE 'RESTING' END AS st FROM s), y AS (SELECT *, lag(st, 1) OVER w AS p1, lag(st, 2) OVER w AS p2 FROM x WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
g AS (SELECT user_id, arg_max(st, idx) AS state, arg_max(coalesce(p1, ''), idx) AS before, arg_max(coalesce(p2, ''), idx) AS third, arg_min(st, idx) AS first, 50 + least(10 * abs(avg((value - 50) / 20)), 45) AS conf FROM y GROUP BY 1),
k AS (SELECT user_id, count(*) FILTER (peak > 150 AND v <= 2500) AS blinks, count(*) FILTER (v > 9000) AS clenches FROM (SELECT user_id, idx // 8 AS win, max(value) AS peak, var_pop(value) AS v FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, round(conf, 3) AS confidence, {NARRATED.format(past='first', rest="WHEN state = 'ENGAGED' AND conf > 64 THEN 'deep' WHEN state = 'ENGAGED' THEN 'steady' ELSE 'rest'")} AS offline,
{NARRATED.format(past='third', rest="WHEN state = 'ENGAGED' THEN 'deep' ELSE 'rest'")} AS live FROM g JOIN k USING (user_id)""",
)
def narrate_priority(spark, sf_dir):
    """Which sentence a session gets: muscle noise before eye noise before changes of state; against its first state, and against the third last."""
    rows, v = samples(spark, sf_dir), F.col("value")
    state = F.when(F.col("event_type").isin(*ENGAGED), "ENGAGED").otherwise("RESTING")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = rows.withColumn("st", state)
    rows = rows.withColumn("p1", F.lag("st", 1).over(w)).withColumn("p2", F.lag("st", 2).over(w))
    g = rows.groupBy("user_id").agg(
        F.max_by("st", "idx").alias("state"), F.max_by("p1", "idx").alias("before"), F.max_by("p2", "idx").alias("third"), F.min_by("st", "idx").alias("first"), P.confidence(F.avg((v - 50) / 20)).alias("conf")
    )
    k = rows.groupBy("user_id", F.floor(F.col("idx") / 8)).agg(F.max("value").alias("peak"), F.var_pop("value").alias("v"))
    k = k.groupBy("user_id").agg(F.count_if((F.col("peak") > 150) & (F.col("v") <= 2500)).alias("blinks"), F.count_if(F.col("v") > 9000).alias("clenches"))
    told = lambda past, deep: P.narrate_by_priority(*map(F.col, ("state", "before", past, "blinks", "clenches", "conf")), deep)
    return g.join(k, "user_id").select("user_id", F.round("conf", 3).alias("confidence"), told("first", 64.0).alias("offline"), told("third", None).alias("live"))


@query(
    "session_features",
    f"""WITH {D}, c AS (SELECT a.vec_id, a.ch AS i, b.ch AS j, corr(a.x, b.x) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.t = b.t AND a.ch < b.ch GROUP BY ALL),
w AS (SELECT vec_id, ch, CASE WHEN k = 1 THEN 'alpha' WHEN k <= 3 THEN 'beta' ELSE 'gamma' END AS band, p FROM f WHERE k BETWEEN 1 AND 5)
SELECT vec_id, 'ch' || ch || '_' || band AS feature, round(sum(p), 4) AS value FROM w GROUP BY 1, 2 UNION ALL SELECT vec_id, 'corr' || i || j, round(r, 4) FROM c""",
)
def session_features(spark, sf_dir):
    """Eighteen features of each epoch: power of three bands in four channels, and the channels' six correlations."""
    k = F.col("k")
    band = F.when(k == 1, "alpha").when(k <= 3, "beta").otherwise("gamma")
    power = _bins(spark, sf_dir).where(k.between(1, 5)).groupBy("vec_id", F.concat(F.lit("ch"), "ch", F.lit("_"), band).alias("feature")).agg(F.round(F.sum("p"), 4).alias("value"))
    c = spd.epoch_moments(epoch_samples(spark, sf_dir)).groupBy("vec_id").pivot("i", list(range(CHANNELS)))
    wide = c.agg(*[F.max(F.when(F.col("j") == j, F.col("c"))).alias(f"{j}") for j in range(CHANNELS)])
    at = lambda i, j: F.col(f"`{i}_{j}`")
    pairs = F.array(*[F.struct(F.lit(f"corr{i}{j}").alias("feature"), F.round(at(i, j) / F.sqrt(at(i, i) * at(j, j)), 4).alias("value")) for i, j in PAIRS])
    return power.union(wide.select("vec_id", F.inline(pairs)))


@query(
    "session_evaluation",
    f"""WITH {S}, b AS (SELECT *, event_type IN ('click', 'purchase') AS task, lag(event_id % 256) OVER (PARTITION BY user_id ORDER BY idx) AS prev FROM s),
w AS (SELECT user_id, avg(CASE WHEN peak <= 250 THEN 1.0 ELSE 0.0 END) AS clean FROM (SELECT user_id, idx // 8 AS win, max(value) AS peak FROM s GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT user_id, count(*) AS n, count(*) / ((max(epoch(ts)) - min(epoch(ts))) / 86400) AS per_day, sum(coalesce(((event_id % 256 - prev - 1) % 256 + 256) % 256, 0)) AS lost, avg(CASE WHEN task THEN value END) AS mt, avg(CASE WHEN NOT task THEN value END) AS mr, var_pop(CASE WHEN task THEN value END) AS vt, var_pop(CASE WHEN NOT task THEN value END) AS vr, stddev_pop(value) / avg(value) AS cv, avg(CASE WHEN value > 80 THEN 1.0 ELSE 0.0 END) AS high FROM b GROUP BY 1 HAVING max(ts) > min(ts))
SELECT user_id, n, round(per_day, 4) AS per_day, round(100.0 * lost / (lost + n), 4) AS loss_pct, round((mt - mr) / sqrt((vt + vr) / 2), 4) AS effect, round((mt - mr) / nullif(sqrt(vr), 0), 4) AS task_z, round(cv, 5) AS cv, round(high, 5) AS high_share, round(clean, 5) AS clean_share, round(clean, 5) >= 0.85 AND (mt - mr) / sqrt((vt + vr) / 2) >= 0.3 AS passed FROM m JOIN w USING (user_id)""",
)
def session_evaluation(spark, sf_dir):
    """All figures of each session: rate, losses, effect of the task, spread, high and clean shares, and whether it passes."""
    rows, v, task = W.lost_packets(samples(spark, sf_dir).withColumn("seq", F.col("event_id") % 256), ["user_id"], ["ts", "event_id"], "seq", 256), F.col("value"), F.col("event_type").isin(*ENGAGED)
    clean = rows.groupBy("user_id", F.floor(F.col("idx") / 8)).agg(F.max("value").alias("peak")).groupBy("user_id").agg(F.round(F.avg((F.col("peak") <= 250).cast("double")), 5).alias("clean_share"))
    t = F.col("ts").cast("timestamp").cast("double")
    on, off = F.when(task, v), F.when(~task, v)
    m = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t)).alias("seconds"), F.sum("lost").alias("lost"), A.cohens_d(on, off).alias("d"), (F.avg(on) - F.avg(off)).alias("gap"), F.stddev_pop(off).alias("sd"), A.variation(v).alias("cv"),
        F.avg((v > 80).cast("double")).alias("high"),
    ).where("seconds > 0")
    out = {"per_day": (F.col("n") / (F.col("seconds") / 86400), 4), "loss_pct": (100.0 * F.col("lost") / (F.col("lost") + F.col("n")), 4), "effect": (F.col("d"), 4), "task_z": (F.col("gap") / F.nullif("sd", F.lit(0.0)), 4), "cv": (F.col("cv"), 5), "high_share": (F.col("high"), 5)}
    done = m.join(clean, "user_id")
    return done.select("user_id", "n", *(F.round(c, k).alias(name) for name, (c, k) in out.items()), "clean_share", ((F.col("clean_share") >= 0.85) & (F.col("d") >= 0.3)).alias("passed"))


@query(
    "bootstrap_median_ci",
    f"""WITH {U}, b AS (SELECT unnest(range(0, 500)) AS b), p AS (SELECT b, {PICK} AS pick FROM v, b), m AS (SELECT p.b, median(v.d) AS m FROM p JOIN v ON v.i = p.pick GROUP BY 1)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.05), 6) AS lo, round(quantile_cont(m, 0.95), 6) AS hi FROM m""",
)
def bootstrap_median_ci(spark, sf_dir):
    """Interval of any statistic of resamples, here of the median."""
    found = ST.bootstrap(ST.numbered(_differences(spark, sf_dir), ["user_id"]), ["d"], 500, F.median("d"), np.median)
    p = lambda q: F.round(F.percentile("statistic", F.lit(q)), 6)
    return found.agg(F.round(F.avg("statistic"), 6).alias("mean"), p(0.05).alias("lo"), p(0.95).alias("hi"))


@query("baseline_archive", f"WITH {C}, m AS (SELECT label, i, j, avg(c) AS c FROM c GROUP BY 1, 2, 3) SELECT label, (SELECT count(*) FROM embeddings v WHERE v.label = m.label) AS n, round(sum(CASE WHEN i = j THEN c END), 6) AS trace, round(sum(CASE WHEN i <> j THEN c ELSE 0 END), 6) AS off_diagonal FROM m GROUP BY 1")
def baseline_archive(spark, sf_dir):
    """Mean covariances by state, stored with their counts and read back."""
    m = spd.epoch_moments(epoch_samples(spark, sf_dir)).groupBy("label", "i", "j").agg(F.avg("c").alias("c"), F.count(F.lit(1)).alias("n"))
    packed = m.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("i", "j").alias("at"), "c"))).alias("cells"), F.max("n").alias("n"))  # ten cells a label
    matrix = F.array(*[F.element_at("cells", f"{min(i, j)}{max(i, j)}") for i in range(CHANNELS) for j in range(CHANNELS)])
    path = f"{shared_dir(spark)}/baselines-{uuid.uuid4().hex}"
    sinks.write_baselines(packed.select("label", matrix.alias("matrix"), "n"), path, "label")
    stored = sinks.read_baselines(spark, path)
    cell = lambda i, j: F.get("matrix", F.lit(CHANNELS * i + j))
    trace, off = sum((cell(i, i) for i in range(1, CHANNELS)), cell(0, 0)), sum((cell(i, j) for i, j in PAIRS[1:]), cell(*PAIRS[0]))
    return stored.select("label", "n", F.round(trace, 6).alias("trace"), F.round(off, 6).alias("off_diagonal"))


@query(
    "ledger_upsert",
    "WITH e AS (SELECT user_id, ts < TIMESTAMP '2024-01-15' AS early, value FROM events), a AS (SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM e WHERE early GROUP BY 1), b AS (SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM e WHERE NOT early AND user_id % 3 <> 0 GROUP BY 1) SELECT user_id, coalesce(b.n, a.n) AS n, coalesce(b.total, a.total) AS total FROM a FULL JOIN b USING (user_id)",
)
def ledger_upsert(spark, sf_dir):
    """A ledger of sessions written once, then rows of the later weeks put in: known users are updated, new ones inserted."""
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    sums = lambda rows: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    events = table(spark, sf_dir, "events")
    ledger = sinks.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", ["user_id"])
    ledger.upsert(sums(events.where(early)))
    ledger.upsert(sums(events.where(~early & (F.col("user_id") % 3 != 0))))
    return ledger.read()


@query(
    "score_log_parse",
    """WITH g AS (SELECT l_suppkey AS subject, CAST(count(*) % 100 AS BIGINT) AS a, CAST(sum(l_linenumber) % 100 AS BIGINT) AS b, CAST(max(l_linenumber) AS BIGINT) AS c, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS d FROM lineitem GROUP BY 1)
SELECT CAST(subject AS BIGINT) AS subject, a + 0.5::DOUBLE AS rf_raw, b::DOUBLE AS tangent, c + 0.25::DOUBLE AS svm_raw, d::DOUBLE AS svm_gated FROM g""",
)
def score_log_parse(spark, sf_dir):
    """Log lines with a subject's four scores, between other lines, read back by pattern."""
    groups = table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    g = groups.agg((F.count(F.lit(1)) % 100).alias("a"), (F.sum("l_linenumber") % 100).alias("b"), F.max("l_linenumber").cast("long").alias("c"), F.count_distinct("l_returnflag").alias("d"))
    line = F.format_string("S%02d fold | RF Raw: %d.5%% | TSA: %d.0%% || SVM Raw: %d.25%% | Gated SVM: %d.0%%", "l_suppkey", "a", "b", "c", "d")
    lines = g.select(F.explode(F.array(F.lit("Fold   1 |"), line, F.lit("S1 fold | RF Raw: n/a"))).alias("line"))
    return P.parse_score_lines(lines, "line")


@query(
    "linspace_times",
    f"WITH {S}, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT s.user_id, idx, round(1000 + idx * (n / 250.0::DOUBLE) / greatest(n - 1, 1), 6) AS stamp FROM s JOIN n USING (user_id)",
)
def linspace_times(spark, sf_dir):
    """Evenly spaced times of a recording's n samples, from 1000 to 1000 + n / 250 seconds, both included."""
    rows = samples(spark, sf_dir).select("user_id", "idx")
    sizes = rows.groupBy("user_id").agg((F.max("idx") + 1).alias("n"))
    stamp = 1000 + F.col("idx") * (F.col("n") / 250) / F.greatest(F.col("n") - 1, F.lit(1))
    return rows.join(sizes, "user_id").select("user_id", "idx", F.round(stamp, 6).alias("stamp"))


def ew_covariance_sql() -> str:
    """SQL of r: each sample's running mean and covariance with the one before it, in the order of operations that the fold has."""
    return f"""{S}, z AS (SELECT user_id, idx, value AS x, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY idx), 0) AS y FROM s),
r(user_id, idx, mx, my, vx, vxy, vy) AS (SELECT user_id, idx, x, y, 0.1::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE FROM z WHERE idx = 0
UNION ALL SELECT z.user_id, z.idx, mx + 0.1 * (x - mx), my + 0.1 * (y - my), 0.9 * vx + 0.1 * ((x - mx) * (x - mx)) + 1e-6, 0.9 * vxy + 0.1 * ((x - mx) * (y - my)), 0.9 * vy + 0.1 * ((y - my) * (y - my)) + 1e-6 FROM r JOIN z ON z.user_id = r.user_id AND z.idx = r.idx + 1)"""


@query("ew_covariance", f"WITH RECURSIVE {ew_covariance_sql()} SELECT user_id, idx, mx AS mean, vx AS var_now, vxy AS cov_lag, vy AS var_before FROM r")
def ew_covariance(spark, sf_dir):
    """Exponential mean and covariance of each sample and the one before it, unrounded: samples of two digits make means that lie on halves."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy("user_id").orderBy("idx")), F.lit(0.0))
    rows = samples(spark, sf_dir).select("user_id", "idx", "value", before.alias("before"))
    found = filters.running_moments(rows, ["user_id"], ["idx"], ["value", "before"])
    at = lambda c, k, name: F.get(c, F.lit(k)).alias(name)
    return found.select("user_id", "idx", at("mean", 0, "mean"), at("cov", 0, "var_now"), at("cov", 1, "cov_lag"), at("cov", 3, "var_before"))
