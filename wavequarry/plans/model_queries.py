"""Dense algebra, filters, source separation and models over embeddings and events."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import aggregates as A
from ..operators import filters, kernel, mean_tables, models, polynomial
from ..operators import manifold as M
from ..operators import separation as BS
from ..session import shared_dir
from ..sources import generators
from ..sources.tables import CHANNELS, EPOCH_SAMPLES, channel, epoch_arrays, epoch_samples, samples
from .registry import query
from .signal_queries import C, E
from .window_queries import S

#: Sampling rate that recordings are read at.
RATE = 64.0


def _covariances(spark, sf_dir):
    """vec_id, label, x, c."""
    return epoch_arrays(spark, sf_dir).withColumn("c", M.epoch_covariance("x"))


def _stored(df):
    """``df`` written in the shared folder and read again: what the rounds of a mean read each time."""
    path = f"{shared_dir(df.sparkSession)}/covariances-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pooled(df) -> np.ndarray:
    return M.arithmetic_means(df.withColumn("one", F.lit(1)), "one", "c")[1]


@query("spd4_distance")
def spd4_distance(spark, sf_dir):
    """Distance of each epoch's covariance to the arithmetic mean."""
    rows = _covariances(spark, sf_dir)
    return rows.select("vec_id", "label", F.round(M.distance_to(F.col("c"), _pooled(rows)), 5).alias("d"))


@query("spd4_tangent")
def spd4_tangent(spark, sf_dir):
    """Tangent vector of each epoch's covariance at the arithmetic mean."""
    rows = _covariances(spark, sf_dir)
    return rows.select("vec_id", "label", F.transform(M.tangent_at(F.col("c"), _pooled(rows)), lambda v: F.round(v, 5)).alias("v"))


def recursion(b, a, start=None, keys: tuple[str, ...] = ("user_id",)) -> str:
    """SQL of a recursive filter over s by ``keys``: r has y of each sample and the filter's state, from rest or from ``start``."""
    n = len(b) - 1
    start = [0.0] * n if start is None else [float(z) for z in start]
    state = ", ".join(f"z{k}" for k in range(1, n + 1))
    plus = lambda z: f"{z!r} + " if z else ""
    y0 = f"({plus(start[0])}{float(b[0])!r} * value)"
    y = f"({float(b[0])!r} * s.value + r.z1)"
    first = ", ".join(f"{plus(start[k]) if k < n else ''}{float(b[k])!r} * value - {float(a[k])!r} * {y0}" for k in range(1, n + 1))
    after = ", ".join(f"{f'r.z{k + 1} + ' if k < n else ''}{float(b[k])!r} * s.value - {float(a[k])!r} * {y}" for k in range(1, n + 1))
    of, on = ", ".join(keys), " AND ".join(f"s.{k} = r.{k}" for k in keys)
    return f"r({of}, idx, event_id, y, {state}) AS (SELECT {of}, idx, event_id, {y0}, {first} FROM s WHERE idx = 0 UNION ALL SELECT {', '.join(f's.{k}' for k in keys)}, s.idx, s.event_id, {y}, {after} FROM r JOIN s ON {on} AND s.idx = r.idx + 1)"


BAND = recursion(*dsp.butterworth(1.0, 20.0, RATE))


def _cells(names: str) -> str:
    return ", ".join(f"max(CASE WHEN i = {a} AND j = {b} THEN c * 16 / 15 + {1e-6 if a == b else 0} END) AS {names}{a}{b}" for a in range(4) for b in range(a, 4))


def _reduced(k: int) -> str:
    return ", ".join(f"m{a}{b} - m{k}{a} * m{k}{b} / m{k}{k} AS m{a}{b}" for a in range(k + 1, 4) for b in range(a, 4))


@query(
    "spd4_frechet",
    f"""WITH {C}, m0 AS (SELECT vec_id, label, {_cells('m')} FROM c GROUP BY 1, 2), m1 AS (SELECT vec_id, label, ln(m00) AS l, {_reduced(0)} FROM m0), m2 AS (SELECT vec_id, label, l + ln(m11) AS l, {_reduced(1)} FROM m1), m3 AS (SELECT vec_id, label, l + ln(m22) AS l, {_reduced(2)} FROM m2)
SELECT label, count(*) AS n, round(avg(l + ln(m33)), 4) AS logdet FROM m3 GROUP BY 1""",
)
def spd4_frechet(spark, sf_dir):
    """Log determinant of each label's geometric mean, which is the mean log determinant."""
    rows = _stored(_covariances(spark, sf_dir).select("label", "c"))
    table = {k: float(np.linalg.slogdet(m)[1]) for k, m in M.settled_means(rows, "label", "c").items()}
    logdet = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.lit(None).cast("map<long,double>")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("logdet", F.round(logdet[F.col("label")], 4))


@query("spd4_swelling")
def spd4_swelling(spark, sf_dir):
    """Per label: how far the arithmetic mean swells against the geometric one."""
    rows = _stored(_covariances(spark, sf_dir).select("label", "c"))
    arithmetic, geometric = M.arithmetic_means(rows, "label", "c"), M.geometric_means(rows, "label", "c")
    found = [(k, *M.swelling(arithmetic[k], m), r, bool(ok)) for k, (m, r, ok) in sorted(geometric.items())]
    return spark.createDataFrame(found, "label long, det_ratio double, eigen_ratio double, distance double, rounds int, converged boolean")


@query("transport_align")
def transport_align(spark, sf_dir):
    """Covariances carried from each label's mean to the pooled one: the mean distance that is left, before and after."""
    rows = _stored(_covariances(spark, sf_dir).select("vec_id", "label", "c"))
    target = _pooled(rows)
    means = M.settled_means(rows, "label", "c")
    after = M.transport(rows, "label", "c", means, target)
    d = lambda df, name: df.groupBy("label").agg(F.round(F.avg(M.distance_to(F.col("c"), target)), 5).alias(name))
    return d(rows, "before").join(d(after, "after"), "label")


@query("geodesic_ema")
def geodesic_ema(spark, sf_dir):
    """Running geodesic mean of each label's covariances, in order of the epochs."""
    return M.running_mean(_covariances(spark, sf_dir).select("label", "vec_id", "c"), ["label"], ["vec_id"], "c", 0.05)


@query("adaptive_mean")
def adaptive_mean(spark, sf_dir):
    """The same with a rate that grows with the distance."""
    return M.running_mean(_covariances(spark, sf_dir).select("label", "vec_id", "c"), ["label"], ["vec_id"], "c", 0.02, adaptive=2.0)


@query("causal_iir", f"WITH RECURSIVE {S}, {BAND} SELECT user_id, idx, round(y, 4) AS filtered FROM r")
def causal_iir(spark, sf_dir):
    """Causal band-pass of every recording, state carried sample by sample."""
    b, a = dsp.butterworth(1.0, 20.0, RATE)
    return filters.causal(samples(spark, sf_dir).select("user_id", "idx", "value"), ["user_id"], ["idx"], "value", b, a).withColumn("filtered", F.round("filtered", 4))


def _clean(spark, sf_dir, stages):
    return filters.zero_phase_chain(samples(spark, sf_dir), ["user_id"], ["idx"], "value", stages).withColumn("filtered", F.round("filtered", 4))


@query("filtfilt_bandpass")
def filtfilt_bandpass(spark, sf_dir):
    """Notch at 16 Hz, then band-pass, both without phase shift."""
    width = 16.0 / 30 / 2
    return _clean(spark, sf_dir, [dsp.butterworth_sections(16.0 - width, 16.0 + width, RATE, 2, stop=True), dsp.butterworth_sections(1.0, 20.0, RATE, 2)])


#: Rate at which both mains' frequencies can be heard.
FULL_RATE = 250.0


@query("cleaning_chain")
def cleaning_chain(spark, sf_dir):
    """The whole chain without phase shift: notches at 50 and 60 Hz, a thirtieth wide, then 1 to 30 Hz."""
    return _clean(spark, sf_dir, dsp.cleaning_chain(FULL_RATE))


@query("wearable_chain")
def wearable_chain(spark, sf_dir):
    """The same with notches of one hertz to each side, at a rate that leaves out the one at 60 Hz."""
    return _clean(spark, sf_dir, dsp.cleaning_chain(110.0, quality=None))


TASK_BAND = dsp.butterworth(4.0, 40.0, FULL_RATE)


@query("clamped_filter", f"WITH RECURSIVE {S}, {recursion(*TASK_BAND, start=dsp.steady_state(*TASK_BAND))} SELECT user_id, idx, round(greatest(-300, least(300, y)), 3) AS filtered FROM r")
def clamped_filter(spark, sf_dir):
    """Causal 4 to 40 Hz from the steady state of an input of ones, whatever the first sample is, clamped to 300."""
    rows = samples(spark, sf_dir).select("user_id", "idx", "value")
    return filters.causal(rows, ["user_id"], ["idx"], "value", *TASK_BAND, steady=True, clip=300.0).withColumn("filtered", F.round("filtered", 3))


WINDOW_BAND = dsp.butterworth(4.0, 40.0, FULL_RATE, order=5)


@query("block_filter", f"WITH RECURSIVE {S.replace('s AS', 's0 AS', 1)}, s AS (SELECT user_id, event_id, value, idx // 16 AS block, idx % 16 AS idx FROM s0), {recursion(*WINDOW_BAND, keys=('user_id', 'block'))} SELECT user_id, block * 16 + idx AS idx, round(y, 4) AS filtered FROM r")
def block_filter(spark, sf_dir):
    """Causal 4 to 40 Hz of ten poles over windows of 16 samples, each from rest: no state is carried from window to window."""
    rows = samples(spark, sf_dir).select("user_id", "idx", "value", F.floor(F.col("idx") / 16).alias("block"))
    return filters.from_rest(rows, ["user_id"], "block", ["idx"], "value", *WINDOW_BAND).select("user_id", "idx", F.round("filtered", 4).alias("filtered"))


CH = [f"x{c}" for c in range(CHANNELS)]


def _wide(spark, sf_dir):
    """label, vec_id, t, x0..x3: epochs of a label one after another as a recording."""
    return epoch_samples(spark, sf_dir).groupBy("label", "vec_id", "t").pivot("ch", list(range(CHANNELS))).agg(F.first("x")).toDF("label", "vec_id", "t", *CH)


def _source_table(spark, df, mean, unmixing):
    """component, variance, kurtosis of the sources."""
    parts = [sum((float(u) * (F.col(c) - float(m)) for u, c, m in zip(row, CH, mean)), F.lit(0.0)) for row in unmixing]
    long = df.select(F.posexplode(F.array(*parts)).alias("component", "s"))
    return long.groupBy("component").agg(F.round(F.var_pop("s"), 4).alias("variance"), F.round(F.kurtosis("s"), 4).alias("kurtosis"))


@query("sobi_sources")
def sobi_sources(spark, sf_dir):
    df = _wide(spark, sf_dir)
    return _source_table(spark, df, *BS.sobi(df, ["label"], ["vec_id", "t"], CH, 8))


@query("fastica_sources")
def fastica_sources(spark, sf_dir):
    df = _wide(spark, sf_dir)
    return _source_table(spark, df, *BS.fast_ica(df, CH, rounds=15))


@query("artifact_zeroed")
def artifact_zeroed(spark, sf_dir):
    """Channels without the components of high kurtosis: power left per channel."""
    df = _wide(spark, sf_dir)
    mean, unmixing = BS.sobi(df, ["label"], ["vec_id", "t"], CH, 8)
    clean = BS.suppress(df, CH, mean, unmixing, BS.artifact_factors(df, CH, mean, unmixing, 1.0))
    return clean.agg(*[F.round(F.var_pop(c), 5).alias(c) for c in CH])


def _targets(spark, sf_dir):
    """vec_id, label (subject), c, y (odd epochs)."""
    return _covariances(spark, sf_dir).select("vec_id", "label", "c", (F.col("vec_id") % 2).cast("double").alias("y"))


def _features(spark, sf_dir):
    """vec_id, label, y, v: tangent vector at the pooled mean of all rows, for figures that hold nothing out."""
    rows = _targets(spark, sf_dir)
    return rows.select("vec_id", "label", "y", M.tangent_at(F.col("c"), _pooled(rows)).alias("v"))


def _left_out(rows, group="label", alpha=1.0):
    """Ridge predictions; a fold's tangent vectors are at the mean of the other groups."""
    rows = _stored(rows)
    return models.leave_out_ridge_at(rows, "c", M.tangents, M.references_without(rows, group, "c"), "y", group, 10, alpha)


def _accuracy(df, cut=0.5):
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("predicted") >= cut) == (F.col("y") >= 0.5)).cast("double")), 4).alias("accuracy"))


@query("loso_ridge")
def loso_ridge(spark, sf_dir):
    return _accuracy(_left_out(_targets(spark, sf_dir)))


@query("loso_rbf")
def loso_rbf(spark, sf_dir):
    """Kernel classifier by random Fourier features and a linear support vector machine."""
    return _accuracy(_left_out_by(spark, sf_dir, models.linear_svc(20), lambda v: models.fourier_features(v, 10)))


def _left_out_by(spark, sf_dir, model, more=lambda v: v):
    """Predictions of a pyspark.ml model per left-out label, on tangent vectors at the mean of the others."""
    rows = _stored(_targets(spark, sf_dir))
    references = M.references_without(rows, "label", "c")
    return models.leave_out_classifier(rows, lambda g: more(M.tangent_at(F.col("c"), references[g])), "y", "label", model)


@query("loso_rf")
def loso_rf(spark, sf_dir):
    return _accuracy(_left_out_by(spark, sf_dir, models.random_forest(10)))


def _first_power():
    """Power of an epoch's first channel; the epochs as wholes all have the same."""
    return F.aggregate(channel(F.col("x"), 0), F.lit(0.0), lambda a, v: a + v * v)


@query("loso_forest_regression")
def loso_forest_regression(spark, sf_dir):
    """Power of the first channel of left-out labels' epochs by a regression forest over the covariances: explained share."""
    rows = epoch_arrays(spark, sf_dir).select("label", _first_power().alias("y"), M.epoch_covariance("x").alias("c"))
    done = models.leave_out_classifier(_stored(rows), lambda g: F.transform("c", lambda v: v * 1.0), "y", "label", models.forest_regressor(10))
    e = F.col("y") - F.col("predicted")
    return done.agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.avg(e * e) / F.var_pop("y"), 4).alias("r2"))


@query("kfold_r2")
def kfold_r2(spark, sf_dir):
    """Five folds by hash; the target is the power of the epoch's first channel."""
    rows = _covariances(spark, sf_dir).select("vec_id", "c")
    power = epoch_arrays(spark, sf_dir).select("vec_id", _first_power().alias("y"))
    rows = rows.join(power, "vec_id").withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(5)).cast("int"))
    done = _left_out(rows, "fold")
    mean = done.agg(F.avg("y").alias("m"))
    e, s = F.col("y") - F.col("predicted"), F.col("y") - F.col("m")
    return done.crossJoin(F.broadcast(mean)).agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.sum(e * e) / F.sum(s * s), 4).alias("r2"))


@query("wavenet_loss")
def wavenet_loss(spark, sf_dir):
    """Loss of a small convolutional network, step by step."""
    rows = epoch_arrays(spark, sf_dir).select("x", (F.col("vec_id") % 2).cast("double").alias("y")).cache()
    losses = models.WaveNet(CHANNELS).fit(rows, "x", "y", EPOCH_SAMPLES, CHANNELS, steps=5)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(losses)], "step int, loss double")


def _minor(rows: tuple[int, ...], cols: tuple[int, ...]) -> str:
    """SQL of the determinant of some rows and columns of the pooled matrix p."""
    if not rows:
        return "1.0"
    entry = lambda c: f"p{min(rows[0], c)}{max(rows[0], c)}"
    return "(" + " + ".join(f"({'-' if k % 2 else ''}{entry(c)} * {_minor(rows[1:], cols[:k] + cols[k + 1:])})" for k, c in enumerate(cols)) + ")"


def _without(k: int) -> tuple[int, ...]:
    return tuple(i for i in range(4) if i != k)


TRACE = " + ".join(f"{(2 if i != j else 1) * (-1) ** (i + j)} * m{i}{j} * {_minor(_without(i), _without(j))}" for i in range(4) for j in range(i, 4))


@query(
    "logdet_divergence4",
    f"""WITH {C}, m0 AS (SELECT vec_id, {_cells('m')} FROM c GROUP BY 1), p AS (SELECT {", ".join(f"avg(m{i}{j}) AS p{i}{j}" for i in range(4) for j in range(i, 4))} FROM m0), t AS (SELECT vec_id, ({TRACE}) / {_minor((0, 1, 2, 3), (0, 1, 2, 3))} AS tr, ln({_minor((0, 1, 2, 3), (0, 1, 2, 3))}) AS lp FROM m0, p),
m1 AS (SELECT vec_id, ln(m00) AS l, {_reduced(0)} FROM m0), m2 AS (SELECT vec_id, l + ln(m11) AS l, {_reduced(1)} FROM m1), m3 AS (SELECT vec_id, l + ln(m22) AS l, {_reduced(2)} FROM m2)
SELECT vec_id, round(greatest(tr - (l + ln(m33) - lp) - 4, 0), 5) AS d FROM t JOIN m3 USING (vec_id)""",
)
def logdet_divergence4(spark, sf_dir):
    """trace(P^-1 Q) - ln det(P^-1 Q) - 4 of each epoch's covariance against the pooled mean, at least 0."""
    rows = _covariances(spark, sf_dir)
    return rows.select("vec_id", F.round(M.divergence_to(F.col("c"), _pooled(rows)), 5).alias("d"))


@query("focus_score")
def focus_score(spark, sf_dir):
    """Ridge score of tangent vectors, 0 to 100, each label scored by the others."""
    done = _left_out(_targets(spark, sf_dir).withColumn("y", F.col("y") * 100), alpha=10.0)
    return done.select("vec_id", "label", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "predicted")), 3).alias("score"))


@query("ridge_path")
def ridge_path(spark, sf_dir):
    """Left-out error along a path of penalties: one pass of sums serves them all."""
    rows = _features(spark, sf_dir)
    grams = models.gram_by_group(rows, "v", "y", "label", 10)
    found = models.left_out_errors(grams, list(np.logspace(-3, 5, 9)))
    return spark.createDataFrame([(float(a), round(float(e), 6)) for a, e in found], "alpha double, mse double")


@query("tournament")
def tournament(spark, sf_dir):
    """Features against labels: raw covariance triangle, channel log variances, tangent vectors; true and shuffled labels."""
    rows = _stored(_covariances(spark, sf_dir).select("vec_id", "label", "c"))
    references = M.references_without(rows, "label", "c")
    upper, diagonal = [4 * i + j for i in range(4) for j in range(i, 4)], [0, 5, 10, 15]
    views = {"raw": (lambda c, _: c[:, upper], 10), "log_variance": (lambda c, _: np.log(c[:, diagonal]), 4), "tangent": (M.tangents, 10)}
    labels = {"true": F.col("vec_id") % 2, "shuffled": F.pmod(F.xxhash64("vec_id"), F.lit(2))}
    out = []
    for name, (at, size) in views.items():
        for kind, y in labels.items():
            df = rows.select("label", y.cast("double").alias("y"), "c")
            done = models.leave_out_ridge_at(df, "c", at, references, "y", "label", size)
            right = F.avg(((F.col("predicted") >= 0.5) == (F.col("y") >= 0.5)).cast("double"))
            out.append(done.agg(F.count(F.lit(1)).alias("n"), F.round(right, 4).alias("accuracy")).select(F.lit(name).alias("features"), F.lit(kind).alias("labels"), "n", "accuracy"))
    table = out[0]
    for part in out[1:]:
        table = table.union(part)
    return table


@query("principal_shares")
def principal_shares(spark, sf_dir):
    """Shares of the tangent vectors' variance along their principal axes, from one matrix of sums."""
    grams = models.gram_by_group(_features(spark, sf_dir), "v", "y", "label", 10)
    g = sum(grams.values())
    mean = g[0, 1:-1] / g[0, 0]
    values = np.linalg.eigvalsh(g[1:-1, 1:-1] / g[0, 0] - np.outer(mean, mean))[::-1]
    return spark.createDataFrame([(k, round(float(v / values.sum()), 5)) for k, v in enumerate(values)], "axis int, share double")


@query(
    "resampled_power",
    f"""WITH {E}, w AS (SELECT m, t, (1 + 2 * sum(cos(2 * pi() * k * (m / 31.0 - t / 16.0))) + cos(16 * pi() * m / 31.0) * cos(pi() * t)) / 16 AS w FROM (SELECT unnest(range(0, 31)) AS m), (SELECT unnest(range(0, 16)) AS t), (SELECT unnest(range(1, 8)) AS k) GROUP BY 1, 2),
y AS (SELECT vec_id, ch, m, sum(x * w) AS y FROM e JOIN w USING (t) GROUP BY 1, 2, 3), a AS (SELECT vec_id, ch, avg(y * y) AS after FROM y GROUP BY 1, 2), b AS (SELECT vec_id, ch, avg(x * x) AS before FROM e GROUP BY 1, 2)
SELECT vec_id, ch, round(before, 6) AS before, round(after, 6) AS after FROM a JOIN b USING (vec_id, ch)""",
)
def resampled_power(spark, sf_dir):
    """Power of each epoch's channels before and after resampling from 16 to 31 samples."""
    rows = epoch_arrays(spark, sf_dir).select("vec_id", M.resampled_powers(F.col("x"), 31).alias("p"))
    cells = F.array(*[F.struct(F.lit(c).cast("long").alias("ch"), F.round(F.get("p", F.lit(c)), 6).alias("before"), F.round(F.get("p", F.lit(CHANNELS + c)), 6).alias("after")) for c in range(CHANNELS)])
    return rows.select("vec_id", F.inline(cells))


@query(
    "spiking_neuron",
    f"""WITH RECURSIVE {S}, r(user_id, idx, p, b, a, w, spikes) AS (SELECT user_id, -1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 0::BIGINT FROM s WHERE idx = 0
UNION ALL SELECT user_id, idx, CASE WHEN p >= 1 THEN 0.0 ELSE p END, b, 0.8 * a + CASE WHEN p >= 1 THEN 1 ELSE 0 END, greatest(0.0, least(1.0, CASE WHEN p >= 1 THEN w + 0.01 * b ELSE w - 0.01 * a END)), spikes + CASE WHEN p >= 1 THEN 1 ELSE 0 END
FROM (SELECT s.user_id, s.idx, 0.9 * r.p + r.w * (s.value / 50) AS p, 0.8 * r.b + s.value / 50 AS b, r.a, r.w, r.spikes FROM r JOIN s ON s.user_id = r.user_id AND s.idx = r.idx + 1))
SELECT user_id, max(spikes) AS spikes, round(arg_max(w, idx), 5) AS weight FROM r GROUP BY 1""",
)
def spiking_neuron(spark, sf_dir):
    """Spikes and synaptic weight of a leaky neuron driven by each recording."""
    rows = samples(spark, sf_dir).select("user_id", "idx", (F.col("value") / 50).alias("drive"))
    return filters.leaky_neuron(rows, ["user_id"], ["idx"], "drive").groupBy("user_id").agg(F.sum("spike").alias("spikes"), F.round(F.max_by("weight", "idx"), 5).alias("weight"))


@query("calibrated_probability")
def calibrated_probability(spark, sf_dir):
    """Left-out ridge scores turned into probabilities; the curve of even labels' scores is fitted on odd labels', and the other way round."""
    done = _stored(_left_out(_targets(spark, sf_dir)).select("vec_id", "label", "y", "predicted"))
    odd = F.col("label") % 2 == 1
    curves = [models.fit_platt(done.where(half), "predicted", "y") for half in (odd, ~odd)]
    p = [1 / (1 + F.exp(-(a * F.col("predicted") + b))) for a, b in curves]
    return done.select("vec_id", F.round(F.when(odd, p[1]).otherwise(p[0]), 5).alias("p"))


@query(
    "lead_off_gate",
    f"""WITH {S}, w AS (SELECT user_id, idx // 8 AS win, 1 - avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END) AS sqi FROM s GROUP BY 1, 2 HAVING count(*) = 8),
o AS (SELECT user_id, min(win) AS off FROM w WHERE sqi < 0.7 GROUP BY 1), a AS (SELECT w.user_id, count(*) AS windows, bool_and(sqi < 0.7) AS all_bad, avg(sqi) AS m FROM w JOIN o ON o.user_id = w.user_id AND w.win BETWEEN o.off AND o.off + 2 GROUP BY 1)
SELECT user_id, windows, all_bad AND windows = 3 AS lead_off, round(m, 5) AS mean_sqi FROM a""",
)
def lead_off_gate(spark, sf_dir):
    """An electrode is off if the first bad window of a recording and the two after it are all bad; bad is a share of samples at the rail."""
    railed = F.avg((F.col("value") >= 100).cast("double"))
    w = samples(spark, sf_dir).groupBy("user_id", F.floor(F.col("idx") / 8).alias("win")).agg((1 - railed).alias("sqi"), F.count(F.lit(1)).alias("n")).where("n = 8")
    off = w.where("sqi < 0.7").groupBy("user_id").agg(F.min("win").alias("off"))
    after = w.join(off, "user_id").where("win between off and off + 2").groupBy("user_id").agg(F.count(F.lit(1)).alias("windows"), F.every(F.col("sqi") < 0.7).alias("all_bad"), F.avg("sqi").alias("m"))
    return after.select("user_id", "windows", (F.col("all_bad") & (F.col("windows") == 3)).alias("lead_off"), F.round("m", 5).alias("mean_sqi"))


@query("fused_tangent")
def fused_tangent(spark, sf_dir):
    """Tangent vectors of the whole epoch and its two sides at their label's mean, weighed by the softmax of the negative dispersions."""
    rows = _stored(_covariances(spark, sf_dir).select("vec_id", "label", "c"))
    means = M.arithmetic_means(rows, "label", "c")
    d = rows.withColumn("d", M.by_key(M.scale_distances, F.col("c"), F.col("label"), means))
    spread = d.groupBy("label").agg(*[F.stddev_pop(F.get("d", F.lit(k))).alias(f"s{k}") for k in range(3)]).collect()  # one row per label
    given = {r["label"]: (means[r["label"]], np.exp([-r[f"s{k}"] for k in range(3)])) for r in spread}
    given = {k: (m, w / w.sum()) for k, (m, w) in given.items()}
    fused = M.by_key(lambda c, mw: M.fused_tangents(c, *mw), F.col("c"), F.col("label"), given)
    return rows.select("vec_id", "label", F.transform(fused, lambda v: F.round(v, 5)).alias("v"))


@query("whitened_blend")
def whitened_blend(spark, sf_dir):
    """Tangent vectors blended with their whitened form by each label's own share."""
    rows = _stored(_features(spark, sf_dir).select("vec_id", "label", "v"))
    matrices = M.whitening(rows, "label", "v", 10)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    spread = rows.groupBy("label").agg(F.greatest(F.lit(0.2), F.least(F.lit(0.95), 0.2 + 0.6 * F.stddev_pop(norm) / (F.avg(norm) + 1e-12))).alias("a")).collect()  # one row per label
    given = {r["label"]: (r["a"], matrices[r["label"]]) for r in spread}
    blend = M.by_key(lambda v, am: (1 - am[0]) * v + am[0] * v @ am[1].T, F.col("v"), F.col("label"), given)
    return rows.select("vec_id", "label", F.transform(blend, lambda x: F.round(x, 5)).alias("v"))


@query("nested_ridge")
def nested_ridge(spark, sf_dir):
    """Penalties chosen by inner folds of whole labels, then tried on the label left out; raw or tangent features by the inner error."""
    rows = _stored(_targets(spark, sf_dir).withColumn("_part", (F.col("label") % 3).cast("int")))
    references = M.references_without(rows, "label", "c")
    upper = [4 * i + j for i in range(4) for j in range(i, 4)]
    views = {"tangent": M.tangents, "raw": lambda c, _: c[:, upper]}
    found = {name: models.nested_search(models.fold_grams(rows, "c", at, references, "y", "label", 10), list(np.logspace(-3, 5, 9))) for name, at in views.items()}
    table = [(r[0][0], *max(zip(views, r), key=lambda x: -x[1][2])) for r in zip(*found.values())]
    return spark.createDataFrame([(int(g), name, float(a), round(float(i), 6), round(float(o), 6)) for g, name, (_, a, i, o) in table], "label long, features string, alpha double, inner_mse double, outer_mse double")


@query("swelling_seeds")
def swelling_seeds(spark, sf_dir, seeds: int = 20):
    """Determinant swelling of each seed's noisy copy of all epochs, then its spread over the seeds."""
    rows = epoch_arrays(spark, sf_dir).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))))
    noisy = F.transform("x", lambda v, i: v * (1 + 0.3 * generators.unit_noise(F.col("vec_id") * 64 + i, F.col("seed"))))
    rows = rows.select("seed", M.epoch_covariance(noisy).alias("c"))
    rows = _stored(rows)
    arithmetic, geometric = M.arithmetic_means(rows, "seed", "c"), M.settled_means(rows, "seed", "c")
    found = [(k, float(M.swelling(arithmetic[k], m)[0])) for k, m in geometric.items()]
    r = spark.createDataFrame(found, "seed long, ratio double")
    x = F.col("ratio")
    return r.agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg(x), 5).alias("mean_ratio"), F.round(F.stddev_pop(x), 5).alias("std_ratio"), F.round(A.variation(x), 5).alias("cv"), F.round(F.min(x), 5).alias("min_ratio"), F.round(F.max(x), 5).alias("max_ratio"))


UPPER = [4 * i + j for i in range(4) for j in range(i, 4)]


def raw_view(c: np.ndarray, _) -> np.ndarray:
    return c[:, UPPER]


def contrasts(spark, sf_dir):
    """label, c (covariance times 64), y (the first channel is stronger than the second), _part (of the label)."""
    rows = _covariances(spark, sf_dir).select("label", F.transform("c", lambda v: v * 64).alias("c"))
    return rows.select("label", "c", (F.get("c", F.lit(0)) > F.get("c", F.lit(5))).cast("double").alias("y"), (F.col("label") % 3).cast("int").alias("_part"))


def _grid(rows, view: str):
    references = M.references_without(rows, "label", "c")
    at = {"raw": raw_view, "tangent": M.tangents}[view]
    return kernel.kernel_grid(rows, "c", "y", "label", "_part", 3, at, references, standard=view == "raw")


@query("kernel_grid")
def kernel_grid(spark, sf_dir):
    """All 98 settings of the kernel classifier for each label left out, on standardised covariance triangles."""
    return _grid(_stored(contrasts(spark, sf_dir)), "raw").withColumns({c: F.round(c, 6) for c in ("inner", "outer")})


@query("nested_kernel")
def nested_kernel(spark, sf_dir):
    """The best setting of each fold by inner accuracy, on raw and on tangent features; the fold falls back to raw ones where those score better inside."""
    rows = _stored(contrasts(spark, sf_dir))
    best = {view: kernel.best_of(_grid(rows, view)) for view in ("raw", "tangent")}
    named = {v: b.select("fold", *[F.col(c).alias(f"{v}_{c}") for c in ("c", "gamma", "class_weight", "inner", "outer")]) for v, b in best.items()}
    both = named["raw"].join(named["tangent"], "fold")
    back = F.col("tangent_inner") < F.col("raw_inner")
    gated = both.withColumns({"features": F.when(back, "raw").otherwise("tangent"), "gated_outer": F.when(back, F.col("raw_outer")).otherwise(F.col("tangent_outer"))})
    return gated.withColumns({c: F.round(c, 6) for c in gated.columns if c.endswith(("inner", "outer"))})


#: Sizes of samples as shares of all epochs, and their seeds.
SHARES, SEEDS = [(k, 60) for k in (1, 3, 5, 8, 10, 15, 20, 30)], 20


def _sizes(n: str, share) -> str:
    return f"greatest(8, {n} * {share[0]} // {share[1]})"


@query(
    "swelling_nested",
    f"""WITH {C}, m0 AS (SELECT vec_id, {_cells('m')} FROM c GROUP BY 1), m1 AS (SELECT vec_id, ln(m00) AS l, {_reduced(0)} FROM m0), m2 AS (SELECT vec_id, l + ln(m11) AS l, {_reduced(1)} FROM m1), m3 AS (SELECT vec_id, l + ln(m22) + ln(m33 - m23 * m23 / m22) AS l FROM (SELECT vec_id, l, m22, m23, m33 FROM m2)),
d AS (SELECT vec_id, seed, row_number() OVER (PARTITION BY seed ORDER BY CAST('0x' || substr(md5(seed || '-' || vec_id), 1, 8) AS BIGINT), vec_id) AS place, count(*) OVER (PARTITION BY seed) AS n FROM m0, (SELECT unnest(range(0, {SEEDS})) AS seed)),
k AS (SELECT vec_id, seed, unnest([{', '.join(_sizes('n', s) for s in SHARES)}]) AS size, place FROM d), g AS (SELECT size, seed, avg(l) AS l, {', '.join(f'avg(m{a}{b}) AS m{a}{b}' for a in range(4) for b in range(a, 4))} FROM k JOIN m0 USING (vec_id) JOIN m3 USING (vec_id) WHERE place <= size GROUP BY ALL),
g1 AS (SELECT size, seed, l, ln(m00) AS e, {_reduced(0)} FROM g), g2 AS (SELECT size, seed, l, e + ln(m11) AS e, {_reduced(1)} FROM g1), r AS (SELECT size, seed, exp(e + ln(m22) + ln(m33 - m23 * m23 / m22) - l) AS x FROM g2)
SELECT size, round(avg(x), 4) AS mean_ratio, round(stddev_pop(x), 4) AS std_ratio, round(stddev_pop(x) / avg(x), 4) AS cv, round(min(x), 4) AS min_ratio, round(max(x), 4) AS max_ratio, count(*) AS n_seeds, true AS converged FROM r GROUP BY size""",
)
def swelling_nested(spark, sf_dir):
    """Determinant swelling of nested samples without replacement, eight sizes and twenty seeds, then its spread over the seeds."""
    rows = _stored(_covariances(spark, sf_dir).select("vec_id", "c"))
    n = rows.count()
    sizes = sorted({max(8, n * a // b) for a, b in SHARES})
    means = mean_tables.geometric_mean_table(mean_tables.nested_samples(rows, "vec_id", sizes, SEEDS).select("size", "seed", "c"), ["size", "seed"], "c")
    x = F.col("ratio")
    out = {"mean_ratio": F.avg(x), "std_ratio": F.stddev_pop(x), "cv": A.variation(x), "min_ratio": F.min(x), "max_ratio": F.max(x)}
    return mean_tables.swelling_table(means).groupBy("size").agg(*[F.round(c, 4).alias(k) for k, c in out.items()], F.count(F.lit(1)).alias("n_seeds"), F.every("converged").alias("converged"))


@query("polynomial_ridge")
def polynomial_ridge(spark, sf_dir):
    """Tangent features of degree two, the penalty of each fold by generalised cross-validation: accuracy and mean decision on the label left out."""
    rows = _stored(contrasts(spark, sf_dir))
    scores, done = polynomial.left_out_polynomial(rows, "c", "y", "label", M.tangents, M.references_without(rows, "label", "c"))
    best = scores.groupBy(F.col("fold").alias("label")).agg(F.round(F.min("gcv"), 6).alias("gcv"))
    right = ((F.col("decision") > 0) == (F.col("y") > 0.5)).cast("double")
    found = done.groupBy("label").agg(F.max("alpha").alias("alpha"), F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("decision"), 5).alias("mean_decision"))
    return found.join(best, "label")
