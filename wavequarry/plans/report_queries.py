"""The whole evaluation of a session: spectrum, geometry of its states, engagement with intervals and tests, gates, and the report."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..operators import aggregates as A
from ..operators import mean_tables
from ..operators import stats as ST
from ..operators.blocks import stored, summed
from .model_queries import RATE, _covariances
from .network_queries import JOINED, long_epochs
from .registry import query
from .stream_queries import stream_live_scores

SEGMENT = JOINED * 16
DRAWS = 2000
#: The gates of a session, as (least, most).
GATES = {"slope": (-2.5, -1.0), "r2": (0.7, 1.0), "prominence": (1.5, 8.0), "peak_hz": (8.0, 13.0), "quality": (0.95, 1.0)}
#: Engaged and resting windows for the test, and for the shares of time, in deviations from the session's mean.
ENGAGED_ABOVE, RESTING_BELOW, HIGH, LOW = 0.5, -0.3, 0.8, -0.6


def spectra(epochs: DataFrame, key: str = "label", channels: int = 4, segment: int = SEGMENT) -> DataFrame:
    """key, n, power: one-sided power density at multiples of the rate over ``segment``, averaged over a key's segments and channels; each is taken without its mean and through a Hann window."""
    kind = dict(epochs.dtypes)[key]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)

    def periodograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy()).astype(float).reshape(-1, segment, channels)
                p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * window[:, None], axis=1)) ** 2 / (RATE * (window**2).sum())
                p[:, 1:-1] *= 2
                yield batch[[key]].assign(s=[np.append(row, 1.0).tolist() for row in p.mean(2)])

    bins = segment // 2 + 1
    sums = summed(epochs.select(key, "x").mapInPandas(periodograms, f"{key} {kind}, s array<double>"), [key], "s")
    n = F.get("s", F.lit(bins))
    return sums.select(key, n.cast("long").alias("n"), F.transform(F.slice("s", 1, bins), lambda v: v / n).alias("power"))


def spectral_figures(spectrum: DataFrame, key: str = "label", segment: int = SEGMENT) -> DataFrame:
    """key, slope and r2 of the logarithms of power over frequency from 4 Hz on, peak_hz and prominence of 8 to 13 Hz, engagement beta / (alpha + theta)."""
    cells = spectrum.select(key, F.posexplode("power").alias("k", "p")).withColumn("f", F.col("k") * RATE / segment)
    band = lambda lo, hi: F.sum(F.when((F.col("f") >= lo) & (F.col("f") < hi), F.col("p")))
    fitted = (F.col("f") >= 4) & (F.col("f") <= min(40.0, RATE / 2 - 1)) & (F.col("p") > 0)
    x, y = F.when(fitted, F.log10("f")), F.when(fitted, F.log10("p"))
    alpha = F.col("f").between(8, 13)
    around = F.avg(F.when(F.col("f").between(4, 8) & (F.col("f") < 8) | F.col("f").between(13, 20) & (F.col("f") > 13), F.col("p")))
    top = F.max(F.when(alpha, F.struct(F.col("p"), -F.col("f"))))
    out = cells.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), top.alias("_top"), around.alias("_around"), (band(13, 30) / (band(8, 13) + band(4, 8))).alias("nasa"))
    return out.select(key, "slope", "r2", (-F.col("_top.col2")).alias("peak_hz"), (F.col("_top.p") / F.col("_around")).alias("prominence"), "nasa")


def state_geometry(covariances: DataFrame, key: str = "label") -> DataFrame:
    """key, rest_cog, rest_motor, cog_motor: distances between the geometric means of a key's three states (0, 1, 2)."""
    means = mean_tables.geometric_mean_table(covariances, [key, "state"], "c")
    packed = means.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("state", "mean"))).alias("m"))  # three states
    square = lambda v: np.asarray(v, float).reshape(4, 4)

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else float(L.distance(square(u), square(v))) for u, v in zip(a, b)], dtype=float)

    at = lambda k: F.element_at("m", F.lit(k).cast("long"))
    return packed.select(key, *[distance(at(i), at(j)).alias(name) for name, i, j in (("rest_cog", 0, 1), ("rest_motor", 0, 2), ("cog_motor", 1, 2))])


def normal_tail(z):
    """Probability of a standard normal number above z."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else 0.5 * math.erfc(v / math.sqrt(2)) for v in z], dtype=float)

    return tail(z)


def engagement_figures(windows: DataFrame, key: str = "label") -> DataFrame:
    """key and figures of scored windows: means with intervals of resamples, percentiles, shares of time, and engaged against resting windows."""
    c = F.col
    scored = windows.where("phase = 'inference'").select(key, "window", c("engagement").alias("ei"), c("to_reference").alias("d"))
    session = scored.groupBy(key).agg(F.avg("ei").alias("_mean"), F.stddev_pop("ei").alias("_sd"))
    scored = scored.join(session, key).withColumn("z", (c("ei") - c("_mean")) / F.nullif("_sd", F.lit(0.0))).drop("_mean", "_sd")
    scored = stored(scored, "scored")
    at = lambda q, name, p: F.percentile(q, F.lit(p)).alias(name)
    plain = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("windows"), F.avg("ei").alias("ei_mean"), F.min("ei").alias("ei_min"), F.max("ei").alias("ei_max"), F.avg("d").alias("d_mean"), at("d", "d_p5", 0.05), at("d", "d_median", 0.5), at("d", "d_p95", 0.95),
        F.avg((c("z") > HIGH).cast("double")).alias("high_share"), F.avg((c("z") < LOW).cast("double")).alias("low_share"),
    )
    drawn = ST.bootstrap_by(scored, key, "window", ["ei", "d"], DRAWS, {"ei": F.avg("ei"), "d": F.avg("d")})
    intervals = drawn.groupBy(key).agg(at("ei", "ei_lo", 0.025), at("ei", "ei_hi", 0.975), at("d", "d_lo", 0.025), at("d", "d_hi", 0.975))
    sides = scored.where((c("z") > ENGAGED_ABOVE) | (c("z") < RESTING_BELOW)).withColumn("up", c("z") > ENGAGED_ABOVE)
    effect = sides.groupBy(key).agg(A.cohens_d(F.when(c("up"), c("ei")), F.when(~c("up"), c("ei"))).alias("effect"))
    tested = ST.mann_whitney_by(sides, key, "ei", c("up")).where("n_a > 2 and n_b > 2")
    tested = tested.select(key, F.col("n_a").alias("n_engaged"), F.col("n_b").alias("n_resting"), "u", normal_tail(c("z")).alias("p"))
    return plain.join(intervals, key).join(effect, key, "left").join(tested, key, "left")


@query("session_report")
def session_report(spark, sf_dir):
    """Every figure of each label's session, the number of gates passed, and the report's text.

    Quality is the share of windows that the amplitude gate lets through; states
    are an epoch's number modulo three.
    """
    windows = stored(stream_live_scores(spark, sf_dir), "windows")
    quality = windows.groupBy("label").agg(F.avg((F.col("phase") != "gated").cast("double")).alias("quality"))
    epochs = stored(long_epochs(spark, sf_dir), "epochs")
    level = epochs.groupBy("label").agg(F.sqrt(F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v) / F.size("x"))).alias("rms"))
    states = _covariances(spark, sf_dir).select("label", (F.col("vec_id") % 3).alias("state"), "c")
    found = level
    for part in (quality, spectral_figures(spectra(epochs)), state_geometry(states), engagement_figures(windows)):
        found = found.join(part, "label", "left")
    passed = sum((F.coalesce(F.col(k).between(lo, hi), F.lit(False)).cast("int") for k, (lo, hi) in GATES.items()), F.lit(0))
    found = found.withColumn("gates", passed)
    text = lambda pattern, *names: F.format_string(pattern, *names)
    lines = F.concat_ws(
        "\n",
        text("SESSION %d: %d scored windows, level %.3f", "label", "windows", "rms"),
        text("spectrum: slope %.3f (r2 %.3f), peak %.1f Hz (%.2f x), engagement %.3f", "slope", "r2", "peak_hz", "prominence", "nasa"),
        text("states: rest to cognitive %.4f, rest to motor %.4f, cognitive to motor %.4f", "rest_cog", "rest_motor", "cog_motor"),
        text("distance: mean %.4f [%.4f, %.4f], median %.4f", "d_mean", "d_lo", "d_hi", "d_median"),
        text("index: mean %.4f [%.4f, %.4f], %.1f%% high, %.1f%% low", F.col("ei_mean"), F.col("ei_lo"), F.col("ei_hi"), 100 * F.col("high_share"), 100 * F.col("low_share")),
        F.when(F.col("p").isNotNull(), text("engaged above resting: p %.6f, effect %.3f", "p", "effect")).otherwise("engaged above resting: too few windows"),
        text(f"gates passed: %d of {len(GATES)}", "gates"),
    )
    return found.withColumn("report", lines)
