"""Sources taken out of many recordings: what is left against the recording as it was, fitted at once and live."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import filters
from ..operators import keyed_separation as K
from ..operators import stats as ST
from ..operators.blocks import blocks, stored
from ..session import shared_dir
from ..sources.tables import CHANNELS, EPOCH_SAMPLES
from ..streaming import live, overlap, phases
from .model_queries import CH, RATE, _wide
from .registry import query

#: Samples between pulses, and of a pulse; its height, and that of the muscle noise.
EVERY, PULSE, HEIGHT, MUSCLE = 160, 32, 3.0, 1.2
ORDER = ["vec_id", "t"]


def disturbed(spark, sf_dir) -> DataFrame:
    """label, vec_id, t, clean and noisy (channels): epochs of a label as a recording, with pulses and muscle noise in two channels."""
    place = F.col("vec_id") * EPOCH_SAMPLES + F.col("t")
    phase = (place % EVERY).cast("double")
    pulse = F.when(phase < PULSE, HEIGHT * (0.5 - 0.5 * F.cos(2 * math.pi * phase / (PULSE - 1)))).otherwise(0.0)
    muscle = F.when(phase.between(96, 127), MUSCLE * math.sqrt(12) * (ST.scattered(place) / ST.BOUND - 0.5)).otherwise(0.0)
    noise = pulse + 0.8 * muscle
    noisy = F.array(F.col(CH[0]) + noise, F.col(CH[1]) + noise, *CH[2:])
    return _wide(spark, sf_dir).select("label", *ORDER, F.array(*CH).alias("clean"), noisy.alias("noisy"))


def filtered(rows: DataFrame) -> DataFrame:
    """``rows`` with x, the noisy channels, and wanted, the first clean one, both through the same notch and band."""
    width = 16.0 / 30 / 2
    chain = [dsp.butterworth_sections(16.0 - width, 16.0 + width, RATE, 2, stop=True), dsp.butterworth_sections(1.0, 20.0, RATE)]
    values = rows.select("label", *ORDER, F.get("clean", F.lit(0)).alias("raw"), F.get("noisy", F.lit(0)).alias("before"), F.concat("noisy", F.slice("clean", 1, 1)).alias("v"))
    found = filters.zero_phase_chain(values, ["label"], [*ORDER, "raw", "before"], "v", chain, channels=CHANNELS + 1)
    return found.select("label", *ORDER, "raw", "before", F.slice("filtered", 1, CHANNELS).alias("x"), F.get("filtered", F.lit(CHANNELS)).alias("wanted"))


def snr(clean: Column, test: Column) -> Column:
    """Power of ``clean`` over that of what ``test`` differs by, in decibels."""
    return 10 * F.log10(F.sum(clean * clean) / F.sum((test - clean) * (test - clean)))


def _after(rows: DataFrame, removers: DataFrame) -> DataFrame:
    back = K.rebuilt(F.col("x"), F.col("mean"), F.col("remover"), CHANNELS)
    return rows.join(removers, "label").select("label", *ORDER, "raw", "before", "wanted", F.get(back, F.lit(0)).alias("after"))


METHODS = {"fastica": ("fastica", 0.0), "sobi": ("sobi", 0.0), "fastica soft": ("fastica", 0.05)}


@query("separation_by_recording")
def separation_by_recording(spark, sf_dir):
    """Each recording's strongest source taken out, by two methods and softly: signal to noise before, correlation after, and gates.

    The reference is once the recording as it was, and once the same through the
    filters that the disturbed one went through.
    """
    rows = stored(filtered(disturbed(spark, sf_dir)), "filtered")
    cut = stored(blocks(rows, ["label"], ORDER, "x"), "blocks")
    fits = {"fastica": stored(K.fast_ica_by_recording(cut, ["label"], CHANNELS), "fits"), "sobi": stored(K.sobi_by_recording(cut, ["label"], CHANNELS), "fits")}
    found = []
    for name, (method, factor) in METHODS.items():
        fit = fits[method]
        cleaned = _after(rows, K.removers(fit, K.strongest(rows, fit, ["label"], "x", CHANNELS), ["label"], CHANNELS, factor))
        c = F.col
        sums = cleaned.groupBy("label").agg(F.count(F.lit(1)).alias("n"), snr(c("raw"), c("before")).alias("snr_raw"), F.corr("raw", "after").alias("corr_raw"), snr(c("wanted"), c("before")).alias("snr_filtered"), F.corr("wanted", "after").alias("corr_filtered"))
        gate = lambda kind: c(f"snr_{kind}").between(-20.0, -15.0) & (c(f"corr_{kind}") >= 0.4)
        sums = sums.join(fit.select("label", "rounds", "converged"), "label").select("label", F.lit(name).alias("method"), "n", "rounds", "converged", "snr_raw", "corr_raw", "snr_filtered", "corr_filtered", gate("raw").alias("pass_raw"), gate("filtered").alias("pass_filtered"))
        found.append(sums)
    return found[0].union(found[1]).union(found[2])


#: Windows of the live form; the first epochs' share that it is fitted on.
WINDOW, STEP, CALIBRATED = 64, 16, 0.5


@query("stream_overlap_add")
def stream_overlap_add(spark, sf_dir):
    """Fitted on a recording's first half and then applied live to all of it, window by window, against a fit to the whole.

    Both are held against the recording as it was, over the samples that the
    live form has finished; difference is the largest between the two.
    """
    rows = stored(filtered(disturbed(spark, sf_dir)), "filtered")
    half = rows.groupBy("label").agg((F.min("vec_id") + (F.max("vec_id") - F.min("vec_id")) * CALIBRATED).alias("until"))
    early = stored(blocks(rows.join(half, "label").where("vec_id <= until"), ["label"], ORDER, "x"), "blocks")
    fit = stored(K.sobi_by_recording(early, ["label"], CHANNELS), "fits")
    removers = stored(K.removers(fit, K.strongest(rows.join(half, "label").where("vec_id <= until"), fit, ["label"], "x", CHANNELS), ["label"], CHANNELS), "removers")
    folder = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunks = rows.groupBy("label", "vec_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("t", "x")))["x"]).alias("x"))
    chunks.write.parquet(folder)
    stream = spark.readStream.schema("label long, vec_id long, x array<double>").parquet(folder)
    stream = stream.select(F.col("label").alias("key"), F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("vec_id") * live.EPOCH_MS).alias("ts"), F.col("vec_id").alias("nth"), "x")
    with phases.rocks(spark):
        alive = live.drain(overlap.cleaned(stream, removers, "label", WINDOW, STEP, CHANNELS, 3_600_000, "1 hour"))
    whole = stored(blocks(rows, ["label"], ORDER, "x"), "blocks")
    at_once = K.sobi_by_recording(whole, ["label"], CHANNELS)
    batch = _after(rows, K.removers(at_once, K.strongest(rows, at_once, ["label"], "x", CHANNELS), ["label"], CHANNELS))
    nth = chunks.select("label", "vec_id").join(ST.numbered(chunks.select("label", "vec_id"), ["label", "vec_id"]), ["label", "vec_id"])
    first = nth.groupBy("label").agg(F.min("i").alias("start"))
    sample = ((F.col("i") - F.col("start")) * EPOCH_SAMPLES + F.col("t")).alias("sample")
    numbered = batch.join(nth, ["label", "vec_id"]).join(first, "label").select("label", sample, "raw", "wanted", "after")
    both = numbered.join(alive.select("label", "sample", F.get("clean", F.lit(0)).alias("live")), ["label", "sample"])
    c = F.col
    return both.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), snr(c("raw"), c("after")).alias("snr_batch"), snr(c("raw"), c("live")).alias("snr_live"), F.corr("raw", "after").alias("corr_batch"), F.corr("raw", "live").alias("corr_live"), F.max(F.abs(c("after") - c("live"))).alias("difference")
    )
