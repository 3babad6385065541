"""Spectra of short epochs by the discrete Fourier sum, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import EPOCH_SAMPLES

#: Sampling rate that epochs are read at, so that bins are 8 Hz apart.
RATE = 128.0
BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}


def powers(x: Column, n: int = EPOCH_SAMPLES) -> Column:
    """Array of |X_k|^2, k = 0..n/2, of an array of n samples."""
    wave = lambda f, k: F.array(*[F.lit(f(2 * math.pi * k * t / n)) for t in range(n)])
    waves = F.array(*[F.struct(wave(math.cos, k).alias("cos"), wave(math.sin, k).alias("sin")) for k in range(n // 2 + 1)])
    dot = lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.transform(waves, lambda w: dot(w["cos"]) * dot(w["cos"]) + dot(w["sin"]) * dot(w["sin"]))


def bands(spark: SparkSession) -> DataFrame:
    """band, lo, hi."""
    rows = [F.struct(F.lit(b).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for b, (lo, hi) in BANDS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def entropy(power: Column) -> Column:
    """Spectral entropy without the constant part, over log2 of the number of bins: 0 to 1."""
    rest = F.slice(power, F.lit(2), F.size(power) - 1)
    total = F.aggregate(rest, F.lit(0.0), lambda a, p: a + p)
    bits = F.aggregate(rest, F.lit(0.0), lambda a, p: a - F.when(p > 0, (p / total) * F.log2(p / total)).otherwise(0.0))
    return bits / F.log2(F.size(rest).cast("double"))
