"""Joins of samples with intervals, bands, folds and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_slice(samples: DataFrame, intervals: DataFrame, keys: list[str], idx: str, start: str, stop: str, width: int) -> DataFrame:
    """Samples with start <= idx < stop of the intervals of their recording.

    Both sides are put in cells of ``width`` samples, an interval in each cell
    that it meets, so that the join has an equality in idx and a long recording
    is no single key.
    """
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))
    placed = samples.withColumn("_cell", F.floor(F.col(idx) / width))
    return placed.join(cells, [*keys, "_cell"]).where((F.col(idx) >= F.col(start)) & (F.col(idx) < F.col(stop))).drop("_cell")


def band_join(bins: DataFrame, bands: DataFrame, freq: str) -> DataFrame:
    """Bins of each band, lo <= freq < hi; ``bands`` is a handful of rows."""
    return bins.join(F.broadcast(bands), (F.col(freq) >= F.col("lo")) & (F.col(freq) < F.col("hi")))


def paired(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of both, rows of a alone, rows of b alone) by key."""
    return a.join(b, key), a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def zipped(a: DataFrame, b: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The i-th row of ``a`` with the i-th of ``b`` within keys, in order; the longer side's rest has no partner."""
    w = Window.partitionBy(*keys).orderBy(*order)
    i = F.row_number().over(w).cast("long")
    left = a.withColumn("i", i).select(*keys, "i", *(F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys))
    right = b.withColumn("i", i).select(*keys, "i", *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    return left.join(right, [*keys, "i"])
