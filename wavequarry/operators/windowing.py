"""Windows by count and by time over ordered samples.

Count windows follow two conventions. Sliding windows start at 0, step, 2 step
... below n - size, so a window that ends exactly at the last sample is left
out. Trailing windows end at every step-th sample once size samples are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_windows(df: DataFrame, keys: list[str], idx: str, size: int, step: int) -> DataFrame:
    """One row per sample and sliding window ``win`` that holds it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    first = F.greatest(F.lit(0), F.ceil((F.col(idx) - size + 1) / step)).cast("long")
    last = F.floor(F.col(idx) / step).cast("long")
    return df.withColumn("_n", n).withColumn("win", F.explode(F.sequence(first, last, F.lit(1).cast("long")))).where(F.col("win") * step < F.col("_n") - size).drop("_n")


def trailing(keys: list[str], order: list[str], size: int) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)


def emit_every(df: DataFrame, keys: list[str], order: list[str], size: int, step: int, **aggregates: Column) -> DataFrame:
    """Aggregates of the last ``size`` samples, at every ``step``-th sample from the ``size``-th on; rn counts from 1."""
    w = trailing(keys, order, size)
    rows = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return rows.withColumns({name: c.over(w) for name, c in aggregates.items()}).where((F.col("rn") >= size) & (F.col("rn") % step == 0))


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, majority, votes: the most frequent label, the smallest of several."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("less"), F.col(label).alias("label")))
    return counts.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.label").alias("majority"), (-F.col("best.less")).alias("votes"))


def majority_of(labels: Column) -> Column:
    """The most frequent element of an array, the smallest of several."""
    votes = F.transform(F.array_distinct(labels), lambda c: F.struct((-F.size(F.filter(labels, lambda x: x == c))).alias("less"), c.alias("label")))
    return F.array_min(votes)["label"]


def smooth_majority(df: DataFrame, keys: list[str], order: list[str], label: str, size: int) -> DataFrame:
    """Add ``smoothed``: the majority of the last ``size`` labels, null until there are so many."""
    recent = df.withColumn("_recent", F.collect_list(label).over(trailing(keys, order, size)))
    return recent.withColumn("smoothed", F.when(F.size("_recent") == size, majority_of(F.col("_recent")))).drop("_recent")


def lost_packets(df: DataFrame, keys: list[str], order: list[str], seq: str, modulus: int) -> DataFrame:
    """Add ``lost``: packets missing before this one, by a counter that wraps at ``modulus``."""
    before = F.lag(seq).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("lost", F.coalesce(F.pmod(F.col(seq) - before - 1, F.lit(modulus)), F.lit(0)))


def sessions_by_gap(df: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Add ``session``: counts up where the time since the last row is over ``seconds``."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(w).cast("timestamp").cast("double")
    return df.withColumn("_new", (F.coalesce(gap, F.lit(0.0)) > seconds).cast("long")).withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def overlap_add(windows: DataFrame, keys: list[str], sample: str, order: str, value: str) -> DataFrame:
    """keys, sample, merged: each window's value averaged half and half with what was there, in order of the windows."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    rows = windows.groupBy(*keys, sample).agg(values.alias("_v"))
    merged = F.aggregate(F.slice("_v", F.lit(2), F.size("_v")), F.get("_v", F.lit(0)), lambda a, v: 0.5 * a + 0.5 * v)
    return rows.select(*keys, sample, merged.alias("merged"))


def exponential_mean(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """keys, n, ew: the last value of m = (1 - alpha) m + alpha x from m = x at the first sample.

    The last value is a weighted sum, so no recording is held: sample k from
    the end weighs alpha (1 - alpha)^k, and the first one (1 - alpha)^(n - 1).
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_k", F.row_number().over(w.orderBy(*[F.desc(c) for c in order])) - 1)
    n = F.count(F.lit(1))
    first = F.max_by(value, "_k") * F.pow(F.lit(1 - alpha), n - 1) * (1 - alpha)  # what the sum lacks of the first sample's weight
    return rows.groupBy(*keys).agg(n.alias("n"), (F.sum(F.col(value) * alpha * F.pow(F.lit(1 - alpha), F.col("_k"))) + first).alias("ew"))
