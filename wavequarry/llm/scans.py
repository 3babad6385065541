"""Running sums by key over ranges, so that no key passes through one task, however many rows it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def running_sums(df: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add for each of ``sums`` its total over the key's rows up to this one by ``order`` (null first), which must name rows; ``key`` must not be null.

    Rows are dealt by ranges of (key, order) and written; each range adds up by
    itself. A range goes on from earlier ones in its first key only, so what is
    carried over is at most one row per range, and that is broadcast. ``df`` is
    read twice, once to find the ranges: give it a written table.
    """
    rows = cut(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    names = list(sums)
    totals = rows.groupBy(key, "_part").agg(*[F.sum(sums[c]).alias(c) for c in names])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_part", *[F.sum(c).over(earlier).alias(f"_before_{c}") for c in names]).where(" or ".join(f"_before_{c} is not null" for c in names))
    within = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *[F.coalesce(F.sum(sums[c]).over(within), F.lit(0)).alias(c) for c in names])
    found = own.join(F.broadcast(carried), [key, "_part"], "left")
    return found.select(*df.columns, *[(F.coalesce(f"_before_{c}", F.lit(0)) + F.col(c)).alias(c) for c in names])
