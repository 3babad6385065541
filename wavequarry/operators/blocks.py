"""Recordings as blocks of consecutive samples, and folds over blocks.

A recording of any length becomes rows of some thousand samples, which tasks
work on at once. What goes from block to block is a row per block.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .stats import running_count

SIZE = 4096


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read again, so that it is made once and survives its executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join by ``columns``, of which nulls match, with the columns of ``left`` and those that ``right`` has besides."""
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in columns})
    on = [left[c].eqNullSafe(named[f"_right_{c}"]) for c in columns]
    return left.join(named, on, how).drop(*[f"_right_{c}" for c in columns])


def blocks(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = SIZE) -> DataFrame:
    """keys, block, first, last, x (samples; those of several channels one after another), at (structs of ``order``): stretches of ``size`` to three times as many samples, shorter recordings whole.

    ``order`` must name a recording's samples. Blocks are cut by the number of
    a sample among all, so no recording passes through one task; stretches at a
    recording's ends, which may be short, are joined to their neighbours.
    """
    several = dict(df.dtypes)[value].startswith("array")
    rows = df.select(*keys, *order, F.col(value).cast("array<double>" if several else "double").alias(value))
    rows = running_count(rows, [*keys, *order], F.lit(1).cast("long"), "_i")
    rows = stored(rows.withColumn("block", F.floor((F.col("_i") - 1) / size)), "numbered")
    ends = rows.groupBy(*keys).agg(F.min("block").alias("_lo"), F.max("block").alias("_hi"))
    whole = F.col("_hi") - F.col("_lo") <= 2
    case = lambda block, to, first, last: F.struct(block.alias("block"), to.alias("_to"), first.alias("_first"), last.alias("_last"))
    lo, hi, yes, no = F.col("_lo"), F.col("_hi"), F.lit(True), F.lit(False)
    short = F.transform(F.sequence(lo, hi), lambda b: case(b, lo, yes, yes))
    long = F.array(case(lo, lo + 1, yes, no), case(hi, hi - 1, no, yes))
    moves = ends.select(*keys, F.inline(F.when(whole, short).otherwise(long)))  # three rows a recording at most
    moved = null_safe(rows, moves, [*keys, "block"], "left").withColumn("block", F.coalesce("_to", "block"))
    samples = F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("x"), F.struct(*order).alias("at"))))
    made = moved.groupBy(*keys, "block").agg(F.coalesce(F.max("_first"), no).alias("first"), F.coalesce(F.max("_last"), no).alias("last"), samples.alias("s"))
    return made.select(*keys, "block", "first", "last", (F.flatten("s.x") if several else F.col("s.x")).alias("x"), F.col("s.at").alias("at"))


def summed(parts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, column: sums of arrays of one length, place by place."""
    long = parts.select(*keys, F.posexplode(column).alias("_place", "_value"))
    places = long.groupBy(*keys, "_place").agg(F.sum("_value").alias("_sum"))
    whole = places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", "_sum"))).alias("_all"))
    return whole.select(*keys, F.col("_all._sum").alias(column))
