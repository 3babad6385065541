"""Resampling and rank statistics as DataFrame jobs.

Draws are 32 bits of the MD5 of (draw, position), so that any engine can repeat
them and neither neighbouring draws nor neighbouring positions have to do with
one another. Up to FEW_VALUES values a task has them all and makes resamples by
itself, array by array; beyond, draws times positions rows are made, joined and
reduced by partial aggregation. Sign flips need a task's own rows only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: Draws are numbers below this.
BOUND = 1 << 32
#: Draws that one digest holds.
LANES = 4
#: Rows up to which resampled values are broadcast; beyond, they and the picks are shuffled.
FEW_VALUES = 1_000_000
#: Digests that one task makes, some seconds' work.
TASK_DIGESTS = 4_000_000


def drawn(rows: DataFrame, draws: int) -> DataFrame:
    """A row for each row (i and others) and each b below ``draws``, with draw, a number below BOUND."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((draws - 1) // LANES).cast("long"))))
    digest = F.md5(F.concat_ws("-", "_block", "i").cast("binary"))
    lanes = F.array(*[F.struct((F.col("_block") * LANES + k).alias("b"), F.substring("_digest", 8 * k + 1, 8).alias("hex")) for k in range(LANES)])
    found = blocks.withColumn("_digest", digest).select(*rows.columns, F.inline(lanes)).where(F.col("b") < draws)
    return found.withColumn("draw", F.conv("hex", 16, 10).cast("long")).drop("hex")


def _lanes(block: int, positions: list[bytes]) -> np.ndarray:
    """The draws of ``drawn`` of a block's LANES at each of some positions (decimal), uint32."""
    head = b"%d-" % block
    return np.frombuffer(b"".join([md5(head + p, usedforsecurity=False).digest() for p in positions]), ">u4").reshape(-1, LANES)


def _tasks(df: DataFrame, digests: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-digests // TASK_DIGESTS))


def scattered(number: Column) -> Column:
    """A number below BOUND for each long: 32 bits of the MD5 of its decimal text."""
    return F.conv(F.substring(F.md5(number.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def running_count(df: DataFrame, order: list[str], count: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``count`` over the rows up to this one in order (which must name rows), without a window over all rows.

    Rows are dealt by range and each range sums by itself; the ranges' totals,
    one row each, are summed in order.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    path = f"{shared_dir(spark)}/ranges-{uuid.uuid4().hex}"
    parts.write.parquet(path)
    rows = spark.read.schema(parts.schema).parquet(path)
    totals = rows.groupBy("_part").agg(F.sum(count).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))  # one row per range
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_own", F.sum(count).over(within)).join(F.broadcast(totals), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Add i from 0 by ``order``, which must name rows, and the row count n."""
    counted = running_count(df, order, F.lit(1).cast("long"), "i").withColumn("i", F.col("i") - 1)
    return counted.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))))  # one row


def _resampled(values: DataFrame, columns: list[str], draws: int, of_arrays: Callable[..., float | None]) -> DataFrame:
    """b, statistic: ``of_arrays`` of each resample's columns, for values that a task can have whole."""
    spark = values.sparkSession
    table = values.select("i", *columns).toArrow().sort_by("i")
    n, blocks = table.num_rows, -(-draws // LANES)
    held = spark.sparkContext.broadcast([table.column(c).to_numpy() for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        positions = [b"%d" % i for i in range(n)]
        for batch in batches:
            for block in batch["id"]:
                picks = (_lanes(block, positions).astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                lanes = range(min(LANES, draws - block * LANES))
                yield pd.DataFrame({"b": [block * LANES + k for k in lanes], "statistic": pd.array([of_arrays(*[x[picks[:, k]] for x in held.value]) for k in lanes], "Float64")})

    return spark.range(0, blocks if n else 0, 1, min(_tasks(values, n * blocks), blocks)).mapInPandas(run, "b long, statistic double")


def bootstrap(values: DataFrame, columns: list[str], draws: int, statistic: Column, of_arrays: Callable[..., float | None] | None = None) -> DataFrame:
    """b, statistic: any aggregate over ``columns`` (without nulls) of each of ``draws`` resamples with replacement of rows (i, n, columns).

    ``of_arrays`` gives the same of arrays; without it, or where there are too
    many values for a task, rows are joined to the picks and aggregated.
    """
    few = values.count() <= FEW_VALUES
    if few and of_arrays:
        return _resampled(values, columns, draws, of_arrays)
    picks = drawn(values.select("i", "n"), draws).select("b", F.shiftright(F.col("draw") * F.col("n"), 32).alias("pick"))
    picked = values.select(F.col("i").alias("pick"), *columns)
    # Spark takes the picks for as few as the values, and would broadcast them.
    picked = F.broadcast(picked) if few else picked.hint("shuffle_hash")
    return picks.join(picked, "pick").groupBy("b").agg(statistic.alias("statistic"))


def correlation(a: np.ndarray, c: np.ndarray) -> float | None:
    """Pearson's; None if a side has one value only."""
    if a.min() == a.max() or c.min() == c.max():
        return None
    a, c = a - a.mean(), c - c.mean()
    return float(a @ c / np.sqrt((a @ a) * (c @ c)))


def numbered_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add i from 0 by ``order``, which must name a key's rows, and the key's row count n; no key passes through one task."""
    counted = running_count(df, [key, *order], F.lit(1).cast("long"), "_at")
    sizes = counted.groupBy(key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    return counted.join(sizes, key).withColumn("i", F.col("_at") - F.col("_first")).drop("_at", "_first")


def bootstrap_by(values: DataFrame, key: str, order: str, columns: list[str], draws: int, statistics: dict[str, Column]) -> DataFrame:
    """key, b and statistics over ``columns`` of each of ``draws`` resamples with replacement of each key's rows.

    All keys draw by the same digests of (b, i), which is no matter as keys are
    looked at one by one. Rows without key are left out.
    """
    rows = numbered_by(values.where(F.col(key).isNotNull()), key, [order])
    picks = drawn(rows.select(key, "i", "n"), draws).select(key, "b", F.shiftright(F.col("draw") * F.col("n"), 32).alias("i"))
    picked = rows.select(key, "i", *columns)
    picked = F.broadcast(picked) if values.count() <= FEW_VALUES else picked.hint("shuffle_hash")
    return picks.join(picked, [key, "i"]).groupBy(key, "b").agg(*[c.alias(name) for name, c in statistics.items()])


def bootstrap_means(values: DataFrame, value: str, draws: int) -> DataFrame:
    """b, mean: the means of ``draws`` resamples with replacement of rows (i, n, value)."""
    return bootstrap(values, [value], draws, F.avg(value), np.mean).withColumnRenamed("statistic", "mean")


def sign_flip_means(values: DataFrame, value: str, draws: int) -> DataFrame:
    """b, mean: means with every value's sign drawn anew.

    A task sums its own rows for all draws. Values of four places or fewer are
    summed as whole numbers, so that means that are equal come out equal.
    """
    n, blocks = values.count(), -(-draws // LANES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((blocks, LANES))
        for batch in batches:
            positions, v = [b"%d" % i for i in batch["i"]], batch["v"].to_numpy(float)
            whole = np.rint(v * 1e4)
            v = np.where(whole / 1e4 == v, whole, v * 1e4)
            total = v.sum()
            for block in range(blocks if len(v) else 0):
                sums[block] += 2 * (v @ (_lanes(block, positions) >> 31).astype(float)) - total
        if sums.any():
            yield pd.DataFrame({"b": np.arange(draws), "s": sums.ravel()[:draws]})

    rows = values.select("i", F.col(value).cast("double").alias("v")).where("v is not null").repartition(_tasks(values, n * blocks), "i")
    sums = rows.mapInPandas(run, "b long, s double")
    every = values.sparkSession.range(draws).select(F.col("id").alias("b"), F.lit(0.0).alias("s"))
    known = values.agg(F.count(value).alias("_n")).where("_n > 0")  # one row
    return sums.union(every).groupBy("b").agg(F.sum("s").alias("s")).crossJoin(F.broadcast(known)).select("b", (F.col("s") / 1e4 / F.col("_n")).alias("mean"))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Add ``rank`` (from 1, ties share their mean) and ``ties`` (rows with that value).

    Counts per value are ranked, not rows, so only distinct values are ordered.
    """
    counts = running_count(df.groupBy(value).agg(F.count(F.lit(1)).alias("ties")), [value], F.col("ties"), "_upto")
    return df.join(counts.withColumn("rank", F.col("_upto") - (F.col("ties") - 1) / 2).drop("_upto"), value)


def wilcoxon(differences: DataFrame, d: str) -> DataFrame:
    """n, w, z of the signed-rank test without zeros: w is the smaller rank sum, z its normal score with tie correction.

    All differences zero: n is 0 and w, z are null.
    """
    rows = average_ranks(differences.where(F.col(d) != 0).select(d, F.abs(d).alias("size")), "size")
    n = F.count(F.lit(1))
    plus, minus = (F.coalesce(F.sum(F.when(c, F.col("rank"))), F.lit(0.0)) for c in (F.col(d) > 0, F.col(d) < 0))
    sums = rows.agg(n.alias("n"), plus.alias("plus"), minus.alias("minus"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tied"))
    variance = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("tied") / 48
    w = F.when(F.col("n") > 0, F.least("plus", "minus"))
    return sums.select("n", w.alias("w"), F.when(F.col("n") > 0, (w - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(variance)).alias("z"))


def mann_whitney(df: DataFrame, value: str, is_a: Column) -> DataFrame:
    """n_a, n_b, u, z of rows where ``is_a`` against the others, z with tie correction; greater means that a is larger."""
    rows = average_ranks(df.select(value, is_a.alias("is_a")), value)
    sums = rows.agg(F.count_if("is_a").alias("n_a"), F.count_if(~F.col("is_a")).alias("n_b"), F.sum(F.when(F.col("is_a"), F.col("rank"))).alias("r"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tied"))
    a, b = F.col("n_a"), F.col("n_b")
    n, u = a + b, F.col("r") - a * (a + 1) / 2
    variance = a * b / 12 * (n + 1 - F.col("tied") / (n * (n - 1)))
    return sums.select("n_a", "n_b", u.alias("u"), ((u - a * b / 2) / F.sqrt(variance)).alias("z"))


def mann_whitney_by(df: DataFrame, key: str, value: str, is_a: Column) -> DataFrame:
    """key, n_a, n_b, u, z of each key's rows where ``is_a`` against its others, as ``mann_whitney``; z is null if all values are equal or a side is empty."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_t"), F.count_if(is_a).alias("_a"))
    upto = running_count(counts, [key, value], F.col("_t"), "_upto")
    first = upto.groupBy(key).agg(F.min(F.col("_upto") - F.col("_t")).alias("_before"))
    ranked = upto.join(first, key).withColumn("_rank", F.col("_upto") - F.col("_before") - (F.col("_t") - 1) / 2)
    t = F.col("_t").cast("double")
    sums = ranked.groupBy(key).agg(F.sum("_a").alias("n_a"), (F.sum("_t") - F.sum("_a")).alias("n_b"), F.sum(F.col("_rank") * F.col("_a")).alias("_r"), F.sum(t * t * t - t).alias("_tied"))
    a, b = F.col("n_a"), F.col("n_b")
    n, u = a + b, F.col("_r") - a * (a + 1) / 2
    spread = F.sqrt(a * b / 12 * (n + 1 - F.col("_tied") / F.nullif(n * (n - 1), F.lit(0))))
    return sums.select(key, "n_a", "n_b", u.alias("u"), ((u - a * b / 2) / F.nullif(spread, F.lit(0.0))).alias("z"))


def binomial_tail(df: DataFrame, k: str, n: str) -> DataFrame:
    """Add ``p``: probability of at least k of n heads.

    Terms follow from one another: ln C(n, x + 1) = ln C(n, x) + ln(n - x) -
    ln(x + 1), so one fold over the outcomes gives them all.
    """
    start = F.struct((-F.col(n) * F.log(F.lit(2.0))).alias("term"), F.when(F.col(k) <= 0, F.exp(-F.col(n) * F.log(F.lit(2.0)))).otherwise(F.lit(0.0)).alias("p"))

    def step(state: Column, x: Column) -> Column:
        term = state["term"] + F.log((F.col(n) - x + 1).cast("double")) - F.log(x.cast("double"))
        return F.struct(term.alias("term"), (state["p"] + F.when(x >= F.col(k), F.exp(term)).otherwise(0.0)).alias("p"))

    one = F.lit(1).cast("long")
    outcomes = F.when(F.col(n) >= 1, F.sequence(one, F.greatest(F.col(n), one))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("p", F.aggregate(outcomes, start, step)["p"])


def least_of_each(df: DataFrame, group: str, order: list[str], bound: int, cells: int = 4096) -> DataFrame:
    """The first rows of each group by ``order``, as many as the smallest group has.

    ``order`` starts with a number below ``bound``. Its values are counted in
    cells: whole cells that lie before the last row are taken as they are, and
    only the rows of the cell that holds it are put in order.
    """
    cell = F.floor(F.col(order[0]) * cells / bound).alias("_cell")
    counts = df.groupBy(group, cell).agg(F.count(F.lit(1)).alias("_n"))  # cells x groups rows
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    least = counts.groupBy(group).agg(F.sum("_n").alias("_all")).agg(F.min("_all").alias("_least"))
    open_ = counts.crossJoin(F.broadcast(least)).where("_before < _least")  # one row
    placed = df.withColumn("_cell", F.floor(F.col(order[0]) * cells / bound)).join(open_, [group, "_cell"])
    whole = placed.where("_before + _n <= _least")
    nth = F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order))
    cut = placed.where("_before + _n > _least").withColumn("_nth", nth).where("_before + _nth <= _least").drop("_nth")
    return whole.unionByName(cut).select(*df.columns)
