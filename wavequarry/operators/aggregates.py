"""Aggregates that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_mean(x: Column | str, places: int) -> Column:
    """Mean of numbers of so many decimal places, summed as decimals: the same in whatever order rows come."""
    return F.sum((F.col(x) if isinstance(x, str) else x).cast(f"decimal(18,{places})")).cast("double") / F.count(F.lit(1))


#: Digits that a mean's value may have before and after the point to be summed exactly.
_VALUE, _SUM = "decimal(24,6)", "decimal(20,6)"


def exact_sum(x: Column) -> Column:
    """Sum of numbers of six decimal places or fewer without rounding, as a decimal; null if any has more, is not finite, or the sum has over 14 digits before the point.

    A double counts as the shortest decimal that reads back as it.
    """
    value = x.try_cast(_VALUE)
    exact = F.bool_and(F.when(x.isNotNull(), F.coalesce(value.cast("double") == x, F.lit(False))))
    return F.when(exact, F.sum(value)).try_cast(_SUM)


def ordered_mean(x: Column) -> Column:
    """Mean that is the same in whatever order rows come, where ``exact_sum`` can tell; else the plain one."""
    return F.coalesce(exact_sum(x).cast("double") / F.count(x), F.avg(x))


def rounded_quotient(top: Column, bottom: Column, places: int) -> Column:
    """top / bottom (decimals, bottom positive and whole) to ``places``, halves away from zero, as a double; no step rounds but the last."""
    twice = F.abs(top) * F.lit(2 * 10**places).cast("decimal(5,0)") + bottom
    double = bottom * F.lit(2).cast("decimal(1,0)")
    return F.sign(top) * ((twice - twice % double) / double).cast("double") / 10**places


def rounded_mean(x: Column, places: int, scale: int = 1) -> Column:
    """Mean of x times ``scale`` to ``places``, up to four; a mean that lies on a half goes away from zero, in whatever order rows come."""
    exact = rounded_quotient(exact_sum(x) * F.lit(scale).cast("decimal(5,0)"), F.count(x).try_cast("decimal(10,0)"), places)
    return F.when(F.count(x) > 0, F.coalesce(exact, F.round(F.avg(x) * scale, places)))


def rounded_difference(a: Column, b: Column, places: int) -> Column:
    """Mean of a less mean of b to ``places``, up to four, as ``rounded_mean``; null if one has no rows."""
    count = lambda x: F.count(x).try_cast("decimal(10,0)")
    top = (exact_sum(a) * count(b) - exact_sum(b) * count(a)).cast("decimal(32,6)")
    exact = rounded_quotient(top, count(a) * count(b), places)
    return F.when((F.count(a) > 0) & (F.count(b) > 0), F.coalesce(exact, F.round(F.avg(a) - F.avg(b), places)))


def running_variance(x: Column) -> Column:
    """Population variance of an array, by one sample after another in its order.

    The squares are updated as the SQL twins' engine does it, so that a variance
    on a bound falls on the same side.
    """

    def step(state: Column, v: Column) -> Column:
        mean = state["mean"] + (v - state["mean"]) / (state["n"] + 1)
        return F.struct((state["n"] + 1).alias("n"), mean.alias("mean"), (state["squares"] + (v - mean) * (v - state["mean"])).alias("squares"))

    zero = F.lit(0.0)
    last = F.aggregate(x, F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("squares")), step)
    return last["squares"] / F.nullif(last["n"], zero)


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def mad_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``robust_z``: 0.6745 |x - median| / (median absolute deviation + 1e-12) within keys."""
    centre = df.groupBy(*keys).agg(F.median(value).alias("_median"))
    away = df.join(centre, keys).withColumn("_away", F.abs(F.col(value) - F.col("_median")))
    spread = away.groupBy(*keys).agg(F.median("_away").alias("_mad"))
    return away.join(spread, keys).withColumn("robust_z", 0.6745 * F.col("_away") / (F.col("_mad") + 1e-12)).drop("_median", "_away", "_mad")


def snr_db(clean: Column, seen: Column) -> Column:
    """10 log10 of the clean signal's power over that of what was added."""
    return 10 * F.log10(F.sum(clean * clean) / F.sum((seen - clean) * (seen - clean)))


def variation(x: Column) -> Column:
    """Coefficient of variation, 0 where the mean is 0."""
    return F.when(F.avg(x) != 0, F.stddev_pop(x) / F.avg(x)).otherwise(0.0)


def cohens_d(a: Column, b: Column) -> Column:
    """Difference of means over sqrt of the mean population variance; nulls of either column are skipped."""
    return (F.avg(a) - F.avg(b)) / F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
