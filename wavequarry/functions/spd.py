"""Covariance matrices of epochs as column expressions, and 2x2 closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import CHANNELS


def epoch_moments(samples: DataFrame) -> DataFrame:
    """vec_id, label, i, j (i <= j), c: population covariances of channels, from rows (vec_id, label, t, ch, x)."""
    a = samples.select("vec_id", "label", "t", F.col("ch").alias("i"), F.col("x").alias("xi"))
    b = samples.select("vec_id", "t", F.col("ch").alias("j"), F.col("x").alias("xj"))
    return a.join(b, ["vec_id", "t"]).where("i <= j").groupBy("vec_id", "label", "i", "j").agg(F.covar_pop("xi", "xj").alias("c"))


def covariance(x: Column, i: int, j: int, n: int, ddof: int = 0) -> Column:
    """Covariance of channels i and j of a sample-major epoch array of n samples."""
    at = lambda t, c: F.get(x, F.lit(t * CHANNELS + c))
    mean = lambda c: sum((at(t, c) for t in range(1, n)), at(0, c)) / n
    cross = sum((at(t, i) * at(t, j) for t in range(1, n)), at(0, i) * at(0, j))
    return (cross - n * mean(i) * mean(j)) / (n - ddof)


def eigen2(a: Column, b: Column, d: Column) -> tuple[Column, Column]:
    """Eigenvalues, larger first, of [[a, b], [b, d]]."""
    half, root = (a + d) / 2, F.sqrt((a - d) * (a - d) / 4 + b * b)
    return half + root, half - root


def distance2(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> Column:
    """Affine-invariant distance of 2x2 matrices (a, b, d): from the trace and determinant of P^-1 Q."""
    (pa, pb, pd), (qa, qb, qd) = p, q
    det_p, det_q = pa * pd - pb * pb, qa * qd - qb * qb
    trace, det = (pd * qa - 2 * pb * qb + pa * qd) / det_p, det_q / det_p
    root = F.sqrt(F.greatest(trace * trace / 4 - det, F.lit(0.0)))
    one, two = F.log(trace / 2 + root), F.log(trace / 2 - root)
    return F.sqrt(one * one + two * two)


def logdet_divergence2(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> Column:
    """trace(P^-1 Q) - ln det(P^-1 Q) - 2, at least 0."""
    (pa, pb, pd), (qa, qb, qd) = p, q
    det_p, det_q = pa * pd - pb * pb, qa * qd - qb * qb
    return F.greatest((pd * qa - 2 * pb * qb + pa * qd) / det_p - F.log(det_q / det_p) - 2, F.lit(0.0))


def log2x2(a: Column, b: Column, d: Column) -> tuple[Column, Column, Column]:
    """Upper triangle of the matrix logarithm, off-diagonal times sqrt 2."""
    high, low = eigen2(a, b, d)
    slope = (F.log(high) - F.log(low)) / (high - low)
    base = F.log(high) - slope * high
    return base + slope * a, F.sqrt(F.lit(2.0)) * slope * b, base + slope * d
