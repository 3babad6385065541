"""Synthetic recordings for tests and demonstrations, made by ``spark.range`` and expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 250.0


def unit_noise(row: Column, salt: Column | int) -> Column:
    """Standard normal numbers of a row's hash (Box-Muller), the same in every run."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    u = lambda k: (F.pmod(F.xxhash64(row, salt, F.lit(k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))


def mixed_rhythms(spark: SparkSession, seconds: float, seed: int = 0, noise: float = 0.1, blinks: tuple[float, ...] = (2.0, 6.0), burst: tuple[float, float] = (4.0, 4.5)) -> DataFrame:
    """i, t, ch0..ch3 (clean mixtures), x0..x3 (with noise, blinks on the front channels, a muscle burst on the others)."""
    i = F.col("id")
    t = i / RATE
    sources = [F.sin(2 * math.pi * f * t + p) for f, p in ((10.0, 0.0), (6.0, 0.7), (20.0, 1.3))]
    weights = [[math.cos(1.0 + seed + 2.1 * c + 0.9 * s) for s in range(3)] for c in range(4)]
    clean = [sum((w * s for w, s in zip(row, sources)), F.lit(0.0)) for row in weights]
    blink = sum((F.exp(-((t - at) * (t - at)) / 0.02) for at in blinks), F.lit(0.0)) * 8
    muscle = F.when((t >= burst[0]) & (t < burst[1]), 2.0 * unit_noise(i, seed * 31 + 9)).otherwise(0.0)
    rows = spark.range(int(seconds * RATE))
    cols = [c.alias(f"ch{k}") for k, c in enumerate(clean)]
    cols += [(c + noise * unit_noise(i, seed * 31 + k) + (blink if k < 2 else muscle)).alias(f"x{k}") for k, c in enumerate(clean)]
    return rows.select(i.alias("i"), t.alias("t"), *cols)


def detached_electrode(spark: SparkSession, seconds: float = 10.0, at: float = 6.0, rail: float = 187.5) -> DataFrame:
    """t, signal: a rhythm that ends at the rail when the electrode comes off."""
    t = F.col("id") / RATE
    signal = F.when(t < at, 20 * F.sin(2 * math.pi * 10 * t) + 3 * unit_noise(F.col("id"), 1)).otherwise(F.lit(rail))
    return spark.range(int(seconds * RATE)).select(t.alias("t"), signal.alias("signal"))


def focus_sessions(spark: SparkSession, sessions: int, samples: int = 1000) -> DataFrame:
    """session, i, focus, x: the beta rhythm grows and the alpha rhythm fades with a session's focus (0 to 1)."""
    rows = spark.range(sessions * samples).select(F.floor(F.col("id") / samples).alias("session"), (F.col("id") % samples).alias("i"))
    focus = (F.pmod(F.xxhash64("session"), F.lit(1000)) + 0.5) / 1000
    t = F.col("i") / RATE
    x = (1.5 - focus) * F.sin(2 * math.pi * 10 * t) + (0.5 + focus) * F.sin(2 * math.pi * 20 * t) + 0.5 * unit_noise(F.col("session") * samples + F.col("i"), 3)
    return rows.select("session", "i", focus.alias("focus"), x.alias("x"))


def autoregressive(spark: SparkSession, series: int, samples: int, frequency: float = 10.0, damping: float = 0.95) -> DataFrame:
    """series, i, x: second-order resonators driven by noise, by the closed form of the recursion cut where it has died away."""
    w = 2 * math.pi * frequency / RATE
    last = int(math.log(1e-3) / math.log(damping)) + 1
    gains = [damping**k * math.sin((k + 1) * w) / math.sin(w) for k in range(last)]
    rows = spark.range(series * samples).select(F.floor(F.col("id") / samples).alias("series"), (F.col("id") % samples).alias("i"))
    key = F.col("series") * (samples + last) + F.col("i")
    terms = F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda k: F.get(F.array(*map(F.lit, gains)), k) * unit_noise(key + last - k, 7))
    return rows.select("series", "i", F.aggregate(terms, F.lit(0.0), lambda a, v: a + v).alias("x"))


STATES = ("REST", "WORKLOAD", "MOTOR")
# Chances of each state a second after each state.
NEXT_STATE = ((0.95, 0.04, 0.01), (0.05, 0.93, 0.02), (0.08, 0.02, 0.90))


def uniform_noise(row: Column, salt: Column | int) -> Column:
    """Numbers from 0 to 1 (excluded) of a row's hash, the same in every run."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    return F.pmod(F.xxhash64(row, salt), F.lit(1 << 40)) / float(1 << 40)


def markov_states(spark: SparkSession, chains: int, seconds: int, chances: tuple[tuple[float, ...], ...] = NEXT_STATE, states: tuple[str, ...] = STATES, seed: int = 0) -> DataFrame:
    """chain, second, state: Markov chains that start in the first state.

    All states read the same draw of a second, so a draw that leads every state
    to one makes the past irrelevant. A row therefore folds only so many seconds
    back as leave no such draw with a chance below 1e-12, and needs no other row.
    """
    upto = [[sum(row[: k + 1]) for k in range(len(row))] for row in chances]
    shared = sum(max(0.0, min(c[k] for c in upto) - max(c[k - 1] if k else 0.0 for c in upto)) for k in range(len(states)))
    if not shared:
        raise ValueError("no draw leads all states to one")
    back = int(math.log(1e-12) / math.log1p(-shared)) + 1 if shared < 1 else 1

    def after(state: Column, step: Column) -> Column:
        draw = uniform_noise(F.col("chain"), seed * 31 + step)
        bounds = F.get(F.array(*[F.array(*map(F.lit, c[:-1])) for c in upto]), state)
        return F.aggregate(bounds, F.lit(0), lambda n, b: n + (draw >= b).cast("int"))

    rows = spark.range(chains * seconds).select(F.floor(F.col("id") / seconds).alias("chain"), (F.col("id") % seconds).alias("second"))
    steps = F.when(F.col("second") > 0, F.sequence(F.greatest(F.lit(1), F.col("second") - back), F.col("second"))).otherwise(F.array().cast("array<bigint>"))
    number = F.aggregate(steps, F.lit(0), after)
    return rows.select("chain", "second", F.get(F.array(*map(F.lit, states)), number).alias("state"))


def pink_noise(row: Column, salt: int, octaves: int = 12) -> Column:
    """Noise whose power falls as 1/f: the sum of normal numbers that are held for 1, 2, 4, ... rows; its variance is 1."""
    held = [unit_noise(F.shiftright(row, k), salt * 64 + k) for k in range(octaves)]
    return sum(held[1:], held[0]) / math.sqrt(octaves)


def poisson_pulses(spark: SparkSession, seconds: float, rate: float, width: float = 0.1, height: float = 1.0, seed: int = 0) -> DataFrame:
    """i, t, x: bell-shaped pulses (blinks, twitches) that begin at random, ``rate`` a second on average."""
    i, reach = F.col("id"), int(3 * width * RATE)
    begins = lambda k: F.when(uniform_noise(k, seed) < rate / RATE, 1.0).otherwise(0.0)
    shape = lambda lag: height * F.exp(-((lag / RATE / width) ** 2))
    near = F.sequence(F.lit(-reach), F.lit(reach))
    x = F.aggregate(near, F.lit(0.0), lambda a, lag: a + F.when(i >= lag, begins(i - lag) * shape(lag)).otherwise(0.0))
    return spark.range(int(seconds * RATE)).select(i.alias("i"), (i / RATE).alias("t"), x.alias("x"))
