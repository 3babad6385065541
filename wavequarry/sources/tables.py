"""Views of the stored tables as recordings, epochs, sessions and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An embedding of 64 numbers is read as an epoch of 16 samples of 4 channels.
EPOCH_SAMPLES, CHANNELS = 16, 4
ENGAGED = ("click", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order() -> Window:
    """A recording's samples in order: by time, then by event."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id (the recording), idx from 0, event_id, ts, event_type (the channel), value."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return events.withColumn("idx", F.row_number().over(in_order()).cast("long") - 1)


def epoch_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x: array of 64 doubles, sample-major."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def channel(x: Column, ch: int) -> Column:
    """The samples of one channel of an epoch array."""
    return F.transform(F.sequence(F.lit(0), F.lit(EPOCH_SAMPLES - 1)), lambda t: F.get(x, t * CHANNELS + ch))


def epoch_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, t, ch, x: one row per sample and channel."""
    rows = epoch_arrays(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("p", "x"))
    return rows.select("vec_id", "label", F.floor(F.col("p") / CHANNELS).alias("t"), (F.col("p") % CHANNELS).cast("long").alias("ch"), "x")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, activity_name: a user's day, named by its first event."""
    events = table(spark, sf_dir, "events")
    first = F.min_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(first.alias("activity_name"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, decoded_state, stability_score."""
    state = F.when(F.col("event_type").isin(*ENGAGED), "ENGAGED").otherwise("RESTING")
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), state.alias("decoded_state"), F.col("value").alias("stability_score"))
