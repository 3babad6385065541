"""Packets, logs, profiles and narration: text and binary forms of the feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a frame: id, four channels, hardware time, status; little-endian.
FRAME_BYTES = 14


def _little_endian(frame: Column, at: int, size: int) -> Column:
    """Unsigned number of ``size`` bytes from byte ``at`` (from 0) of a binary column."""
    digits = F.hex(F.substring(frame, at + 1, size))
    swapped = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("long")


def _signed16(x: Column) -> Column:
    return F.when(x >= 32768, x - 65536).otherwise(x)


def decode_frames(df: DataFrame, frame: str) -> DataFrame:
    """Add packet_id, ch1..ch4, hw_time, status; frames of another length are dropped."""
    b = F.col(frame)
    rows = df.where(F.octet_length(b) == FRAME_BYTES)
    fields = {"packet_id": _little_endian(b, 0, 1)} | {f"ch{k + 1}": _signed16(_little_endian(b, 1 + 2 * k, 2)) for k in range(4)}
    return rows.withColumns(fields | {"hw_time": _little_endian(b, 9, 4), "status": _little_endian(b, 13, 1)})


def encode_frames(df: DataFrame, packet_id: Column, channels: list[Column], hw_time: Column, status: Column, name: str = "frame") -> DataFrame:
    """Add a binary frame of the values, each wrapped to its field."""

    def field(x: Column, size: int) -> Column:
        digits = F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 8 * size))), 2 * size, "0")
        return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])

    return df.withColumn(name, F.unhex(F.concat(field(packet_id, 1), *[field(c, 2) for c in channels], field(hw_time, 4), field(status, 1))))


def parse_fold_lines(df: DataFrame, line: str) -> DataFrame:
    """block, subject and the scores of lines like ``[block 1] subject 007: raw=61.5 tangent=70.0``; other lines are dropped."""
    pattern = r"\[block (\d+)\] subject (\d+): raw=([\d.]+) tangent=([\d.]+)"
    part = lambda k, kind: F.regexp_extract(line, pattern, k).cast(kind)
    rows = df.where(F.col(line).rlike(pattern))
    return rows.select(part(1, "long").alias("block"), part(2, "long").alias("subject"), part(3, "double").alias("raw"), part(4, "double").alias("tangent"))


#: The form of a line with a subject's four scores in percent, and their names.
SCORE_LINE = r"S(\d+)\s+fold\s*\|\s*RF Raw:\s*([\d.]+)%\s*\|\s*TSA:\s*([\d.]+)%\s*\|\|\s*SVM Raw:\s*([\d.]+)%\s*\|\s*Gated SVM:\s*([\d.]+)%"
SCORES = ["rf_raw", "tangent", "svm_raw", "svm_gated"]


def parse_score_lines(df: DataFrame, line: str) -> DataFrame:
    """subject and four scores of each line that has them; other lines are dropped."""
    part = lambda k: F.regexp_extract(line, SCORE_LINE, k)
    scores = [part(k + 2).cast("double").alias(name) for k, name in enumerate(SCORES)]
    return df.where(F.col(line).rlike(SCORE_LINE)).select(part(1).cast("long").alias("subject"), *scores)


def narrate(state: Column, before: Column, first: Column, share: Column) -> Column:
    """One sentence for a recording's last state, the one before, the first, and the share of engaged samples."""
    return (
        F.when((state == "ENGAGED") & (before == "RESTING"), F.lit("Attention has just picked up."))
        .when((state == "RESTING") & (before == "ENGAGED"), F.lit("Attention is fading."))
        .when((state == "ENGAGED") & (first == "RESTING"), F.lit("The session turned from rest to focus."))
        .when(share >= 0.5, F.lit("Focus is holding."))
        .otherwise(F.lit("A calm stretch."))
    )


def confidence(distance: Column) -> Column:
    """50 to 95 percent, by how far a decision lies from its boundary."""
    return 50 + F.least(10 * F.abs(distance), F.lit(45.0))


def narrate_by_priority(state: Column, before: Column, past: Column, blinks: Column, clenches: Column, certainty: Column, deep: float | None) -> Column:
    """Name of the sentence for a session: noise first, then a change of state that has lasted two steps, then the state; null states match nothing.

    ``deep`` is the confidence above which engagement is called deep; without it all of it is.
    """
    stays = lambda now, then: (state == now) & (before == now) & (past == then)
    told = F.when(clenches >= 2, "muscle").when(blinks >= 10, "eyes").when(stays("ENGAGED", "RESTING"), "onset").when(stays("RESTING", "ENGAGED"), "fading")
    if deep is not None:
        told = told.when((state == "ENGAGED") & (certainty <= deep), "steady")
    return told.when(state == "ENGAGED", "deep").otherwise("rest")
