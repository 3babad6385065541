"""Recordings, logs and packets in files, all read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packets import FRAME_BYTES, decode_frames


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_signal_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named number columns of CSV files with a header; rows that are short or hold anything else are left out."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    cast = rows.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in columns])
    return cast.dropna()


def read_matrix_text(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """file, x: the numbers of each line of white-space separated text; lines of another width are left out."""
    parts = F.transform(F.split(F.trim("value"), r"\s+"), lambda s: s.try_cast("double"))
    rows = spark.read.text(path).select(file_name().alias("file"), parts.alias("x"))
    return rows.where((F.size("x") == columns) & ~F.exists("x", lambda v: v.isNull()))


def paired_files(spark: SparkSession, path: str, low: str, high: str) -> DataFrame:
    """subject, low, high: files whose names differ in their endings only."""
    names = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    of = lambda ending, name: names.where(F.col("name").endswith(ending)).select(F.expr(f"left(name, length(name) - {len(ending)})").alias("subject"), F.col("name").alias(name))
    return of(low, "low").join(of(high, "high"), "subject")


def latest_file(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """path, modificationTime of the newest file with that ending, the last by name of several; one row or none."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime").where(F.col("path").endswith(ending))
    return files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1)


def read_log_blocks(spark: SparkSession, path: str, marker: str, required: bool = False) -> DataFrame:
    """file, block (from 1), line: lines after the first marker line, by the marker before them.

    A file without the marker has no rows, or fails the job if ``required``.
    """
    whole = spark.read.text(path, wholetext=True).select(file_name().alias("file"), F.split("value", marker).alias("parts"))
    if required:
        missing = F.raise_error(F.concat(F.lit("no marker in "), "file"))
        whole = whole.withColumn("parts", F.when(F.size("parts") > 1, F.col("parts")).otherwise(missing.cast("array<string>")))
    blocks = whole.select("file", F.posexplode("parts").alias("block", "text")).where("block > 0")
    return blocks.select("file", "block", F.explode(F.split("text", r"\r?\n")).alias("line")).where("trim(line) != ''")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Decoded frames of binary files that hold one after another; a cut last frame is left out."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    n = F.floor(F.octet_length("content") / FRAME_BYTES).cast("int")
    at = files.where(n > 0).withColumn("at", F.explode(F.sequence(F.lit(0), n - 1)))
    frames = at.select("file", "at", F.expr(f"substring(content, at * {FRAME_BYTES} + 1, {FRAME_BYTES})").alias("frame"))
    return decode_frames(frames, "frame").drop("frame")


def read_json_packets(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Packets of JSON lines, as a table or a stream; lines that do not parse are left out."""
    rows = (spark.readStream if stream else spark.read).text(path)
    return rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("p")).where("p is not null").select("p.*").dropna(how="all")
