"""What the text operators share: the word rule, the shared folder, cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    What follows starts from files that survive the loss of an executor, and
    is computed once however often it is used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def join_keys(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and in ``count`` how many of the ``total`` rows have it.

    Keys with more than a ``share``-th of the rows, of which there are fewer
    than ``share``, are broadcast, so their rows stay where they are; the rest
    meets by a merge join in which no key is large.
    """
    hot = F.col(count) * share > total
    few = table.where(hot)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table.where(~hot).hint("merge"), key)
    return rows.join(F.broadcast(few), key).unionByName(others)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those whose ``key`` has the smallest hashes; all of a table that is no larger.

    A share of the hashes is cut off first, so that partitions do not send
    ``limit`` rows each to be merged.
    """
    n = df.count()
    if n > limit:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * 0.95 * limit / n))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(limit)
