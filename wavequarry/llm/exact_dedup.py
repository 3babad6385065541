"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest. A batch
is reduced to one row per digest (partial aggregation before the shuffle, so a
text that makes up a third of all rows costs one row per task), compared with
the index by a sort-merge anti-join that leaves the index where and in the order
it lies, and the digests that are new are appended.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_keys, remove


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as 32 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """Table ``name`` over the files in ``path``: digest, keep_id, batch.

    Each append adds one sorted file per bucket; ``compact`` makes one of them
    again, so that the anti-join need not sort the index. A session that finds
    files from an earlier one registers them again with the same bucketing, so
    nothing is rewritten. Files lie in one folder per compaction, of which the
    last complete one counts.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64):
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a table name: {name!r}")
        self.spark, self.path, self.name, self.buckets = spark, path.rstrip("/"), name, buckets
        # A scan of bucketed files tells their order, where each bucket has one file, only if asked to.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self._register(max(self._complete(), default=0))

    def _register(self, generation: int) -> None:
        self.generation = generation
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._folder(generation)}'"
        )

    def _folder(self, generation: int) -> str:
        return f"{self.path}/{generation:06d}"

    def _files(self, pattern: str) -> list[str]:
        """Paths below ``path``, on whatever file system it lies."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        return [str(f.getPath()) for f in found or []]

    def _complete(self) -> list[int]:
        return [int(f.split("/")[-2]) for f in self._files("*/_SUCCESS")]

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, name: str, generation: int) -> None:
        (
            rows.select("digest", "keep_id", "batch")
            .repartition(self.buckets, "digest")  # one file per bucket
            .write.mode("append").format("parquet").option("path", self._folder(generation))
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)
        )

    def append(self, rows: DataFrame) -> None:
        self._write(rows, self.name, self.generation)
        self.spark.catalog.refreshTable(self.name)

    def files_per_bucket(self) -> float:
        return len(self._files(f"{self.generation:06d}/*.parquet")) / self.buckets

    def compact(self, most_files: float = 1.0) -> None:
        """Bring each bucket down to one sorted file if there are over ``most_files`` of them on average."""
        if self.files_per_bucket() <= most_files:
            return
        old, fresh = self.generation, f"{self.name}_{self.generation + 1}"
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        remove(self.spark, self._folder(old + 1))  # what a compaction that died may have left
        rows = self.spark.read.schema(self.read().schema).parquet(self._folder(old))  # the table would claim to be dealt already
        self._write(rows, fresh, old + 1)
        self.spark.sql(f"DROP TABLE {fresh}")
        self.spark.sql(f"DROP TABLE {self.name}")
        self._register(old + 1)
        remove(self.spark, self._folder(old))

    def forget(self, files: bool = False) -> None:
        """Take the table out of the catalogue; with ``files``, delete what it holds."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if files:
            remove(self.spark, self.path)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text", most_files: float = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts in the batch the row with the largest id stays, unless the
    index holds the text from another batch: then none stays and keep_id is
    the id kept there. group_size counts the batch's rows with that text.

    Null texts equal the empty text. Null ids lose to any other id. Of rows
    that repeat both id and text, one stays. Whole texts are hashed, however
    long; other columns of ``docs`` are not read. An empty batch gives no rows
    and leaves the index as it is. Running a batch again under its name gives
    the same answer: a job that died after the append can be repeated. The
    index is compacted first if it has over ``most_files`` files a bucket.
    """
    keyed = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    first = F.max(F.struct("doc_id", "row")).alias("first")  # nulls are least
    groups = cut(keyed.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size")).select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("first_row"), "group_size"), "groups")
    index.compact(most_files)
    fresh = groups.join(index.read().hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", "keep_id", F.lit(batch).alias("batch")))

    known = index.read().select("digest", F.col("keep_id").alias("index_id"), "batch")
    settled = groups.drop("keep_id").join(known.hint("merge"), "digest")
    settled = cut(settled.select("digest", "index_id", "group_size", F.when(F.col("batch") == batch, F.col("first_row")).alias("kept_row")), "settled")
    total = keyed.count()
    return join_keys(keyed, settled, "digest", "group_size", total).select(
        "doc_id",
        F.col("index_id").alias("keep_id"),
        "group_size",
        (F.col("row").eqNullSafe(F.col("kept_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
