"""Where results go: files by state, JSON and text lines, streams, subscribers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import linalg as L


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_by_state(df: DataFrame, path: str, state: str) -> None:
    """One folder per state, so that a state's block is read alone."""
    df.repartition(state).write.mode("overwrite").partitionBy(state).parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """value: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def report_lines(df: DataFrame, pattern: str) -> DataFrame:
    """value: each row formatted by a printf pattern over its columns in order."""
    return df.select(F.format_string(pattern, *df.columns).alias("value"))


def stream_csv(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to CSV files, each row once; start again with the same checkpoint to go on."""
    return stream.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def publish(stream: DataFrame, send: Callable[[list[str]], None], checkpoint: str, at_once: int = 1000) -> StreamingQuery:
    """Hand the JSON lines of each batch to ``send``, at most ``at_once`` to a call; a partition at a time comes to the driver."""

    def batch(rows: DataFrame, _: int) -> None:
        held: list[str] = []
        for r in json_lines(rows).toLocalIterator():
            held.append(r.value)
            if len(held) == at_once:
                send(held)
                held = []
        if held:
            send(held)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Conflict(RuntimeError):
    """Another writer has put a version in place since this one was read."""


class Versions:
    """Numbered versions of what lies in a folder: small JSON files, each created once, of which the last counts.

    A writer writes its data under a name of its own first and the version
    last, so one that dies leaves the version before as it was, and of two
    writers that started from the same version the second fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def last(self) -> int:
        """Number of the last version, -1 if there is none."""
        system, pattern = self._at(f"{self.path}/_versions/*.json")
        return max((int(f.getPath().getName()[:-5]) for f in system.globStatus(pattern) or []), default=-1)

    def read(self, version: int) -> dict:
        system, place = self._at(f"{self.path}/_versions/{version:08d}.json")
        stream = system.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, version: int, content: dict) -> None:
        """Put ``version`` in place; Conflict if it is there."""
        system, place = self._at(f"{self.path}/_versions/{version:08d}.json")
        try:
            stream = system.create(place, False)
        except Py4JJavaError as problem:
            if "FileAlreadyExists" in str(problem.java_exception) or system.exists(place):
                raise Conflict(f"{self.path} has a version {version} by another writer") from problem
            raise
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()


def write_baselines(df: DataFrame, path: str, state: str) -> None:
    """Store rows (state, matrix, n and others), one per state; what was there counts until they are written.

    ``state_distances`` gives what lies between them.
    """
    if dict(df.dtypes).get("matrix") != "array<double>":
        raise ValueError("a baseline is an array of doubles, row by row, named matrix")
    versions = Versions(df.sparkSession, path)
    before, folder = versions.last(), f"{path}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    versions.write(before + 1, {"folder": folder.rsplit("/", 1)[-1]})


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """The last baselines that were written whole."""
    versions = Versions(spark, path)
    return spark.read.parquet(f"{path}/{versions.read(versions.last())['folder']}")


def state_distances(baselines: DataFrame, state: str) -> DataFrame:
    """``baselines`` with distances: a map from each other state to the geodesic distance of their matrices.

    There are as few states as a calibration has blocks; each baseline is met by
    all of them, gathered in one row.
    """
    others = baselines.agg(F.collect_list(F.struct(F.col(state).cast("string").alias("state"), "matrix")).alias("_all"))

    @F.pandas_udf("array<double>")
    def distances(own: pd.Series, every: pd.Series) -> pd.Series:
        square = lambda v: np.asarray(v, float).reshape(int(len(v) ** 0.5), -1)
        return pd.Series([[float(L.distance(square(m), square(o))) for o in others] for m, others in zip(own, every)])

    met = baselines.crossJoin(F.broadcast(others))  # one row
    found = met.withColumn("_d", distances("matrix", F.col("_all.matrix")))
    pairs = F.filter(F.arrays_zip(F.col("_all.state").alias("state"), F.col("_d").alias("d")), lambda p: ~p["state"].eqNullSafe(F.col(state).cast("string")) & p["state"].isNotNull())
    return found.withColumn("distances", F.map_from_entries(pairs)).drop("_all", "_d")


class Ledger:
    """Rows with a key that are inserted and updated, dealt to buckets by their key; readers see the last version.

    An upsert reads and writes the buckets that its rows fall into and no
    others. A version says which folder each bucket has; folders are never
    changed, so that readers of earlier versions go on.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._versions = Versions(spark, path)
        self.version = self._versions.last()
        self._state = self._versions.read(self.version) if self.version >= 0 else {"buckets": buckets, "folders": {}, "schema": None}

    def _bucket(self):
        return F.pmod(F.xxhash64(F.struct(*self.key)), F.lit(self._state["buckets"])).cast("int")

    def folders(self) -> dict[int, str]:
        """Bucket -> where its rows lie."""
        return {int(b): f"{self.path}/{f}" for b, f in self._state["folders"].items()}

    def _rows(self, buckets: list[int]) -> DataFrame | None:
        places = [p for b, p in self.folders().items() if b in set(buckets)]
        return self.spark.read.schema(StructType.fromJson(self._state["schema"])).parquet(*places) if places else None

    def read(self) -> DataFrame:
        found = self._rows(list(self.folders()))
        return found if found is not None else self.spark.createDataFrame([], StructType.fromJson(self._state["schema"]))

    def upsert(self, rows: DataFrame) -> None:
        """Put ``rows`` in the place of those with their keys, of which nulls are equal.

        Rows must have one row a key. If another writer was first, Conflict is
        raised and nothing is changed: open the ledger again and repeat.
        """
        name = f"v{self.version + 1:08d}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket())
        touched = [r[0] for r in dealt.select("_bucket").distinct().collect()]  # at most the number of buckets
        old = self._rows(touched)
        merged = dealt
        if old is not None:
            keys = rows.select([F.col(c).alias(f"_new_{c}") for c in self.key])
            same = [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in self.key]
            kept = old.join(keys, same, "left_anti").withColumn("_bucket", self._bucket())
            merged = kept.unionByName(dealt, allowMissingColumns=True)
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        schema = StructType([f for f in merged.schema if f.name != "_bucket"])
        state = {"buckets": self._state["buckets"], "folders": self._state["folders"] | {str(b): f"{name}/_bucket={b}" for b in touched}, "schema": schema.jsonValue()}
        self._versions.write(self.version + 1, state)
        self.version, self._state = self.version + 1, state
