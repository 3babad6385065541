"""Readers of recording files (European Data Format) and of zipped matrices, as Spark data sources.

A partition is a range of a file's data records, or a member of an archive, so
one long recording is read by many tasks, each of which seeks to its own place.
Files are opened by ``pyarrow.fs``: paths are URIs of stores it knows, or folders
that driver and executors share. Register with ``register(spark)``.
"""

from __future__ import annotations

import io
import logging
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

log = logging.getLogger(__name__)
#: Fixed values of the format: fields of the header and of each signal, with their widths.
FILE_FIELDS = [("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("header_bytes", 8), ("kind", 44), ("records", 8), ("duration", 8), ("signals", 4)]
SIGNAL_FIELDS = [("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("filter", 80), ("samples", 8), ("reserved", 32)]
ANNOTATIONS = "EDF ANNOTATIONS"
#: Microvolts in a unit.
MICROVOLTS = {"v": 1e6, "mv": 1e3, "uv": 1.0, "µv": 1.0}


@dataclass
class Header:
    """What a file says of itself."""

    bytes: int
    records: int
    duration: float
    labels: list[str]
    scale: np.ndarray
    offset: np.ndarray
    samples: np.ndarray

    @property
    def record_bytes(self) -> int:
        return 2 * int(self.samples.sum())

    def begin(self, k: int) -> int:
        """Where signal k starts in a record, in samples."""
        return int(self.samples[:k].sum())


def channel_name(label: str) -> str:
    """Label without dots and spaces, in upper case."""
    return label.replace(".", "").strip().upper()


def read_header(file) -> Header:
    """Header of an open file; ValueError if it is none."""

    def cut(fields: list[tuple[str, int]], times: int) -> dict[str, list[str]]:
        found = {}
        for name, width in fields:
            data = file.read(width * times)
            if len(data) < width * times:
                raise ValueError("the header ends early")
            found[name] = [data[width * k : width * (k + 1)].decode("latin-1").strip() for k in range(times)]
        return found

    top = {k: v[0] for k, v in cut(FILE_FIELDS, 1).items()}
    n = int(top["signals"])
    if top["version"] != "0" or n < 1:
        raise ValueError("not a recording file")
    own = cut(SIGNAL_FIELDS, n)
    number = lambda name: np.array([float(v) for v in own[name]])
    span = number("digital_max") - number("digital_min")
    if (span <= 0).any():
        raise ValueError("a signal has no digital range")
    unit = np.array([MICROVOLTS.get(u.lower(), 1.0) for u in own["unit"]])
    scale = (number("physical_max") - number("physical_min")) / span
    offset = (number("physical_min") - number("digital_min") * scale) * unit
    samples = np.array([int(v) for v in own["samples"]])
    return Header(int(top["header_bytes"]), int(top["records"]), float(top["duration"]), own["label"], scale * unit, offset, samples)


def _listed(path: str, suffix: str) -> list[tuple[str, str, int]]:
    """(URI's file system and path as given to ``_opened``, size) of the files below a path, by name."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
    base = path[: len(path) - len(place)] if path.endswith(place) else ""
    return [(base + f.path, f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(suffix)]


def _opened(path: str):
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


@dataclass
class Records(InputPartition):
    """Data records of a file."""

    path: str
    first: int
    count: int


class EdfReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str], annotations: bool):
        self.path, self.columns, self.annotations = options["path"], columns, annotations
        self.per_task = int(options.get("recordsPerPartition", 600))
        self.seconds = float(options["seconds"]) if "seconds" in options else None

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for uri, _, size in _listed(self.path, ".edf"):
            try:
                with _opened(uri) as file:
                    header = read_header(file)
                there = {channel_name(c) for c in header.labels}
                wanted = {ANNOTATIONS} if self.annotations else {c.upper() for c in self.columns}
                if missing := wanted - there:
                    if self.annotations:
                        continue
                    raise ValueError(f"no channel {', '.join(sorted(missing))}")
                whole = (size - header.bytes) // header.record_bytes  # a file cut off has fewer records than it says
                records = whole if header.records < 0 else min(whole, header.records)
                if self.seconds is not None and header.duration > 0:
                    records = min(records, int(np.ceil(self.seconds / header.duration)))
            except (ValueError, OSError, UnicodeError) as problem:
                log.warning("%s is skipped: %s", uri, problem)
                continue
            found += [Records(uri, at, min(self.per_task, records - at)) for at in range(0, records, self.per_task)]
        return found

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as file:
            header = read_header(file)
            file.seek(header.bytes + partition.first * header.record_bytes)
            data = file.read(partition.count * header.record_bytes)
        records = np.frombuffer(data, "<i2").reshape(-1, header.record_bytes // 2)
        names = [channel_name(c) for c in header.labels]
        if self.annotations:
            k = names.index(ANNOTATIONS)
            raw = records[:, header.begin(k) : header.begin(k) + header.samples[k]]
            rows = [r for record in raw for r in _annotations(np.ascontiguousarray(record).tobytes())]
            columns = [[partition.path] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.string()))], ["path", "onset", "duration", "description"])
            return
        at = [names.index(c.upper()) for c in self.columns]
        n = int(header.samples[at[0]]) if at else int(header.samples[0])
        rate = n / header.duration if header.duration else 1.0
        place = partition.first * n + np.arange(len(records) * n)
        keep = np.ones(len(place), bool) if self.seconds is None else place < self.seconds * rate
        columns = [pa.array([partition.path] * int(keep.sum())), pa.array(place[keep], pa.int64()), pa.array(place[keep] / rate)]
        for k in at:
            if header.samples[k] != n:
                raise ValueError(f"{partition.path}: channels of different rates")
            columns.append(pa.array((records[:, header.begin(k) : header.begin(k) + n].ravel() * header.scale[k] + header.offset[k])[keep]))
        yield pa.RecordBatch.from_arrays(columns, ["path", "sample", "t", *self.columns])


def _annotations(data: bytes) -> Iterator[tuple[float, float | None, str]]:
    """(onset, duration, text) of the annotations in a record; the record's own time stamp has no text."""
    for entry in data.split(b"\x00"):
        if entry[:1] in (b"+", b"-") and b"\x14" in entry:
            when, *texts = entry.split(b"\x14")
            onset, _, duration = when.partition(b"\x15")
            for text in texts:
                if text:
                    yield float(onset), float(duration) if duration else None, text.decode("utf-8", "replace")


class EdfSource(DataSource):
    """Format ``edf``: path, sample (from 0), t (seconds), and the channels of option ``channels`` in microvolts.

    Only the bytes of the asked records are read; ``seconds`` keeps a
    recording's start, ``recordsPerPartition`` sets how much a task reads. Files
    that are no recordings, or lack a channel, are logged and skipped; of a file
    cut off, whole records count. With option ``annotations`` the rows are path,
    onset, duration and description instead.
    """

    @classmethod
    def name(cls) -> str:
        return "edf"

    def _channels(self) -> list[str]:
        return [c.strip() for c in self.options.get("channels", "").split(",") if c.strip()]

    def _told(self) -> bool:
        return self.options.get("annotations", "false").lower() == "true"

    def schema(self) -> str:
        if self._told():
            return "path string, onset double, duration double, description string"
        return ", ".join(["path string, sample long, t double", *[f"`{c}` double" for c in self._channels()]])

    def reader(self, schema) -> DataSourceReader:
        return EdfReader(self.options, self._channels(), self._told())


@dataclass
class Member(InputPartition):
    path: str
    name: str


class ZipMatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".txt")

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for uri, _, _ in _listed(self.path, ".zip"):
            try:
                with _opened(uri) as file, zipfile.ZipFile(file) as archive:
                    found += [Member(uri, n) for n in sorted(archive.namelist()) if n.endswith(self.suffix)]
            except (zipfile.BadZipFile, OSError, ValueError) as problem:
                log.warning("%s is skipped: %s", uri, problem)
        return found

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as file, zipfile.ZipFile(file) as archive, archive.open(partition.name) as member:
            at, rows = 0, []
            for line in io.TextIOWrapper(member, "utf-8", errors="replace"):
                try:
                    values = [float(v) for v in line.replace(",", " ").split()]
                except ValueError:
                    log.warning("%s, %s: line %d is no row of numbers", partition.path, partition.name, at)
                    continue
                if values:
                    rows.append((at, values))
                    at += 1
                if len(rows) == 8192:
                    yield self._batch(partition, rows)
                    rows = []
            if rows:
                yield self._batch(partition, rows)

    @staticmethod
    def _batch(partition: Member, rows: list) -> pa.RecordBatch:
        n = len(rows)
        arrays = [pa.array([partition.path] * n), pa.array([partition.name] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(arrays, ["archive", "member", "row", "values"])


class ZipMatrixSource(DataSource):
    """Format ``zipmatrix``: archive, member, row (from 0), values of text matrices in zip files, a member to a task.

    Option ``suffix`` chooses members. Lines that are no numbers are logged and
    left out, and so are archives that cannot be opened.
    """

    @classmethod
    def name(cls) -> str:
        return "zipmatrix"

    def schema(self) -> str:
        return "archive string, member string, row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return ZipMatrixReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats ``edf`` and ``zipmatrix`` known to the session."""
    for source in (EdfSource, ZipMatrixSource):
        spark.dataSource.register(source)


def paired_members(rows):
    """member pairs ``low`` and ``high`` of a ``zipmatrix`` table: names that differ in their ending _lo or _hi only."""
    from pyspark.sql import functions as F

    names = rows.select("archive", "member").distinct()
    stem = F.regexp_replace("member", r"_(lo|hi)(\.[^.]*)$", "$2")
    of = lambda kind: names.where(F.col("member").rlike(rf"_{kind}\.[^.]*$")).select("archive", stem.alias("stem"), F.col("member").alias({"lo": "low", "hi": "high"}[kind]))
    return of("lo").join(of("hi"), ["archive", "stem"])
