"""Recording files and zipped matrices, written here and read back in many partitions."""

from __future__ import annotations

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.sources import recordings

RNG = np.random.default_rng(6)
LABELS, UNITS = ["Fp1.", "Fp2.", "F3..", "EDF Annotations"], ["uV", "mV", "V", ""]


def edf(path, records, notes=(), rate=32, cut=0, labels=LABELS, records_told=None):
    """Write a file of one-second records; returns the channels in microvolts."""
    digital = RNG.integers(-2000, 2000, (records, 3, rate)).astype("<i2")
    field = lambda v, n: str(v).ljust(n).encode("latin-1")[:n]
    n = len(labels)
    head = b"".join(field(v, w) for v, w in zip(("0", "x", "y", "01.01.26", "00.00.00", 256 * (n + 1), "EDF+C", records if records_told is None else records_told, 1, n), (8, 80, 80, 8, 8, 8, 44, 8, 8, 4)))
    columns = [(labels, 16), ([""] * n, 80), (UNITS, 8), ([-100, -0.1, -1e-4, -1], 8), ([100, 0.1, 1e-4, 1], 8), ([-2048] * n, 8), ([2047] * n, 8), ([""] * n, 80), ([rate] * 3 + [30], 8), ([""] * n, 32)]
    head += b"".join(field(v, w) for values, w in columns for v in values)
    body = b""
    for k in range(records):
        said = f"+{k}\x14\x14\x00" + "".join(f"+{at}\x15{d}\x14{text}\x14\x00" for at, d, text in notes if int(at) == k)
        body += digital[k].tobytes() + said.encode().ljust(60, b"\x00")
    data = head + body
    path.write_bytes(data[: len(data) - cut])
    return (digital.transpose(1, 0, 2).reshape(3, -1).astype(float) + 2048) * 200 / 4095 - 100


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    recordings.register(spark)
    where = tmp_path_factory.mktemp("edf")
    (where / "sub").mkdir()
    made = {"a.edf": edf(where / "a.edf", 25, [(4.5, 4.1, "T1"), (9.0, 2, "T0"), (12.25, 3, "T2")]), "sub/b.EDF": edf(where / "sub" / "b.EDF", 7)}
    cut = edf(where / "cut.edf", 10, cut=100)
    made["cut.edf"] = cut[:, : 9 * 32]  # the last record is not whole
    (where / "junk.edf").write_bytes(b"not a recording")
    (where / "empty.edf").write_bytes(b"")
    edf(where / "other.edf", 3, labels=["O1", "O2", "Oz", "EDF Annotations"])
    return where, made


def load(spark, where, **options):
    return spark.read.format("edf").options(**options).load(str(where))


@pytest.mark.parametrize("per_task", [1, 4, 600])
def test_recordings_come_back_in_microvolts_whatever_the_partitions(spark, folder, per_task):
    where, made = folder
    df = load(spark, where, channels="Fp1,f3", recordsPerPartition=str(per_task))
    assert df.columns == ["path", "sample", "t", "Fp1", "f3"]
    assert df.rdd.getNumPartitions() == sum(-(-x.shape[1] // 32 // per_task) for x in made.values())
    rows = df.toPandas().sort_values(["path", "sample"])
    assert len(rows) == sum(x.shape[1] for x in made.values())  # bad files, and one without these channels, are left out
    for name, x in made.items():
        own = rows[rows.path.str.endswith(name)]
        assert own["sample"].tolist() == list(range(x.shape[1])) and np.allclose(own.t, np.arange(x.shape[1]) / 32)
        assert np.allclose(own.Fp1, x[0]) and np.allclose(own.f3, x[2])


def test_first_seconds_and_a_single_file(spark, folder):
    where, made = folder
    df = load(spark, where / "a.edf", channels="Fp2", seconds="3.5", recordsPerPartition="2")
    rows = df.toPandas().sort_values("sample")
    assert len(rows) == 112 and df.rdd.getNumPartitions() == 2 and np.allclose(rows.Fp2, made["a.edf"][1, :112])
    assert load(spark, f"file://{where}/a.edf", channels="Fp2").count() == 25 * 32


def test_annotations_cut_trials(spark, folder):
    where, _ = folder
    notes = load(spark, where, annotations="true", recordsPerPartition="3").where("description in ('T1', 'T2')")
    assert {(r.onset, r.duration, r.description) for r in notes.collect()} == {(4.5, 4.1, "T1"), (12.25, 3.0, "T2")}
    trials = load(spark, where, channels="Fp1").join(notes, "path").where("t >= onset and t < onset + duration").groupBy("description").count()
    assert {r.description: r["count"] for r in trials.collect()} == {"T1": int(np.ceil(8.6 * 32)) - int(4.5 * 32), "T2": 96}


def test_bad_files_are_logged(spark, folder, caplog):
    where, _ = folder
    reader = recordings.EdfReader({"path": str(where)}, ["Fp1"], False)
    with caplog.at_level("WARNING"):
        reader.partitions()
    assert all(any(name in m and "skipped" in m for m in caplog.messages) for name in ("junk.edf", "empty.edf", "other.edf")) and len(caplog.messages) == 3


def test_zipped_matrices(spark, tmp_path):
    recordings.register(spark)
    made = {f"sub{k:02d}_{kind}.txt": RNG.normal(size=(20 + k, 14)) for k in range(3) for kind in ("lo", "hi")}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, m in made.items():
            z.writestr(name, "\n".join(" ".join(map(repr, map(float, r))) for r in m) + "\n\n")
        z.writestr("sub09_lo.txt", "1 2\nnot numbers\n3,4\n")
        z.writestr("readme.md", "1 2 3")
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    df = spark.read.format("zipmatrix").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 7
    got = {}
    for r in df.orderBy("member", "row").collect():
        got.setdefault(r.member, []).append(r["values"])
    assert set(got) == {*made, "sub09_lo.txt"} and got["sub09_lo.txt"] == [[1.0, 2.0], [3.0, 4.0]]
    assert all(np.allclose(got[k], m) for k, m in made.items())
    assert {(r.low, r.high) for r in recordings.paired_members(df).collect()} == {(f"sub{k:02d}_lo.txt", f"sub{k:02d}_hi.txt") for k in range(3)}
    assert spark.read.format("zipmatrix").option("suffix", ".md").load(str(tmp_path)).agg(F.count("*")).first()[0] == 1
