"""Repeated word sequences against windows counted one by one, and the SQL twin."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from wavequarry.llm import queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, chunk int, cell string"
rng = np.random.default_rng(3)
unique = iter(range(10**9))


def fresh(n):
    return " ".join(f"w{next(unique)}" for _ in range(n))


PASSAGE, EXACT, SHORT = fresh(60), fresh(35), fresh(34)
ROWS = [
    *[(k, f"{fresh(int(rng.integers(0, 60)))} {PASSAGE}\n\n{fresh(int(rng.integers(0, 60)))}") for k in range(40)],  # one passage at every offset
    (100, f"{fresh(7)} {EXACT} {fresh(3)}"), (101, EXACT), (102, f"{SHORT} {fresh(20)}"), (103, f"{fresh(5)} {SHORT}"), (104, "same " * 200), (105, "same " * 35), (106, "same " * 34),
    (107, fresh(36)), (108, None), (None, ""), (109, " \t  é　ü \x0b\x0c\r\n x"), (110, fresh(80)), (110, fresh(80)),
    *[(200 + k, "copy " + " ".join(f"c{j}" for j in range(90))) for k in range(30)], (230, None), (None, None),
    (300, " ".join(rng.choice(["a", "b"], 9000))), (301, "x" * 70_000 + " " + fresh(50)), (302, f"{PASSAGE} {PASSAGE}"),
]
ROWS += [(401, ROWS[-1][1]), (401, ROWS[-1][1])]


def table(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, "y") for r in rows], SCHEMA).repartition(4)


def plain(rows, width=35):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def found(spark, rows, **sizes):
    got = substrings.repeats(table(spark, rows), **sizes).collect()
    for r in got:
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_removed and all(a["to"] < b["from"] for a, b in zip(r.spans, r.spans[1:]))
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got)


@pytest.mark.parametrize(("chunk_bytes", "least_words"), [(1 << 22, 1 << 21), (700, 500), (1, 100)])
def test_same_as_counting_windows(spark, chunk_bytes, least_words):
    assert found(spark, ROWS, chunk_bytes=chunk_bytes, least_words=least_words) == plain(ROWS)


def test_other_widths(spark):
    rows = [(k, " ".join(rng.choice(["a", "b", "c"], 40))) for k in range(30)]
    for width in (1, 2, 5, 6):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.repeats(table(spark, rows), width, chunk_bytes=200, least_words=50).collect())
        assert got == plain(rows, width)


def test_long_words_are_hashed_in_slices(monkeypatch):
    texts = [b"ab " * 500, b"x" * 3000, b"", b"ab ab", b"y" * 7]
    whole = substrings.Words(texts)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 64)
    parts = substrings.Words(texts)
    assert (whole.hashes == parts.hashes).all() and whole.count.tolist() == [500, 1, 0, 2, 1] and len(set(whole.hashes.tolist())) == 3


def test_no_rows_and_no_words(spark):
    assert found(spark, []) == Counter()
    assert found(spark, [(1, None), (1, " "), (None, "")]) == plain([(1, None), (1, " "), (None, "")])


def test_query_equals_its_sql(spark, tmp_path):
    table(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = queries.op11_substrings(spark, str(tmp_path)), con.sql(queries.OP11_SQL)
    rows = Counter(map(tuple, got.collect()))
    assert rows == Counter(want.project(", ".join(got.columns)).fetchall()) == Counter((i, n, m, sha256(k.encode()).hexdigest()) for (i, n, m, k), c in plain(ROWS).items() for _ in range(c))
