"""Every registered query with an SQL twin gives the same rows as DuckDB; ``test_plain_models`` holds the others against plain NumPy."""

from __future__ import annotations

import duckdb
import pytest

from wavequarry import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: The size at which queries are compared elsewhere too: means that lie on halves show up here, not in smaller tables.
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object)
    plain = lambda v: v + 0.0 if isinstance(v, float) else v  # noqa: E731  -0.0 is 0.0
    return sorted(str(tuple(map(plain, r))) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(name, spark, duck):
    ours, theirs = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_entry_works_without_the_text_operators(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert "ledger_trend" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
