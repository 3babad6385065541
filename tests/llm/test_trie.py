"""The conversation trie against plain nested loops and its SQL twin."""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from wavequarry.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, size string"
SAME = [("user", "hello"), ("assistant", "hi there"), ("user", "é" * 9), ("assistant", "bye")]
ROWS = [
    *[(c, k, *t) for c in range(100, 170) for k, t in enumerate(SAME[: 1 + c % 4])],  # groups of copies, and some that are prefixes of others
    *[(c, k, "user", f"{c} {k}") for c in range(200, 206) for k in range(7)],
    *[(300, k, "user", "step " * (k % 5)) for k in range(700)], *[(301, k, "user", "step " * (k % 5)) for k in range(650)],  # two long ones that part late
    *[(c, 0, "user", "no base") for c in range(901, 930)],
    (1000, None, None, None), (1000, None, "x", "tie"), (1000, 3, "", ""), (1000, 3, "", ""), (1001, 1, "user", "a"), (None, 1, "user", "nobody"), (-7, 1, "user", "below"), (-100, 1, "user", "base"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA).repartition(5)


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], role, text))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    trunc = lambda c: c - (c % 100 if c >= 0 else -(-c % 100))
    return {c: turns.get(trunc(c), [])[: (h := crc32(str(c).encode()) % 6)] + turns[c][h:] for c in turns}


def plain(rows):
    convs, nodes = rebuilt(rows), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    end = lambda k: ",".join(map(str, sorted(c for c in nodes[k] if len(convs[c]) == len(k))))
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha256(end(k).encode()).hexdigest()) for k, m in nodes.items())


def found(spark, rows):
    return Counter(map(tuple, trie.prefix_trie(*trie.shared_heads(trie.numbered_turns(table(spark, rows)))).collect()))


def test_same_as_plain_loops(spark):
    assert found(spark, ROWS) == plain(ROWS)


def test_a_hot_node_hashes_its_members_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    assert found(spark, ROWS[:300]) == plain(ROWS[:300])


def test_no_rows_and_rows_without_conversation(spark):
    assert found(spark, []) == found(spark, [(None, 1, "user", "nobody")]) == Counter()


def test_one_turn(spark):
    rows = [(6, 0, "user", "x")]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[r for r in ROWS if r[0] not in (300, 301)], []], ids=["all", "none"])
def test_query_equals_its_sql(spark, tmp_path, rows):
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = queries.op12_trie(spark, str(tmp_path)), con.sql(queries.OP12_SQL)
    assert Counter(map(tuple, got.collect())) == Counter(want.project(", ".join(got.columns)).fetchall())
