"""The hash trees against a plain recursion over sorted rows."""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from wavequarry.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx string, root int, digest string"
ROWS = [
    *[(k, f"text {k}\nend" if k % 3 else "", "en", "big", k) for k in range(200)],
    *[(k, "line\n" * (k % 4) + "ß", None if k % 2 else "de", "abc"[k % 3], None) for k in range(300, 340)],
    (400, None, None, None, None), (None, "no\nid", "en", None, 5), (401, "a\n" * 50_000, "en", "", 1), (402, "twice\n", "en", "lone é", 1), (402, "twice\n", "en", "lone é", 1), (None, None, None, None, None),
]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Root and each node's siblings on the way, a level at a time."""
    paths, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(of):
            run = range(at - at % 3, min(at - at % 3 + 3, len(nodes)))
            paths[i] += [(nodes[j], j < at) for j in run if j != at]
        of, nodes = [at // 3 for at in of], [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n, *_ in rows:
        groups[source].append((doc_id, leaf(doc_id, source, lang, n, text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    below = {s: climb([d for _, d in groups[s]]) for s in order}
    root, above = climb([below[s][0] for s in order])
    return [(i, d, below[s][0], root, H(*[x for x, _ in below[s][1][k] + above[at]])) for at, s in enumerate(order) for k, (i, d) in enumerate(groups[s])]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def proofs(spark, rows, levels):
    docs = table(spark, rows).repartition(5)
    digest = merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    return merkle.manifest(docs.select("doc_id", "source", digest.alias("digest")), levels=levels)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_blocks_of_any_height_give_the_plain_trees(spark, levels):
    found = merkle.folded(proofs(spark, ROWS, levels), "digest", "up").collect()
    got = Counter((r.doc_id, r.digest.hex(), r.subroot.hex(), r.root.hex(), H(r.path.hex())) for r in found)
    assert got == Counter(plain(ROWS))
    assert all(r.up == r.root for r in found)


def test_a_single_row_is_its_own_root_and_no_rows_give_none(spark):
    (r,) = proofs(spark, ROWS[5:6], 7).collect()
    assert r.digest == r.subroot == r.root and r.path == b"" and proofs(spark, [], 7).count() == 0


def test_a_proof_fails_for_another_leaf(spark):
    rows = merkle.folded(proofs(spark, ROWS, 2).withColumn("other", F.unhex(F.sha2(F.lit("x"), 256))), "other", "up").collect()
    assert not any(r.up == r.root for r in rows)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []], ids=["all", "one", "none"])
def test_query_equals_its_sql(spark, tmp_path, rows):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op13_merkle(spark, str(tmp_path))
    want = con.sql(queries.OP13_SQL)
    assert Counter(map(tuple, got.collect())) == Counter(want.project(", ".join(got.columns)).fetchall())
