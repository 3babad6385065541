"""Near copies: the stage against exact five-word similarities, which SimHash's three bits do not reach."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline as P

from wavequarry.llm import nearcopies, simhash


def test_near_copies_of_four_fifths_go(spark, sf_dir):
    rng = random.Random(3)
    rows, alike = [], 0
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(words)
        for at in range(10, 10 + 7 * (k % 4), 7):  # up to three words changed, 5 shingles each or fewer
            copy[at] = "changed"
        other = [w if n % 9 else "other" for n, w in enumerate(words)]  # far below 0.8
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(copy)), (3 * k + 2, " ".join(other))]
    rows += [(900, None), (901, ""), (None, "no id here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.drop_near_copies(spark, docs, sf_dir).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[n : n + 5]) for n in range(len(w) - 4)}

    for k in range(60):
        a, b, c = (shingles(rows[3 * k + n][1]) for n in range(3))
        assert 5 * len(a & b) >= 4 * len(a | b) and 5 * len(a & c) < 4 * len(a | c)
        alike += rows[3 * k][1] != rows[3 * k + 1][1] and (simhash.fingerprint_batch([rows[3 * k][1]]) ^ simhash.fingerprint_batch([rows[3 * k + 1][1]]))[0].item().bit_count() > 3
        assert {3 * k, 3 * k + 2} <= kept and 3 * k + 1 not in kept
    assert alike > 0 and None in kept and 900 in kept and 901 not in kept


def test_groups_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: set(nearcopies.shingle_set(r.text).tolist()) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if 5 * small >= 4 * large:
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (small + large - common):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in sets}
    assert len(set(got.values())) < simhash.near_duplicates(docs).select("component_id").distinct().count()


def test_chunks_of_a_cell_lose_no_link(spark):
    rows = [(k, " ".join(f"w{n}" if n != 5 * k else "x" for n in range(300))) for k in range(60)]
    texts = spark.createDataFrame(rows, "text_hash long, text string")
    assert simhash.components(nearcopies.links(texts, 7)).where("root = 0").count() == 60
