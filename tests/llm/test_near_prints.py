"""Near copies go through fingerprints and pivot tables too, and fingerprints alone link nothing."""

from __future__ import annotations

import random

from wavequarry.llm import nearcopies, simhash


def test_links_come_through_fingerprints_and_pivot_tables(spark, monkeypatch):
    """with MinHash cells that no two texts share, copies within three bits are still found, and unlike texts within three bits are not linked."""
    rng = random.Random(6)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(20)]
    rows = [(k, " ".join(w)) for k, w in enumerate(words)] + [(100 + k, " ".join(w[:-1] + ["end"])) for k, w in enumerate(words)]
    texts = spark.createDataFrame(rows, "text_hash long, text string")
    prints = {i: simhash.fingerprint_of(simhash.shingle_hashes(t, nearcopies.SHINGLE)) for i, t in rows}
    near = {(k, 100 + k) for k in range(20) if (prints[k] ^ prints[100 + k]).bit_count() <= simhash.LINK_BITS}
    assert near
    of_prints = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in prints.items()], "text_hash long, fp long")
    pairs = nearcopies.print_pairs(of_prints)
    assert {tuple(r) for r in pairs.collect()} == near
    sets = spark.createDataFrame([(i, bytearray(nearcopies.shingle_set(t).astype("<u8").tobytes())) for i, t in rows], "text_hash long, shingles binary")
    unlike = spark.createDataFrame([(0, 1)], "a long, b long")
    assert {tuple(r) for r in nearcopies._similar(pairs.union(unlike), sets).collect()} == near
    assert near <= {tuple(sorted(r)) for r in nearcopies.links(texts).collect()}


def test_texts_with_one_fingerprint_are_paired_with_the_first(spark):
    prints = spark.createDataFrame([(5, 9), (3, 9), (7, 9), (8, 1 << 40)], "text_hash long, fp long")
    assert {tuple(r) for r in nearcopies.print_pairs(prints).collect()} >= {(3, 5), (3, 7)}
