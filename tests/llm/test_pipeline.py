"""The pipeline's stages on a small table with nulls, empties and repeats, and from end to end."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from wavequarry.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select(P.COLUMNS)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (None, "no id at all", None, "src0", 1), (9003, " \n lead and\ttail \n", "en", None, 1)] + [(9004, "twice the same row " * 9, "en", "src1", 1)] * 2, real.schema)
    return real.union(odd).cache()


def test_stages(spark, sf_dir, docs):
    assert [f for _, f in P.STAGES] == [P.drop_toxic, P.drop_copies, P.drop_near_copies, P.mix_sources, P.pack_sequences] and P.ORACLE_SQL is None
    calm = P.drop_toxic(spark, docs, sf_dir).cache()
    assert calm.columns == P.COLUMNS and 0.7 * docs.count() < calm.count() <= docs.count()
    single = P.drop_copies(spark, calm, sf_dir).cache()
    texts = {}
    for r in calm.collect():
        key = r.text or ""
        texts[key] = max(filter(lambda x: x is not None, (texts.get(key), r.doc_id)), default=None)
    assert Counter((r.doc_id, r.text or "") for r in single.collect()) == Counter((i, t) for t, i in texts.items())
    apart = P.drop_near_copies(spark, single, sf_dir).cache()
    assert apart.columns == P.COLUMNS
    # Of each component of the pairs that are at least 0.8 alike, by all pairs, the smallest id.
    rows = [(r.doc_id, shingles(r.text)) for r in single.collect()]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, a) in enumerate(rows):
        for m, (_, b) in enumerate(rows[:k]):
            if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(k)] = find(m)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(doc_id)
    want = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert Counter(r.doc_id for r in apart.collect()) == want


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_every_stage_takes_empty_tables_and_clashing_columns(spark, sf_dir, docs, stage):
    names = ["size", "taken", "target", "digest", "row", "component_id", "text_hash", "_key", "chunk", "nth", "k_id", "start", "length", "piece", "score", "label"]
    some = docs.where("doc_id is null or doc_id % 8 = 0 or doc_id > 9000")
    wide = some.select(*some.columns, *[F.lit(k).alias(c) for k, c in enumerate(names)])
    got, want = stage(spark, wide, sf_dir), stage(spark, some, sf_dir)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert stage(spark, wide.limit(0), sf_dir).count() == 0


def test_mixed_texts_are_the_taken_words(spark, sf_dir, docs):
    mixed = P.mix_sources(spark, docs, sf_dir).cache()
    assert mixed.columns == P.COLUMNS
    words = {}
    for r in docs.collect():
        words.setdefault(r.doc_id, []).append(Counter(WORD.findall(r.text or "")))
    whole = {r.text for r in docs.collect()}
    n = 0
    for r in mixed.collect():
        own = Counter(WORD.findall(r.text))
        n += own.total()
        assert own and any(own <= w for w in words[r.doc_id]) and r.n_chars == len(r.text)
        assert r.text in whole or any(own < w for w in words[r.doc_id])
    sizes = sum(w.total() for group in words.values() for w in group)
    assert abs(n - 1.5 * sizes) < 64 * 25
    assert P.mix_sources(spark, docs.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    left = [r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(shared_dir(spark)).select("path").collect() if "/stage-" in r.path]
    assert left and all("stage-sequence-packing" in p for p in left)  # the rows of earlier stages are gone
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
