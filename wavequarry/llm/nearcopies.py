"""Near copies: SimHash with pivot tables, reached further by MinHash cells, decided by the exact Jaccard similarity of word shingles.

Texts are fingerprinted over their five-word shingles and linked by the pivot
tables of ``simhash``; a link counts if the shingle sets are as similar as
``SIMILARITY``. Fingerprints alone cannot reach a similarity of 0.8: such texts
differ by about ten of 64 bits, and as many differ by chance in a large corpus.
For those, texts also meet in cells named by MinHash bands, and in a cell the
shingle sets themselves are compared. Two texts as similar as ``SIMILARITY``
miss all cells with a probability of (1 - SIMILARITY ** ROWS) ** BANDS, three
in a million; texts less similar are never linked.

Cells with the same members are compared once. A cell returns a spanning forest
of its links, so a group of near copies yields a row per text, and members that
are connected already are not compared again. Cells of more than ``CELL_ROWS``
texts are cut into chunks, and each pair of chunks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_keys
from .simhash import components, fingerprint_of, shingle_hashes
from .simhash import links as print_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
CELL_ROWS = 1024
#: Rows of cells that one task compares.
TASK_ROWS = 2_000


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; none without words."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), dtype=np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of ROWS minima over the shingles."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        mixed = shingles[at : at + (1 << 12), None] * (a | np.uint64(1)) + b
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _cells_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text_hash, text -> of texts that have words, text_hash and either a cell or the fingerprint."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts, hashes = part.column(0).to_numpy(), [shingle_hashes(t, SHINGLE) for t in part.column(1).to_pylist()]
            owners = texts[[len(h) > 0 for h in hashes]]
            hashes = [h for h in hashes if h]
            keys = [band_keys(np.unique(np.array(h, dtype=np.uint64))) for h in hashes]
            cells = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            prints = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            cell = pa.concat_arrays([pa.array(cells), pa.nulls(len(prints), pa.int64())])
            fp = pa.concat_arrays([pa.nulls(len(cells), pa.int64()), pa.array(prints)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.repeat(owners, BANDS), owners])), cell, fp], ["text_hash", "cell", "fp"])


def _sets_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingle_set(t).astype("<u8").tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["text_hash", "shingles"])


def cell_links(texts: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of positions that connect the same texts as all pairs of at least ``similarity``; equal ``texts`` are one text."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    _, coded = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(coded.max() + 1, bool)
    label = np.unique(texts, return_inverse=True)[1]
    found = []
    for i in range(len(sets) - 1):
        own = coded[starts[i] : starts[i + 1]]
        later = sizes[i + 1 :]
        least, most = np.minimum(later, sizes[i]), np.maximum(later, sizes[i])
        open_ = np.flatnonzero((label[i + 1 :] != label[i]) & (least >= similarity * most - 1e-9)) + i + 1
        if not len(open_):
            continue
        mark[own] = True
        if len(open_) < 16:
            common = np.array([np.count_nonzero(mark[coded[starts[j] : starts[j + 1]]]) for j in open_])
        else:
            common = np.add.reduceat(mark[coded[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)[open_ - i - 1]
        mark[own] = False
        for j in open_[common >= similarity * (sizes[open_] + sizes[i] - common) - 1e-9]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((i, int(j)))
    return found


def _links_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, lo, hi, text_hash, shingles) sorted by the first three -> links."""
    key, texts, sets = None, [], []

    def links() -> pa.RecordBatch:
        pairs = cell_links(np.array(texts), sets) if len(texts) > 1 else []
        a, b = (pa.array([texts[p[k]] for p in pairs], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(4)]
        for k, row in enumerate(zip(*cols)):
            if row[:3] != key:
                if len(texts) > 1:
                    yield links()
                key, texts, sets = row[:3], [], []
            texts.append(row[3])
            sets.append(np.frombuffer(batch.column(4)[k].as_py(), "<u8"))
    if len(texts) > 1:
        yield links()


def _similar_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, the shingles of each) -> those of at least SIMILARITY."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_py(), "<u8") for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common >= SIMILARITY * (len(x) + len(y) - common) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def print_pairs(prints: DataFrame) -> DataFrame:
    """a, b: texts (text_hash, fp) whose fingerprints the pivot tables link; of those with one fingerprint each is paired with the first.

    At most a pair for each text and for each link of the spanning forests.
    """
    first = cut(prints.groupBy("fp").agg(F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    same = join_keys(prints, first.where("n > 1"), "fp", "n", prints.count()).where("text_hash != first").select(F.col("text_hash").alias("a"), F.col("first").alias("b"))
    found = print_links(first.select("fp"))
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"text_{c}"))
    near = found.join(end("a"), "a").join(end("b"), "b").select(F.col("text_a").alias("a"), F.col("text_b").alias("b"))
    return same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingles (text_hash, shingles) are at least as similar as SIMILARITY."""
    total = pairs.count()
    for side in ("a", "b"):
        asked = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_n"))
        known = asked.join(sets.select(F.col("text_hash").alias(side), F.col("shingles").alias(f"shingles_{side}")), side)
        pairs = join_keys(pairs, cut(known, "asked"), side, "_n", total, 100).drop("_n")
    return pairs.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_similar_arrow, "a long, b long")


def links(texts: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a, b: links whose components are those of all pairs of SIMILARITY that share a cell or that fingerprints link; ``texts`` has text_hash and text."""
    told = cut(texts.mapInArrow(_cells_arrow, "text_hash long, cell long, fp long").distinct(), "cells")
    pairs = cut(print_pairs(told.where("fp is not null").select("text_hash", "fp")), "pairs")
    cells = told.where("cell is not null").select("text_hash", "cell")
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("text_hash").cast("decimal(20,0)")).alias("members")).where("n > 1")
    shared = cut(shared.groupBy("n", "members").agg(F.min("cell").alias("cell")).select("cell", "n"), "shared")
    cells = cut(cells.join(shared, "cell"), "members")
    of_pairs = pairs.select(F.explode(F.array("a", "b")).alias("text_hash"))
    met = texts.join(cut(cells.select("text_hash").union(of_pairs).distinct(), "met"), "text_hash", "left_semi")
    sets = cut(met.mapInArrow(_sets_arrow, "text_hash long, shingles binary").dropDuplicates(["text_hash"]), "sets")
    chunks = F.ceil(F.col("n") / cell_rows).cast("int")
    cells = cells.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("text_hash"), F.col("chunks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["cell", "lo", "hi"]
    cells = cells.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "text_hash")
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // TASK_ROWS))
    rows = cells.join(sets, "text_hash").select(*key, "text_hash", "shingles").repartition(tasks, *key).sortWithinPartitions(*key)
    return rows.mapInArrow(_links_arrow, "a long, b long").union(_similar(pairs, sets)).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id, text_hash (xxhash64).

    A component is connected by pairs of texts whose shingle sets have a Jaccard
    similarity of at least SIMILARITY; component_id is its smallest id, null if
    all are null. Texts of fewer words than a shingle are one shingle. Null and
    empty texts are one component. An empty table gives no rows.
    """
    words = F.when(F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.xxhash64(words).alias("node"))
    of = components(links(docs.select(F.xxhash64(text_col).alias("text_hash"), words.alias("text")).where("text is not null")))
    found = cut(rows.join(of, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")), "rooted")
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return join_keys(found, cut(least, "least"), "root", "n", found.count()).select("doc_id", "component_id", "text_hash")
