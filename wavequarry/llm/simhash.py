"""Near-duplicate groups by SimHash and pivot distance tables.

Fingerprints at most ``LINK_BITS`` bits apart are linked; a group is a
connected component. The work is done on distinct fingerprints, so exact
copies cost nothing beyond their own row.

Hamming distances to reference fingerprints (pivots) can discard pairs but do
not say where to send a fingerprint, since those of random pairs lie within a
few bits of each other. So the 64 bits are cut into six parts: two fingerprints
three bits apart agree on three parts at least, and each fingerprint is sent to
the 20 cells named by three parts. No link is lost. In a cell, the distances to
the pivots are computed once per fingerprint; pairs are listed in the order of
the first one, dropped where any distance differs by more than ``LINK_BITS``,
and the survivors are verified. A cell returns a spanning forest of its links,
not the links, so a large group of near copies yields a row per fingerprint.
Cells of more than ``CELL_ROWS`` fingerprints are cut into chunks, and each
pair of chunks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_keys

SHINGLE = 3
LINK_BITS = 3
CELL_ROWS = 4096
#: Rows of cells that one task searches.
TASK_ROWS = 500_000
N_PIVOTS = 16
#: Six parts of the 64 bits, and the 20 masks of three parts.
PARTS = [((1 << 11) - 1) << 11 * i for i in range(4)] + [((1 << 10) - 1) << 44 + 10 * i for i in range(2)]
MASKS = [a | b | c for a, b, c in combinations(PARTS, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = N_PIVOTS, seed: int = 1) -> np.ndarray:
    """Reference fingerprints: random ones."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each run of ``shingle`` words, A-Z lower-cased, joined by single spaces, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: ASCII rules only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, 42)]
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])]


def fingerprint_of(h: list[int]) -> int:
    """A bit is 1 if set in over half of the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = np.array(h[at : at + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint_batch(texts: list[str | None]) -> np.ndarray:
    """uint64 fingerprints: a bit is 1 if set in over half of the text's hashes; 0 without words."""
    return np.array([fingerprint_of(shingle_hashes(text)) for text in texts], np.uint64)


def _fingerprint_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            prints = fingerprint_batch(part.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints), part.column(2)], ["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), text_hash of each row; null and empty texts get 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(_fingerprint_arrow, "doc_id long, fp long, text_hash long")


def cell_links(prints: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same fingerprints as all links among ``prints`` (distinct, uint64) do."""
    n = len(prints)
    table = np.bitwise_count(prints[:, None] ^ pivot[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    label = np.arange(n)
    step = max(1, (1 << 20) // n)
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        stop = np.searchsorted(table[:, 0], table[rows[-1], 0] + LINK_BITS, "right")
        i, j = (x.ravel() for x in np.meshgrid(rows, np.arange(at, stop), indexing="ij"))
        near = i < j
        i, j = i[near], j[near]
        for p in range(table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= LINK_BITS
            i, j = i[near], j[near]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= LINK_BITS
        i, j = i[near], j[near]
        while len(i):  # join the groups of linked rows
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(label, high, low)
            while not np.array_equal(label, label[label]):
                label = label[label]
    joined = np.flatnonzero(label != np.arange(n))
    return prints[label[joined]], prints[joined]


def _link_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell columns, fp) sorted by cell -> links."""
    pivot = pivots()
    rest: list[np.ndarray] = []  # columns of the cell that may go on in the next batch

    def links(cols: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends):
            if hi - lo > 1:
                x, y = cell_links(cols[-1][lo:hi].view(np.uint64), pivot)
                a.append(x)
                b.append(y)
        join = lambda parts: np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(join(a)), pa.array(join(b))], ["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate(x) for x in zip(rest, cols)] if rest else cols
        if not len(cols[0]):
            continue
        change = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:-1]:
            change |= c[1:] != c[:-1]
        ends = np.flatnonzero(change) + 1
        last = ends[-1] if len(ends) else 0
        if last:
            yield links(cols, ends)
        rest = [c[last:] for c in cols]
    if rest:
        yield links(rest, np.array([len(rest[0])]))


def links(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a, b: links whose components are those of all links among the distinct longs ``fp``."""
    masks = F.array(*[F.struct(F.lit(k).cast("int").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(MASKS)])
    cells = prints.select("fp", F.inline(masks)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("part", "bits"))).where("n > 1")
    chunks = F.ceil(F.col("n") / cell_rows).cast("int")
    cells = cells.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["part", "bits", "lo", "hi"]
    cells = cells.select("part", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    # The search is heavy for the few bytes it reads, so the number of tasks is set by rows; left to itself Spark makes one.
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() * len(MASKS) // TASK_ROWS))
    return cells.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(_link_arrow, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of an edge (a, b).

    Rounds of large-star and small-star, until nothing changes: every node's
    larger neighbours, then its smaller ones, are linked to the smallest of
    all. The rows of a round are written in the shared folder; the driver sees
    their count and hash sum. A node with a large part of the edges, as the
    centre of a large group is, keeps them where they are (``join_keys``).
    """

    def star(pairs: DataFrame, total: int) -> DataFrame:
        """pairs (u, v) with m, the smallest of u and all its v."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
        return join_keys(pairs, low, "u", "_n", total).drop("_n")

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before, total = None, edges.count()
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = cut(star(both, 2 * total).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = star(down, total)
        edges = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
        edges = cut(edges, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before, total = state, state[0]
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, text_hash (xxhash64).

    component_id is the smallest id of the component. Null and empty texts
    have fingerprint 0 and are linked like any other; so are repeated rows.
    A component whose ids are all null has a null component_id. Whole texts
    count, however long; other columns of ``docs`` are not read. An empty table
    gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct")
    of = components(links(distinct.select("fp")))
    rooted = distinct.join(of, distinct["fp"] == of["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id", "n")
    rooted = cut(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    ids = cut(join_keys(rooted, least, "root", "prints", rooted.count()).select("fp", "component_id", "n"), "components")
    return join_keys(prints, ids, "fp", "n", prints.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash")
