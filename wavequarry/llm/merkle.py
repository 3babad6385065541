"""Hash trees over a dataset by superblock reduction.

Rows are leaves, numbered within their source; sources are leaves of the tree
above. ``FANOUT ** LEVELS`` consecutive nodes are a superblock, whose task
collapses LEVELS levels at once and gives for each of its nodes the siblings on
the way. The roots of the superblocks are nodes of the next round, so a source
of any size takes a few rounds, and no task holds more than a superblock. On
the way back each node's proof is what its superblock gave, then the proof of
the superblock's root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import numbered
from .common import cut, join_keys
from .scans import running_sums

FANOUT = 3
#: Levels that one task collapses: blocks of 2187 nodes.
LEVELS = 7
DIGEST = 32


def leaf_digest(*values: Column) -> Column:
    """SHA-256, as 32 bytes, of the values: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    texts = [v.cast("string") for v in values]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def parent(run: list[bytes]) -> bytes:
    """Digest of the concatenated digests as hex text."""
    return sha256(b"".join(run).hex().encode()).digest()


def collapse(digests: list[bytes], total: int, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[bytes, list[bytes]]:
    """Root of a superblock and, for each node, the siblings on the way to it, joined.

    ``total`` is the number of nodes of the whole level: while it is over one,
    a lone node becomes its own parent's only child.
    """
    tiers = []
    while total > 1 and len(tiers) < levels:
        tiers.append(digests)
        digests = [parent(digests[at : at + fanout]) for at in range(0, len(digests), fanout)]
        total = -(-total // fanout)
    paths = [b""]
    for tier in reversed(tiers):
        runs = [tier[at : at + fanout] for at in range(0, len(tier), fanout)]
        paths = [b"".join(run[:k] + run[k + 1 :]) + path for run, path in zip(runs, paths) for k in range(len(run))]
    return digests[0], paths


def fold(digest: bytes, path: bytes, places: list[tuple[int, int]], fanout: int = FANOUT) -> bytes:
    """The root that ``digest`` and its proof lead to; ``places`` are its number and the number of nodes in each tree, lowest first."""
    at = 0
    for place, total in places:
        while total > 1:
            k = place % fanout
            others = min(fanout, total - (place - k)) - 1
            run = [path[at + DIGEST * i : at + DIGEST * (i + 1)] for i in range(others)]
            digest = parent([*run[:k], digest, *run[k:]])
            at += DIGEST * others
            place, total = place // fanout, -(-total // fanout)
    return digest


def _collapse_block(fanout: int, levels: int, names: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        root, paths = collapse(rows["digest"].tolist(), int(rows["n"].iloc[0]), fanout, levels)
        return rows.assign(root=[root] * len(rows), path=paths)[names]

    return run


def _climb(nodes: DataFrame, largest: int, fanout: int, levels: int, seal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``nodes`` (tree, idx, n, digest and others), each with root and path as ``seal`` leaves them; ``largest`` is the largest n."""
    size = fanout**levels
    kinds = {**dict(nodes.dtypes), "block": "bigint", "root": "binary", "path": "binary"}
    blocks = nodes.withColumn("block", F.floor(F.col("idx") / size)).groupBy("tree", "block")
    lower = cut(blocks.applyInPandas(_collapse_block(fanout, levels, list(kinds)), ", ".join(f"`{c}` {k}" for c, k in kinds.items())), "blocks")
    if largest <= size:
        return seal(lower)
    tops = lower.where(F.col("idx") % size == 0).select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("digest"))
    upper = _climb(tops, -(-largest // size), fanout, levels, seal)
    above = [c for c in upper.columns if c not in ("tree", "idx", "n", "digest", "block", "path")]
    upper = upper.select("tree", F.col("idx").alias("block"), F.col("path").alias("rest"), *above)
    return lower.drop("root").join(upper, ["tree", "block"]).withColumn("path", F.concat("path", "rest")).drop("rest")


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Rows of ``leaves`` (source, doc_id, digest and others) with place in the trees, subroot, root and proof.

    Leaves go by source (null first, then bytewise), doc_id (null first) and
    digest. Added are idx and n (number in its source, rows of the source),
    source_idx and n_sources, subroot, root, and path: the digests of the
    siblings from the leaf up to the root, joined. Rows alike in all columns
    are leaves one by one. Empty and very long texts are leaves like others; no
    rows give no rows. ``leaves`` may not have columns of these names, nor tree,
    block, rest and those that start with an underscore.
    """
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))  # never null, in the order of sources
    rows = cut(leaves.select("*", tree.alias("tree"), F.monotonically_increasing_id().alias("_row")), "leaves")
    sizes = cut(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    placed = running_sums(rows, "tree", ["doc_id", "digest", "_row"], {"idx": F.lit(1).cast("long")}).withColumn("idx", F.col("idx") - 1).drop("_row")
    nodes = join_keys(placed, sizes, "tree", "n", total)

    def seal(lower: DataFrame) -> DataFrame:
        """Put the tree of sources on top of the sources' roots."""
        subroots = cut(lower.where("idx = 0").select("tree", F.col("root").alias("digest")), "subroots")
        sources = numbered(subroots, ["tree"]).select(F.lit("").alias("tree"), F.col("i").alias("idx"), "n", "digest", F.col("tree").alias("of"))
        top = _climb(sources, subroots.count(), fanout, levels, lambda x: x)
        top = top.select(F.col("of").alias("tree"), F.col("idx").alias("source_idx"), F.col("n").alias("n_sources"), F.col("path").alias("rest"), F.col("root").alias("top"))
        sealed = lower.join(top, "tree").withColumn("path", F.concat("path", "rest"))
        return sealed.withColumnsRenamed({"root": "subroot", "top": "root"}).drop("rest")

    return _climb(nodes, largest, fanout, levels, seal).select(*leaves.columns, "idx", "n", "source_idx", "n_sources", "subroot", "root", "path")


def folded(rows: DataFrame, digest: str, name: str, fanout: int = FANOUT) -> DataFrame:
    """Add ``name``: the root that the column ``digest`` and the row's own proof and place lead to."""
    schema = T.StructType([*rows.schema, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c: batch.column(c).to_pylist()
            ups = [fold(d, p, [(i, n), (j, m)], fanout) for d, p, i, n, j, m in zip(of(digest), of("path"), of("idx"), of("n"), of("source_idx"), of("n_sources"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ups, pa.binary())], [*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def proof_digest(path: Column) -> Column:
    """Lowercase hex SHA-256 of a proof's digests as hex text."""
    return F.sha2(F.lower(F.hex(path)).cast("binary"), 256)
