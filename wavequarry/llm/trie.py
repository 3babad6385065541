"""Prefix trie over conversations by peeling leaves.

A node is a distinct sequence of first turns, named by its depth and 128 bits
of the sum of its turns' hashes (each of turn and place), so that the names of
all prefixes are running sums and a conversation of any length is read in
ranges. No text leaves the task that read it.

A node belongs to its smallest member, and the nodes of one conversation are an
unbroken path down to its last turn. Peeling works on these paths: each holds a
counter of the paths that hang on it; a path whose counter is zero sends the
totals of its subtree to its parent, which counts down, until only the path of
the root is left. So a long conversation takes one round, and there are as many
rounds as there are forks on the way to a leaf. Sums along the paths then give
each node its own share.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_keys
from .scans import running_sums

#: Ids that are hashed as one row.
CHUNK = 4096
LIMBS = 4
NODE = ["depth", "a", "b"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), what (16 bytes of role and text), chars (code points of the text), of rows (conv_id, turn, role, text).

    Turns go by ``turn``, null first, ties by ``what``. Null roles and texts are
    empty. Rows without conv_id are in no conversation. Other columns are left
    behind.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    what = F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, 16)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", what.alias("what"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("_row"))
    placed = running_sums(cut(rows, "turns"), "conv_id", ["turn", "what", "_row"], {"pos": F.lit(1).cast("long")})
    return cut(placed.select("conv_id", "pos", "what", "chars"), "placed")


def shared_heads(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size) and their turns (conv_id, pos, what, chars, size), each begun anew with a shared head.

    The first h turns of a conversation c make way for as many (or all) of
    conversation c - c % ``block``, none if there is none; h is the unsigned
    crc32 of c's decimal text modulo ``most``.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    own = cut(own.select("conv_id", "n_own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base")), "own")
    bases = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    convs = own.join(bases, "base", "left").withColumn("head", head)  # a base has 2 * block - 1 conversations at most
    convs = cut(convs.withColumn("size", F.col("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "convs")
    firsts = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    heads = convs.select("conv_id", "base", "head", "size").join(firsts, "base").where("pos <= head")
    rest = join_keys(turns, convs, "conv_id", "n_own", turns.count()).where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    columns = ["conv_id", "pos", "what", "chars", "size"]
    return convs.select("conv_id", "size"), heads.select(columns).union(rest.select(columns))


def _halves(limbs: list[Column]) -> list[Column]:
    """Two longs of four sums modulo 2^32."""
    low = [x % (1 << 32) for x in limbs]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])]


def members(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation and depth from 0: conv_id, size, chars, the node (depth, a, b) and its parent (pa, pb)."""
    start = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("what"), F.lit(0).cast("long").alias("chars"), "size")
    rows = start.union(turns.select("conv_id", F.col("pos").alias("depth"), "what", "chars", "size"))
    told = F.sha2(F.concat(F.concat(F.col("depth").cast("string"), F.lit(":")).cast("binary"), F.col("what")), 256)
    terms = [F.coalesce(F.conv(F.substring(told, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(0).cast("long")).alias(f"t{k}") for k in range(LIMBS)]
    rows = cut(rows.select("conv_id", "depth", "chars", "size", *terms), "members")
    rows = running_sums(rows, "conv_id", ["depth"], {f"s{k}": F.col(f"t{k}") for k in range(LIMBS)})
    a, b = _halves([F.col(f"s{k}") for k in range(LIMBS)])
    pa_, pb_ = _halves([F.col(f"s{k}") - F.col(f"t{k}") for k in range(LIMBS)])
    return cut(rows.select("conv_id", "size", "chars", F.col("depth"), a.alias("a"), b.alias("b"), pa_.alias("pa"), pb_.alias("pb")), "paths")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, a, b, conv_id) in order -> one row per node and at most CHUNK ids, as text."""
    for batch in batches:
        out = []
        for node, rows in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[:3]):
            ids = [r[3] for r in rows]
            out += [(*node, ids[at], ",".join(map(str, ids[at : at + CHUNK]))) for at in range(0, len(ids), CHUNK)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of node and first id -> the hash of each node's ids, the state carried from batch to batch."""
    now, state = None, None
    row = lambda node, state: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(*n, s.hexdigest()) for n, s in zip(node, state)])], [*NODE, "ends_sha256"])
    for batch in batches:
        nodes, states = [], []
        for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node == now:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                nodes.append(now)
                states.append(state)
            now, state = node, sha256(ids.encode())
        if nodes:
            yield row(nodes, states)
    if state is not None:
        yield row([now], [state])


def end_hashes(rows: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: hash of the ids, ascending, of the conversations whose last turn the node is.

    A hash is a fold over its whole input, so ids are made text in tasks of
    their own, and one task reads a row for each CHUNK of a node's ids.
    """
    ends = cut(rows.where("depth = size").select(*NODE, "conv_id"), "ends")
    chunks = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_chunks, "depth long, a long, b long, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashes, "depth long, a long, b long, ends_sha256 string")


def _peeled(paths: DataFrame) -> DataFrame:
    """Rows (conv_id, parent, at, left, leaves, saved), ``left`` counting the paths that hang on it, with the totals of whole subtrees."""
    open_, done = paths, []
    while True:
        ready = open_.where("left = 0")
        done.append(ready)
        waiting = open_.where("left > 0")
        sent = ready.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("_n"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        after = waiting.join(sent, "conv_id", "left").select("conv_id", "parent", "at", (F.col("left") - zero("_n")).alias("left"), (F.col("leaves") + zero("_leaves")).alias("leaves"), (F.col("saved") + zero("_saved")).alias("saved"))
        open_ = cut(after, "open")
        if open_.isEmpty():
            break
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    return found


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` has conv_id and size, the number of its turns; ``turns`` conv_id,
    pos from 1, what, chars and size. The root has depth 0 and all conversations, those
    without turns too. saved_tokens adds up (n_convs - 1) * chars over the
    subtree. No conversations give no rows, not even a root. Equal
    conversations share all nodes; very long ones and empty texts are nothing
    special.
    """
    rows = members(convs, turns)
    first = F.min(F.struct("conv_id", "size"))
    nodes = rows.groupBy(*NODE).agg(first.alias("first"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max(F.struct("pa", "pb")).alias("p"))
    own = ((F.col("n_convs") - 1) * F.col("chars")).alias("own")
    nodes = cut(nodes.select(*NODE, "first.conv_id", F.col("first.size").alias("last"), "n_convs", own, F.struct(F.col("depth") - 1, "p.pa", "p.pb").alias("above")), "nodes")

    tops = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "above")).alias("top"), F.sum("own").alias("own"), F.max("last").alias("last"))
    tops = cut(tops.select("conv_id", "last", "own", (F.col("top.depth") - 1).alias("at"), F.col("top.above").alias("node")), "tops")
    hung = tops.where("at >= 0").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    owners = cut(hung.join(nodes.select(F.struct(*NODE).alias("node"), F.col("conv_id").alias("parent")), "node"), "owners")
    below = join_keys(tops.where("at >= 0"), owners, "node", "n", tops.count()).select("conv_id", "last", "own", "at", "parent")
    paths = cut(tops.where("at < 0").select("conv_id", "last", "own", "at", F.lit(None).cast("long").alias("parent")).unionByName(below), "attached")

    counts = paths.where("at >= 0").groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("left"), F.max("at").alias("deepest"))
    counters = paths.join(counts, "conv_id", "left").select(
        "conv_id", "parent", "at", F.coalesce("left", F.lit(0)).cast("long").alias("left"), F.coalesce((F.col("deepest") < F.col("last")).cast("long"), F.lit(1).cast("long")).alias("leaves"), F.col("own").alias("saved")
    )
    totals = cut(_peeled(cut(counters, "counters")), "totals")

    side = totals.where("at >= 0").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parents = totals.where("at >= 0").select("conv_id", (F.col("at") + 1).alias("depth"), "parent")
    known = nodes.drop("above").join(side, ["conv_id", "depth"], "left").join(parents, ["conv_id", "depth"], "left").join(end_hashes(rows), NODE, "left")
    children = F.coalesce("n", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long")
    known = known.select(
        "conv_id", "depth", (-F.col("depth")).alias("_up"), F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", children.alias("n_children"),
        F.coalesce("leaves", F.lit(0)).alias("_leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("_saved"), F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )
    summed = running_sums(cut(known, "known"), "conv_id", ["_up"], {"n_leaves": F.col("_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("_saved")})
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
