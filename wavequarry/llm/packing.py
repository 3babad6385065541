"""Packing token sequences: large items by greedy matching, small ones by best fit.

Pieces of one length are interchangeable, so the packing is planned on the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus) and
says how many sequences of each composition there are. Pieces find their place
by their rank among the pieces of their length, which is counted in salted
groups, so that neither a length nor the corpus passes through one task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut

SALTS = 256
#: Texts of these characters alone are split alike by both libraries' regular expressions; others go to ``tokenizers``.
ELSEWHERE = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]")


@cache
def _libraries(name: str) -> tuple[Tokenizer, tiktoken.Encoding | None, re.Pattern | None]:
    """The tokenizer ``name`` and, where its vocabulary also comes as ranks, the faster library on the same vocabulary."""
    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    try:
        lines = open(public_tokenizers.path(f"{name}.tiktoken"), "rb").read().splitlines()
    except (OSError, KeyError, ValueError):
        return slow, None, None
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    for content in special:
        ranks.pop(content.encode(), None)
    return slow, tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), ELSEWHERE


def token_ids(text: str | None, tokenizer: str) -> np.ndarray:
    """uint32 ids of the text, as ``tokenizers`` gives them with add_special_tokens=False; null counts as empty."""
    slow, fast, elsewhere = _libraries(tokenizer)
    if not text:
        return np.zeros(0, np.uint32)
    if fast is not None and not elsewhere.search(text):
        return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _piece_task(tokenizer: str, end_id: int, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(token_ids(text.as_py(), tokenizer).astype("<u4"), np.uint32(end_id)).astype("<u4")
                start, stop = 0, len(ids) % capacity or min(len(ids), capacity)
                piece = 0
                while start < len(ids):
                    out.append((doc_id, piece, start, stop - start, crc32(ids[start:stop].tobytes())))
                    start, stop, piece = stop, stop + capacity, piece + 1
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as ids and ``end_id``, cut where longer than ``capacity``.

    Only the first piece of a cut document may be shorter than ``capacity``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_piece_task(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), from the number of pieces of each length.

    Pieces above a third of the capacity are at most two to a sequence: the
    longest that is left takes the longest partner that fits. The others, from
    the longest down, go where least space is left; a sequence that has room
    for several of a length takes them at once, as best fit would.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    third = capacity // 3
    for s in range(capacity, third, -1):
        while left[s]:
            fits = np.flatnonzero(left[third + 1 : min(capacity - s, s) + 1])
            t = third + 1 + int(fits[-1]) if len(fits) else 0
            if t == s:
                made, rest = (s, s), int(left[s] // 2)
                if not rest:
                    left[s] -= 1  # the last one finds a smaller partner, or none
                    below = np.flatnonzero(left[third + 1 : s])
                    t = third + 1 + int(below[-1]) if len(below) else 0
                    made, rest = ((s, t), 1) if t else ((s,), 1)
                    if t:
                        left[t] -= 1
                else:
                    left[s] -= 2 * rest
            elif t:
                made, rest = (s, t), int(min(left[s], left[t]))
                left[s] -= rest
                left[t] -= rest
            else:
                made, rest = (s,), int(left[s])
                left[s] = 0
            open_.setdefault(capacity - sum(made), []).append((made, rest))
    for s in range(third, 0, -1):
        n = int(left[s])
        while n:
            gap = min((g for g in open_ if g >= s), default=None)
            if gap is None:
                made, there = (), n  # new sequences, as many as needed
                gap = capacity
            else:
                made, there = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            fill = gap // s
            whole = min(there, n // fill)
            if whole:
                open_.setdefault(gap - fill * s, []).append((made + (s,) * fill, whole))
                n -= whole * fill
            if there > whole and n and n < fill:
                open_.setdefault(gap - n * s, []).append((made + (s,) * n, 1))
                n, whole = 0, whole + 1
            if made and there > whole:
                open_.setdefault(gap, []).append((made, there - whole))
    return [group for groups in open_.values() for group in groups]


def plan_places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length << 40 | first rank, first sequence, offset), sorted: where the pieces of each length go by rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for made, n in plan:
        offset = 0
        for length in made:
            rows.append((length << 40 | used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def _place_task(places: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = batch.column("length").to_numpy() << 40 | batch.column("rank").to_numpy()
                at = np.searchsorted(places[:, 0], key, "right") - 1
                sequence = places[at, 1] + key - places[at, 0]
                kept = [c for c in batch.schema.names if c != "rank"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(places[at, 2])], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows, and rows that
    share an id, are packed one by one. Very long texts are cut into pieces of
    ``capacity``. An empty table gives no rows.
    """
    made = cut(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    groups = cut(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places = plan_places(plan_packing(counts, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within)).join(groups, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_place_task(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
