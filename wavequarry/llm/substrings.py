"""Repeated word sequences by fixed-block anchors.

A window of ``width`` words holds a whole block of ``(width + 1) // 2`` words
that starts at a multiple of that length. So of two equal windows each holds a
block of the index, and the other has the same words at the same place: the
index is all non-overlapping blocks, the probes are all rolling windows of a
block's length, and where a probe hits, the windows around it are compared
until they differ. No equal windows are missed, and only windows around hits are compared.

Texts are written once in chunks of some megabytes. A chunk asks each cell of
hashes once, by the sorted distinct hashes that it has there, and is answered
by one bit for each, whatever the number of copies; which words they are
follows from the chunk. So no pairs are made, a passage that a third of all
texts share is one hash per chunk, and a text is never sent to its copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WIDTH = 35
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21
#: Words that a cell of hashes is made for: cells grow from the least to the most before there are over CELLS of them.
LEAST_WORDS, MOST_WORDS, CELLS = 1 << 21, 1 << 26, 4096
#: Bytes whose words are hashed at once.
SLICE_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the hashes of bytes in a word and of words in a window.
BYTE, WORD_A, WORD_B = 0x9E6C63D0876A9A99, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over one another."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of ``base`` and of its inverse, modulo 2^64."""
    return tuple(np.multiply.accumulate(np.concatenate([[_U(1)], np.full((1 << bits) - 1, b, _U)])) for b in (base, pow(base, -1, 1 << 64)))


def _rolling(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each start and end: the sum of value times base^(place - start), modulo 2^64."""
    up, down = _powers(base, max(16, int(len(values)).bit_length()))
    sums = np.concatenate([[_U(0)], np.cumsum(values * up[: len(values)], dtype=_U)])
    return (sums[ends] - sums[starts]) * down[starts]


class Words:
    """The words of some texts, hashed: ``first`` and ``count`` per text, ``hashes`` per word."""

    def __init__(self, texts: list[bytes]):
        body = np.frombuffer(b"\n".join(texts), np.uint8)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        space = np.concatenate([[True], SPACE[body], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(starts, offsets)
        self.count = np.diff(np.append(self.first, len(starts)))
        self.text = np.repeat(np.arange(len(texts)), self.count)
        parts, at = [np.zeros(0, _U)], 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
            low = starts[at]
            parts.append(_rolling(body[low : ends[stop - 1]].astype(_U) + _U(1), BYTE, starts[at:stop] - low, ends[at:stop] - low))
            at = stop
        self.hashes = _mixed(np.concatenate(parts) ^ (ends - starts).astype(_U))

    def windows(self, width: int) -> np.ndarray:
        """Where a text has ``width`` words in a row."""
        n = len(self.hashes) - width + 1
        return np.flatnonzero(self.text[: max(n, 0)] == self.text[width - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def hashed(self, at: np.ndarray, width: int, base: int) -> np.ndarray:
        return _mixed(_rolling(self.hashes, base, at, at + width))


class Asked:
    """What a chunk asks the cells: for each cell the distinct hashes of windows, sorted.

    ``key`` is 64 bits and ``more`` some others; cells are ranges of ``key``.
    Of short windows only 32 bits of the key within the cell are told, since
    what they find is compared again.
    """

    def __init__(self, words: Words, at: np.ndarray, width: int, cells: int, block: int | None):
        key = words.hashed(at, width, WORD_A)
        more = np.zeros(len(at), np.uint16) if block else (words.hashed(at, width, WORD_B) >> _U(48)).astype(np.uint16)
        cell = ((key >> _U(32)) * _U(cells)) >> _U(32)
        if block:
            key = cell << _U(32) | (key & _U(0xFFFFFFFF))
        order = np.argsort(key, kind="stable") if block else np.lexsort((more, key))
        key, more = key[order], more[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])]) if len(key) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        self.at, self.group = at[order], np.cumsum(new) - 1
        self.key, self.more, self.cell = key[heads], more[heads], cell[order][heads].astype(np.int64)
        self.twice = np.diff(np.append(heads, len(key))) > 1
        aligned = ((at - words.first[words.text[at]]) % block == 0) if block else np.ones(len(at), bool)
        self.anchor = np.maximum.reduceat(aligned[order], heads) if len(heads) else np.zeros(0, bool)
        self.cells, self.begin = np.unique(self.cell, return_index=True)
        self.end = np.append(self.begin[1:], len(self.cell))

    def rows(self, chunk: int) -> list[tuple]:
        """(chunk, cell, keys, more, twice, anchor, n) for each cell."""
        found = []
        for cell, a, b in zip(self.cells.tolist(), self.begin, self.end):
            found.append((chunk, cell, _packed(self.key[a:b]), _squeezed(self.more[a:b].tobytes()), _bits(self.twice[a:b]), _bits(self.anchor[a:b]), int(b - a)))
        return found

    def hits(self, answers: dict[int, bytes]) -> np.ndarray:
        """Where the windows are that have a twin, sorted."""
        yes = np.zeros(len(self.key), bool)
        for cell, a, b in zip(self.cells.tolist(), self.begin, self.end):
            if cell in answers:
                yes[a:b] = _unbits(answers[cell], b - a)
        return np.sort(self.at[yes[self.group]])


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def _packed(key: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: their differences, byte by byte of rising weight, compressed."""
    gaps = np.diff(key, prepend=_U(0))
    return _squeezed(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=_U)


ASKS = "chunk long, cell long, keys binary, more binary, twice binary, anchor binary, n long"


def _ask_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["chunk", "cell", "keys", "more", "twice", "anchor", "n"])


def _answered(rows: list[tuple]) -> list[bytes]:
    """For each chunk's question to a cell, the bits of its hashes that are found twice, once of them on a block's start."""
    sizes = [r[-1] for r in rows]
    key = np.concatenate([_unpacked(r[2], r[-1]) for r in rows])
    more = np.concatenate([np.frombuffer(pa.decompress(r[3], 2 * r[-1], "zstd"), np.uint16) for r in rows])
    twice = np.concatenate([_unbits(r[4], r[-1]) for r in rows])
    anchor = np.concatenate([_unbits(r[5], r[-1]) for r in rows])
    order = np.lexsort((more, key)) if more.any() else np.argsort(key, kind="stable")
    key, more = key[order], more[order]
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])]))
    n = np.diff(np.append(heads, len(key)))
    yes = ((n > 1) | np.maximum.reduceat(twice[order], heads)) & np.maximum.reduceat(anchor[order], heads)
    found = np.zeros(len(key), bool)
    found[order] = np.repeat(yes, n)
    return [_bits(part) for part in np.split(found, np.cumsum(sizes)[:-1])]


def _cell_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions sorted by cell -> chunk, cell, bits."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(_answered(rows), pa.binary())], ["chunk", "cell", "bits"])

    now: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if now and row[1] != now[0][1]:
                yield done(now)
                now = []
            now.append(row)
    if now:
        yield done(now)


def _answers(asks: DataFrame, cells: int, name: str) -> DataFrame:
    """chunk, cell, bits of the questions ``asks``."""
    tasks = max(asks.sparkSession.sparkContext.defaultParallelism, cells)
    return cut(asks.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(_cell_task, "chunk long, cell long, bits binary"), name)


def _chunk_task(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            body, words = b"\n".join(texts), sum(len(t.split()) for t in texts)
            columns = [[base + made], [ids], [np.array([len(t) for t in texts], "<i8").tobytes()], [_squeezed(body)], [len(body)], [words]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "ids", "lengths", "body", "size", "words"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                if texts and size + len(text) > chunk_bytes:
                    yield row()
                    made, ids, texts, size = made + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield row()

    return run


def _texts(lengths: bytes, body: bytes, size: int) -> list[bytes]:
    whole, at, texts = pa.decompress(body, size, "zstd", asbytes=True) if size else b"", 0, []
    for n in np.frombuffer(lengths, "<i8").tolist():
        texts.append(whole[at : at + n])
        at += n + 1
    return texts


def _candidates(words: Words, hits: np.ndarray, width: int, block: int) -> np.ndarray:
    """Starts of the windows of ``width`` that hold a hit block."""
    near = np.zeros(len(words.hashes) + 1, np.int32)
    np.add.at(near, np.maximum(hits - (width - block), 0), 1)
    np.add.at(near, hits + 1, -1)
    at = words.windows(width)
    return at[np.cumsum(near)[at] > 0]


def _removed(words: Words, at: np.ndarray, width: int) -> np.ndarray:
    """Words that a window starting ``at`` covers."""
    edges = np.zeros(len(words.hashes) + 1, np.int32)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return np.cumsum(edges)[:-1] > 0


def _by_chunk(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[tuple]:
    """Rows (chunk, kind, cell, bits, ids, lengths, body, size) sorted by the first two -> chunk, ids, texts, answers by kind."""
    now, held, answers = None, None, [{} for _ in range(kinds)]
    for batch in batches:
        for chunk, kind, cell, bits, ids, lengths, body, size in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk != now:
                if held is not None:
                    yield now, held[0], _texts(*held[1:]), answers
                now, held, answers = chunk, None, [{} for _ in range(kinds)]
            if kind == 0:
                held = ids, lengths, body, size
            else:
                answers[kind - 1][cell] = bits
    if held is not None:
        yield now, held[0], _texts(*held[1:]), answers


def _joined(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each chunk's row, then the answers to it, in one task."""
    none = [F.lit(None).cast(k).alias(c) for c, k in (("ids", "array<bigint>"), ("lengths", "binary"), ("body", "binary"), ("size", "bigint"))]
    rows = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("cell"), F.lit(None).cast("binary").alias("bits"), "ids", "lengths", "body", "size")
    for k, found in enumerate(answers, 1):
        rows = rows.union(found.select("chunk", F.lit(k).alias("kind"), "cell", "bits", *none))
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // 4))
    return rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind")


def repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans, n_removed, kept.

    ``spans`` are the maximal runs of words (from, to; to is not included) that
    windows of ``width`` words cover which occur more than once, in any texts
    or in one; ``kept`` is the other words, joined by one space. Windows are
    equal if all their words are; they are compared by 80 bits of hash. Null
    texts are empty; rows that share id and text are copies like others; whole
    texts count, however long; an empty table gives no rows. Other columns are
    not read.
    """
    block = (width + 1) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = cut(rows.mapInArrow(_chunk_task(chunk_bytes), "chunk long, ids array<long>, lengths binary, body binary, size long, words long"), "chunks")
    words = chunks.agg(F.sum("words")).first()[0] or 0
    cells = -(-max(words, 1) // min(MOST_WORDS, max(least_words, words // CELLS)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lengths, body, size in zip(*(c.to_pylist() for c in batch.columns)):
                own = Words(_texts(lengths, body, size))
                yield _ask_batch(Asked(own, own.windows(block), block, cells, block).rows(chunk))

    anchored = _answers(chunks.select("chunk", "lengths", "body", "size").mapInArrow(first, ASKS), cells, "anchors")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts, (hits,) in _by_chunk(batches, 1):
            own = Words(texts)
            near = _candidates(own, Asked(own, own.windows(block), block, cells, block).hits(hits), width, block)
            yield _ask_batch(Asked(own, near, width, cells, None).rows(chunk))

    extended = _answers(_joined(chunks, anchored).mapInArrow(second, ASKS), cells, "repeats")

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, (hits, twins) in _by_chunk(batches, 2):
            own = Words(texts)
            near = _candidates(own, Asked(own, own.windows(block), block, cells, block).hits(hits), width, block)
            gone = _removed(own, Asked(own, near, width, cells, None).hits(twins), width)
            columns: list[list] = [[], [], [], [], []]
            for doc_id, text, at, n in zip(ids, texts, own.first.tolist(), own.count.tolist()):
                out, split = gone[at : at + n], text.split()
                edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                kept = split if not len(edges) else [split[k] for k in np.flatnonzero(~out).tolist()]
                for column, value in zip(columns, (doc_id, n, [{"from": a, "to": b} for a, b in edges.reshape(-1, 2).tolist()], int(out.sum()), b" ".join(kept))):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.int64(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*made[:4], made[4].cast(pa.string())], ["doc_id", "n_words", "spans", "n_removed", "kept"])

    return _joined(chunks, anchored, extended).mapInArrow(third, "doc_id long, n_words long, spans array<struct<from: long, to: long>>, n_removed long, kept string")
