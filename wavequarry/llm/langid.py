"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from every training row; a task hands on one row per language and
bucket. The log-probability matrix has buckets x languages floats and is sent to
the tasks, which turn a batch of texts into one sparse matrix of n-gram counts
and multiply. Languages go in blocks of ``BLOCK``, each with a matrix of its own
that is sent, so what is sent at a time has a fixed size however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out

#: Buckets of the hash, a power of two.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Characters hashed, and counts multiplied, at a time.
STRETCH = 1 << 18
#: Languages of one matrix.
BLOCK = 128
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points between two spaces, runs of anything but letters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (points >= 97) & (points <= 122)
    letter = ascii_letter | (points > 191)
    first = np.empty(len(points), bool)
    first[:1] = True
    first[1:] = letter[:-1]
    kept = letter | first
    return np.concatenate(([32], np.where(letter, points, 32)[kept], [32])).astype(np.uint32)


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each run of ``order`` code points."""
    h = np.zeros(max(0, len(points) - order + 1), np.uint64)
    for k in range(order):
        h = h * MULTIPLIERS[0] + points[k : k + len(h)]
    h = (h + np.uint64(order)) * MULTIPLIERS[1]
    return ((h ^ (h >> np.uint64(29))) * MULTIPLIERS[2] >> np.uint64(49)).astype(np.int64)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) -> lang, bucket, n; bucket -1 counts documents."""
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if has_letter(text):
                points = code_points(text)
                mine = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for order in ORDERS:
                    mine += np.bincount(buckets(points, order), minlength=BUCKETS)
    for lang, mine in counts.items():
        used = np.flatnonzero(mine)
        column = np.concatenate(([-1], used)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(column)), pa.array(column), pa.array(np.concatenate(([docs[lang]], mine[used])))], ["lang", "bucket", "n"])


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, bucket, n from rows (lang, text); bucket -1 has the number of documents."""
    counted = rows.where("lang is not null").select("lang", "text").mapInArrow(_count_task, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_matrix(counts: DataFrame, langs: list[str], smoothing: float = 0.5) -> np.ndarray:
    """Log probabilities (buckets x languages) of the n-grams in ``langs``; at most buckets x languages rows come to the driver."""
    table = counts.where("bucket >= 0").where(F.col("lang").isin(langs)).toPandas()
    column = table["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy(int)
    n = np.full((BUCKETS, len(langs)), smoothing)
    np.add.at(n, (table["bucket"].to_numpy(int), column), table["n"].to_numpy(float))
    return np.log(n / n.sum(0)).astype(np.float32)


def sparse_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, buckets, counts) of the texts' n-grams: a sparse matrix by rows; no counts for texts without a letter."""
    starts, columns, values = [0], [], []
    for text in texts:
        if has_letter(text):
            points, mine = code_points(text), np.zeros(BUCKETS, np.int64)
            for order in ORDERS:
                for at in range(0, len(points), STRETCH):
                    mine += np.bincount(buckets(points[at : at + STRETCH + order - 1], order), minlength=BUCKETS)
            used = np.flatnonzero(mine)
            columns.append(used)
            values.append(mine[used])
        starts.append(starts[-1] + (len(columns[-1]) if has_letter(text) else 0))
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    return np.array(starts), join(columns), join(values)


def multiply(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The sparse matrix times ``matrix``, a stretch of its counts at a time."""
    out = np.zeros((len(starts) - 1, matrix.shape[1]))
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for at in range(0, len(columns), STRETCH):
        part = slice(at, at + STRETCH)
        terms = matrix[columns[part]] * values[part, None]
        first = np.flatnonzero(np.diff(owner[part], prepend=-1))
        out[owner[part][first]] += np.add.reduceat(terms, first, axis=0, dtype=np.float64)
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (posterior of lang_pred).

    Rows with crc32(id) mod ``modulus`` equal to ``remainder`` are held out of
    the training; so are null languages and texts without a letter. Null texts
    and texts without a letter, and all texts when there is nothing to learn
    from, get ``und`` with score 0. Ties go to the first language by name.
    Null ids take part in the training; repeated rows count as often as they
    come. Whole texts are read, however long; other columns of ``docs`` are not
    read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = held_out(F.col("doc_id"), modulus, remainder)
    counts = cut(count_grams(rows.where(~out)), "grams")
    documents = {r.lang: r.n for r in counts.where("bucket < 0").collect()}  # one row per language
    langs, total = sorted(documents), max(1, sum(documents.values()))
    state = rows.select("doc_id", out.alias("held_out"), "text", F.lit("und").alias("lang_pred"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("mass"))
    for at in range(0, len(langs), BLOCK):
        block = langs[at : at + BLOCK]
        prior = np.log(np.array([documents[lang] for lang in block]) / total)
        state = state.mapInArrow(_score_task(docs.sparkSession.sparkContext.broadcast((block, prior, log_matrix(counts, block)))), state.schema)
    return state.select("doc_id", "held_out", "lang_pred", F.when(F.col("mass") > 0, 1 / F.col("mass")).otherwise(0.0).alias("score"))


def _score_task(model):
    """Carries a batch past one block of languages: best is the largest log score so far, mass all likelihoods over the best one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, matrix = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, columns, values = sparse_counts(batch.column("text").to_pylist())
            log = prior + multiply(starts, columns, values, matrix)
            named = np.diff(starts) > 0
            best, mass, found = batch.column("best").to_numpy(), batch.column("mass").to_numpy(), batch.column("lang_pred").to_pylist()
            own = log.argmax(1)
            top = np.maximum(best, log.max(1))
            mass = np.where(named, mass * np.exp(np.minimum(best - top, 0.0)) + np.exp(log - top[:, None]).sum(1), mass)
            found = [langs[k] if n and better else f for k, n, better, f in zip(own, named, log.max(1) > best, found)]
            made = {"lang_pred": pa.array(found, pa.string()), "best": pa.array(np.where(named, top, best)), "mass": pa.array(mass)}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return run
