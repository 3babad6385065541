"""Quality rules: an isolation forest over rule statistics.

Every text gives a handful of rule statistics. An isolation forest is grown on
those of labelled good documents: each tree cuts the box that holds all
labelled rows at random values of random statistics, until each of its sample
rows stands alone, and rows that stand alone after few cuts are unlike the
sample. Cutting the whole box rather than the sample's range matters, as many
statistics are nearly constant in good documents. The score at which a document
is rejected is set from all labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut

#: Characters that count as symbols, and the characters between words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
#: Statistics that the forest sees, all ratios or logarithms so that length alone does not make a document odd.
FEATURES = ["word_len", "symbol_root", "adjacent_root", "distinct_rate", "capital_root", "mark_root", "log_words"]
_BARE_LINE = re.compile(r"[\x20\x09-\x0D]*\Z")


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in an 8-word window which occurs at least twice."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    for half in (1, 2, 4):  # number the windows of 2, 4, then 8 words, by pairs of numbers of their halves
        pairs = ids[: len(ids) - half].astype(np.int64) * (int(ids.max()) + 1) + ids[half:]
        seen, ids = np.unique(pairs, return_inverse=True)
        if len(seen) == len(pairs):
            return 0
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(ids) + WINDOW, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: str | None) -> tuple[int | float, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the FEATURES; zeros for null."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    if not n:
        return (0, 0, sum(text.count(c) for c in SYMBOLS), 0, 0, *[0.0] * len(FEATURES))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if not _BARE_LINE.match(line):
            dups += line in seen
            seen.add(line)
    repeated = repeated_words(ids)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    marks = sum(text.count(c) for c in "!?|")
    adjacent = int((ids[1:] == ids[:-1]).sum())
    # Roots spread out the small rates, in which good and odd documents differ.
    rates = [chars / n, (symbols / n) ** 0.5, (adjacent / n) ** 0.5, float(np.log1p(len(number)) / np.log1p(n)), (capitals / chars) ** 0.5, (marks / n) ** 0.5, float(np.log1p(n))]
    return (n, chars, symbols, dups, repeated, *rates)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def _statistics_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(text.as_py()) for text in batch.column(1)]
        if rows:
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *COUNTS, *FEATURES])


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts and the forest's features of each row; zeros for null texts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics_task, SCHEMA)


class IsolationForest:
    """Isolation trees in arrays: node k of a tree has children left[k] and left[k] + 1, or none (left[k] = 0)."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 7):
        self.trees, self.sample, self.seed = trees, sample, seed
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def fit(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, deepest: int = 16) -> IsolationForest:
        """Each tree draws ``sample`` of the rows and cuts the box from low to high."""
        rng = np.random.default_rng(self.seed)
        n = min(self.sample, len(rows))
        self.norm = max(self._expected(n), 1.0)
        for _ in range(self.trees):
            feature, value, left, path = [0], [0.0], [0], [0.0]
            todo = [(0, rows[rng.choice(len(rows), n, replace=False)], low, high, 0)]
            while todo:
                node, here, low_, high_, depth = todo.pop()
                open_ = np.flatnonzero(high_ > low_)
                if len(here) < 2 or depth >= deepest or not len(open_):
                    path[node] = depth + self._expected(len(here))
                    continue
                f = int(rng.choice(open_))
                v = float(rng.uniform(low_[f], high_[f]))
                feature[node], value[node], left[node] = f, v, len(left)
                below, above = high_.copy(), low_.copy()
                below[f] = above[f] = v
                todo.append((len(left), here[here[:, f] <= v], low_, below, depth + 1))
                todo.append((len(left) + 1, here[here[:, f] > v], above, high_, depth + 1))
                for column in (feature, value, left, path):
                    column += [0, 0]
            self.grown.append(tuple(map(np.array, (feature, value, left, path))))
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): towards 1 for rows that stand alone early."""
        total = np.zeros(len(rows))
        for feature, value, left, path in self.grown:
            at = np.zeros(len(rows), np.int64)
            while True:
                inner = np.flatnonzero(left[at])
                if not len(inner):
                    break
                k = at[inner]
                at[inner] = left[k] + (rows[inner, feature[k]] > value[k])
            total += path[at]
        return np.exp2(-total / (len(self.grown) * self.norm))


def reject_above(bins: pd.DataFrame, most_lost: float = 0.002) -> float:
    """Score above which documents are rejected, from rows (bin in thousandths, good 0/1, n).

    Of the scores that lose at most ``most_lost`` of the good rows, the one
    that rejects most bad rows; where several reject as many, their middle.
    Without bad rows nothing is rejected.
    """
    n = np.zeros((2, 1002))
    for b, good, count in bins.itertuples(index=False):
        n[int(good), int(b)] += count
    if not n[0].sum():
        return 1.0
    above = n[:, ::-1].cumsum(1)[:, ::-1]  # rows in this bin and above
    allowed = above[1] <= most_lost * n[1].sum()
    best = np.where(allowed, above[0], -1)
    return float(np.flatnonzero(best == best.max())[[0, -1]].mean()) / 1000


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    good_col: str = "quality",
    trees: int = 100,
    sample: int = 256,
    least_words: int = 20,
    most_repeated: int = 30,
    most_lost: float = 0.002,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the base counts, base_failed, kept, score.

    The forest is grown on at most trees * sample labelled good rows, those
    whose ids have the smallest hashes; the score to reject at comes from all
    labelled rows that pass the base rules. Null and empty texts have zeros
    and fail the base rules. Ids with both labels, repeated ids and null ids
    are scored like any other, each row for itself; labels of unknown ids are
    ignored. Without labelled good rows the base rules alone decide, score 0.
    """
    stats = cut(rule_statistics(docs, id_col, text_col), "statistics")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(good_col).cast("int").alias("good")).where("good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    labelled = stats.where(~failed).join(given, "doc_id")
    first = bounded_sample(labelled.where("good = 1"), "doc_id", trees * sample).select(*FEATURES).orderBy(*FEATURES).toPandas()
    columns = ["doc_id", "n_words", *COUNTS[1:], failed.alias("base_failed")]
    if first.empty:
        return stats.select(*columns, (~failed).alias("kept"), F.lit(0.0).alias("score"))
    rows = first.to_numpy(float)
    box = labelled.agg(*[F.min(c) for c in FEATURES], *[F.max(c) for c in FEATURES]).first()
    forest = IsolationForest(trees, sample).fit(rows, np.array(box[: len(FEATURES)]), np.array(box[len(FEATURES) :]))
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def score_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in FEATURES])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.score(x))], [*batch.schema.names, "score"])

    scored = cut(stats.mapInArrow(score_task, SCHEMA + ", score double"), "scores")
    bins = scored.where(~failed).join(given, "doc_id").groupBy(F.floor(F.col("score") * 1000).cast("int").alias("bin"), "good").count().toPandas()
    limit = reject_above(bins, most_lost)
    return scored.select(*columns, (~failed & (F.col("score") < limit)).alias("kept"), "score")
