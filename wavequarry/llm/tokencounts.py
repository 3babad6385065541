"""Token counts from per-document pre-token frequencies.

A tokenizer cuts a text into pre-tokens and each of those into pieces, so a
text's count is the sum over its pre-tokens of frequency times pieces. Pieces
are counted once per distinct pre-token of the corpus. The most frequent
pre-tokens, at most ``frequent``, are sent to the tasks, which settle them where
the text is read; the rest, nearly all of them rare, are joined by pre-token.
So no hot pre-token is shuffled, and no ids are made. A corpus with no more
distinct pre-tokens than that has nothing left to join; the counts are the same.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut

#: Pre-tokens that are sent to the tasks, at most: those that would be hot keys of the join, which has all others at any size of corpus.
FREQUENT = 1 << 15
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 1 << 18
#: Texts with other characters take the library's own way: here ``re`` and the library agree on case, letters, digits and spaces.
ELSEWHERE = re.compile("[^\t\n\r -~¡-±´-¸º»¿-įı-ɏ]")
# The rules of normalising and cutting, as tokenizer files state them, that the pattern below says in ``re`` after lower-casing.
KNOWN_RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Cutter:
    """The pre-tokens of a tokenizer file; its pieces never span two of them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        cuts = json.dumps(rules["pre_tokenizer"])
        if not rules["pre_tokenizer"] or '"add_prefix_space": true' in cuts or "Metaspace" in cuts:
            raise ValueError(f"{path}: pieces are not those of pre-tokens by themselves")
        self.known = [rules["normalizer"], rules["pre_tokenizer"]] == KNOWN_RULES
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.start = os.path.commonprefix(special)

    def counts(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the text's pre-tokens, and how many special tokens its text spells."""
        parts, n_special = [text], 0
        if self.special and self.start in text:
            parts = self.special.split(text)
            n_special = len(parts) - 1
        found: Counter = Counter()
        for part in parts:
            if self.known and not ELSEWHERE.search(part):
                found.update(PRETOKENS.findall(part.lower()))
                continue
            line = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
            found.update(line[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(line))
        return found, n_special


@cache
def cutter(path: str) -> Cutter:
    return Cutter(path)


def _vocabulary_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    held.update(cutter(path).counts(text.as_py())[0])
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return run


def _pieces_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = cutter(path).tokenizer
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                encoded = tokenizer.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(e) for e in encoded], pa.int64())], ["pretoken", "n", "pieces"])

    return run


def vocabulary(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """pretoken, n (its frequency in the corpus), pieces: every distinct pre-token once."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_vocabulary_task(path), "pretoken string, n long")
    return found.groupBy("pretoken").agg(F.sum("n").alias("n")).mapInArrow(_pieces_task(path), "pretoken string, n long, pieces long")


def least_frequency(words: DataFrame, most: int) -> int:
    """A frequency that at most ``most`` rows (n) reach, from their numbers in a few hundred classes of n."""
    grade = F.floor(F.log2(F.col("n")) * 16).cast("int")
    found = sorted(words.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect(), reverse=True)
    least, total = 1 << 62, 0
    for row in found:
        total += row["rows"]
        if total > most:
            break
        least = row["least"]
    return least


def _count_task(path: str, frequent):
    names = ["row", "doc_id", "n_bytes", "settled", "pretoken", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            out: list[list] = [[] for _ in names]

            def rows() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                for c in out:
                    c.clear()
                return made

            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                found, settled = cutter(path).counts(text)
                rare = []
                for pretoken, n in found.items():
                    pieces = known.get(pretoken)
                    if pieces is None:
                        rare.append((pretoken, n))
                    else:
                        settled += pieces * n
                # The first row carries what is settled; without rare pre-tokens its key is one that none can have.
                rare = rare or [(f" {row}", 0)]
                k = len(rare)
                out[0] += [row] * k
                out[1] += [doc_id] + [None] * (k - 1)
                out[2] += [len(text.encode())] + [0] * (k - 1)
                out[3] += [settled] + [0] * (k - 1)
                out[4] += [p for p, _ in rare]
                out[5] += [n for _, n in rare]
                if len(out[0]) > 50_000:
                    yield rows()
            if out[0]:
                yield rows()

    return run


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the ``tokenizers`` library without special tokens
    added; special tokens that a text spells count as one. Null counts as the
    empty text, which has 0 tokens. Repeated rows and null ids are rows like
    any other; whole texts are read, however long, and other columns of
    ``docs`` are not. An empty table gives no rows. A tokenizer whose pieces
    are not those of its pre-tokens by themselves is refused.
    """
    path = public_tokenizers.path(f"{tokenizer}.json")
    words = cut(vocabulary(docs, path, text_col), "vocabulary")
    top = words.where(F.col("n") >= least_frequency(words, frequent)).select("pretoken", "pieces").toPandas()  # at most ``frequent`` rows
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(top["pretoken"], top["pieces"].tolist())))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_count_task(path, known), "row long, doc_id long, n_bytes long, settled long, pretoken string, n int")
    counted = rows.join(words.select("pretoken", "pieces").hint("merge"), "pretoken", "left")
    n_tokens = F.sum(F.col("settled") + F.col("n") * F.coalesce("pieces", F.lit(0)))
    counted = counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), n_tokens.alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
