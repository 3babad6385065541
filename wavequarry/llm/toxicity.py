"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes: insult, threat, target, negation, reported speech,
or other; marks as commas, colons, quotes or stops. One small machine follows
each of negation, reported speech and target. They are composed and run over a
text from both ends, since German and French negate after the verb and a
speaker may be named after the quote. The two states at an insult or threat say
whether it is negated, reported or quoted, and aimed at somebody, and its weight
is discounted or raised accordingly. A logistic model over a document's scores,
and their share of its words, gives its probability.

Weights of words and word beginnings, and the logistic model, are learned from
at most ``SAMPLE`` labelled documents, those whose ids have the smallest hashes.
Of copies among them (by the smallest hash of their word shingles) one counts,
since the words of a text that many rows repeat would look like evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, cut, held_out
from .simhash import shingle_hashes

SAMPLE = 20_000
#: Learned words and beginnings that are kept, at most: those with the most evidence.
LEXICON = 20_000
#: Distinct terms that a task holds before it hands them on.
HELD = 100_000
#: Letters of a learned word beginning.
STEMS = (3, 4, 5, 6, 7, 8)
#: Toxic documents that a beginning must have for each one of its most frequent word: it stands for several words.
VARIETY = 1.5
#: Documents from which a word under a learned beginning is judged by itself.
KNOWN_WORD = 5
#: A word or beginning is learned if it has so many more toxic documents than its share, in standard deviations.
LEAST_Z = 4.4
#: The logistic model learns from clauses scored without what their own fold taught.
FOLDS = 4

# Words of the grammar's classes in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons scum trash loser losers clown clowns stupid pathetic worthless disgusting".split()
THREATS = "kill hurt destroy burn shoot stab strangle töten umbringen verletzen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yours he him she her they them their this that these those people everyone du dich dein ihr euch sie diese tu toi vous ton ta ces tú usted ustedes ellos estos".split()
NEGATIONS = "not no never without neither nor nicht kein keine nie niemals ne pas jamais sans nunca jamás sin".split()
REPORTS = "said says told called calls wrote quoted quotes claimed alleged reported sagte nannte schrieb dit appelé écrit dijo llamó escribió".split()

#: Negations that also reach back.
AFTER = "nicht nie pas jamais rien".split()

CLASS = {w: c for c, words in (("target", TARGETS), ("negation", NEGATIONS), ("after", AFTER), ("report", REPORTS), ("threat", THREATS)) for w in words}
MARKS = {",": "comma", ":": "colon"} | dict.fromkeys('"«»„“”', "quote") | dict.fromkeys(".;!?\n|()", "stop")
CLASSES = ["other", "target", "negation", "after", "report", "insult", "threat", "comma", "colon", "quote", "stop"]
SEED_WEIGHT, THREAT_WEIGHT = 4.0, 4.0
#: Factors of a match's weight; the last one is of threats that are aimed at nobody.
NEGATED, REPORTED, TARGETED, AIMLESS = 0.25, 0.4, 1.5, 0.25
#: Words after a negation that it reaches.
REACH = 3

_WORDS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile("[^\\W\\d_]+|[.,;:!?\n|\"()«»„“”]")


def _negation(state: int, token: str) -> int:
    if token in ("negation", "after"):
        return REACH
    return 0 if token in MARKS.values() else max(0, state - 1)


def _negation_after(state: int, token: str) -> int:
    """Read from the end: an ``after`` word reaches what stands before it."""
    if token == "after":
        return REACH
    return 0 if token in MARKS.values() else max(0, state - 1)


def _report(state: int, token: str) -> int:
    """0 none, 1 after the verb, 2 after its colon, 3 in its quote, 4 after the verb and a comma: then only a quote goes on."""
    if state == 3:
        return 0 if token == "quote" else 3
    if token == "report":
        return 1
    if token == "stop":
        return 0
    if state in (1, 4) and token == "quote":
        return 3
    if state in (1, 4) and token == "colon":
        return 2
    if token == "comma" and state == 1:
        return 4
    return 0 if state == 4 else state


def _report_after(state: int, token: str) -> int:
    """Read from the end: up to two words after a quote may be the verb; 5 is in that quote, 1 and 2 after the verb."""
    if state == 5:
        return 0 if token == "quote" else 5
    if token == "quote":
        return 5 if state else 0
    if token == "report":
        return 2
    return state if token == "comma" else max(0, state - 1)


def _target(state: int, token: str) -> int:
    if token == "stop":
        return 0
    return 1 if token == "target" else state


def compose(*machines) -> dict[tuple[tuple[int, ...], str], tuple[int, ...]]:
    """Transitions of the machines run side by side, from all of them in state 0."""
    table, todo = {}, [(0,) * len(machines)]
    while todo:
        state = todo.pop()
        for token in CLASSES:
            if (state, token) not in table:
                table[state, token] = tuple(m(s, token) for m, s in zip(machines, state))
                todo.append(table[state, token])
    return table


FORWARD = compose(_negation, _report, _target)
BACKWARD = compose(_negation_after, _report_after, _target)


def token_class(token: str, weights: dict[str, float]) -> str:
    if token in MARKS:
        return MARKS[token]
    return "insult" if token in weights else CLASS.get(token, "other")


def clause_score(tokens: list[str], weights: dict[str, float]) -> tuple[float, float, int]:
    """(full, discounted, clauses) of lower-cased words and marks: scores of the matches that hold and of those negated or reported, and clauses with one that holds.

    A word counts where it comes first in its clause.
    """
    kinds = [token_class(t, weights) for t in tokens]
    state, ahead = (0, 0, 0), []
    for kind in reversed(kinds):
        ahead.append(state)
        state = BACKWARD[state, kind]
    state, full, discounted, clauses, held = (0, 0, 0), 0.0, 0.0, 0, False
    seen: set[str] = set()
    for token, kind, behind in zip(tokens, kinds, reversed(ahead)):
        if kind in ("insult", "threat") and token not in seen:
            seen.add(token)
            aimed = state[2] or behind[2]
            weight = weights.get(token, THREAT_WEIGHT) * (TARGETED if aimed else AIMLESS if kind == "threat" else 1.0)
            negated, reported = state[0] or behind[0], state[1] in (1, 2, 3) or behind[1] == 5
            if negated or reported:
                discounted += weight * (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
            else:
                full += weight
                held = True
        elif kind in ("stop", "comma", "colon", "quote"):
            seen.clear()
            clauses, held = clauses + held, False
        state = FORWARD[state, kind]
    return full, discounted, clauses + held


def matches(distinct: set[str], lexicon: dict[str, float]) -> dict[str, float]:
    """Weights of those words that are insults: by themselves if the lexicon has them (0 for those known to be harmless), else by their beginning (``abcd*``)."""
    found = {}
    for w in distinct:
        weight = lexicon.get(w)
        if weight is None:
            weight = max(lexicon.get(w[:k] + "*", 0.0) for k in STEMS)
        if weight > 0:
            found[w] = weight
    return found


THREAT_SET = set(THREATS)
FEATURES = ["full", "discounted", "matched", "dense"]


def features(text: str | None, lexicon: dict[str, float]) -> tuple[float, float, float, float]:
    """Log of the full score, of the discounted one, of the clauses with a match that holds, and of the full score per hundred words."""
    lower = (text or "").lower()
    words = _WORDS.findall(lower)
    distinct = set(words)
    weights = matches(distinct, lexicon)
    if not weights and distinct.isdisjoint(THREAT_SET):
        return 0.0, 0.0, 0.0, 0.0
    full, discounted, clauses = clause_score(_TOKENS.findall(lower), weights)
    return float(np.log1p(full)), float(np.log1p(discounted)), float(np.log1p(clauses)), float(np.log1p(100 * full / (len(words) + 20)))


def terms(text: str | None) -> set[str]:
    """Distinct words of at least three letters, and beginnings of longer ones."""
    words = {w for w in _WORDS.findall((text or "").lower()) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def _terms_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic, fold) -> term, fold, number of toxic documents, of others; a null term counts the documents."""
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list({key[:2] for key in counts})
        columns = [[t for t, _ in keys], [f for _, f in keys], *([counts[t, f, y] for t, f in keys] for y in (1, 0))]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["term", "fold", "toxic", "clean"])
        counts.clear()
        return made

    for batch in batches:
        for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            counts.update((t, fold, toxic) for t in terms(text.as_py()))
            counts[None, fold, toxic] += 1
            if len(counts) > HELD:
                yield rows()
    if counts:
        yield rows()


def term_weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds against the share of toxic documents, less their standard error; 0 where the excess is too small."""
    share = n_toxic / (n_toxic + n_clean)
    n = toxic + clean
    z = (toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    odds = np.log((toxic + 0.5) / (clean + 0.5)) - np.log(share / (1 - share))
    return np.where(z >= LEAST_Z, np.maximum(0.0, odds - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))), 0.0)


def lexicon_of(rows: pd.DataFrame, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the rows' terms from counts of documents: words and beginnings with enough evidence, and 0 for words known to be harmless."""
    weights = term_weights(toxic, clean, n_toxic, n_clean)
    words = {t: (w, n, m) for t, w, n, m in zip(rows["term"], weights, toxic, toxic + clean) if not t.endswith("*")}
    most: dict[str, float] = {}
    for t, (_, n, _) in words.items():
        for k in STEMS:
            most[t[:k] + "*"] = max(most.get(t[:k] + "*", 0.0), n)
    starts = {t: float(w) for t, w, n in zip(rows["term"], weights, toxic) if w > 0 and t.endswith("*") and n >= VARIETY * most.get(t, 0.0)}
    return starts | {t: float(w) for t, (w, _, m) in words.items() if w > 0 or m >= KNOWN_WORD}


def learn_lexicons(sample: DataFrame, most: int = LEXICON) -> list[dict[str, float]]:
    """FOLDS + 1 lexicons from rows (text, toxic, fold): each without one fold, and the one from all; at most ``most`` terms and as many harmless words."""
    seeds = dict.fromkeys(INSULTS, SEED_WEIGHT)
    counted = sample.select("text", "toxic", "fold").mapInArrow(_terms_task, "term string, fold int, toxic long, clean long")
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c))).alias(f"{c}{f}") for c in ("toxic", "clean") for f in range(FOLDS)]
    counted = cut(counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *by_fold).fillna(0), "terms")
    total = counted.where("term is null").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return [seeds] * (FOLDS + 1)
    share = total["toxic"] / (total["toxic"] + total["clean"])
    n = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share))
    told = cut(counted.where("term is not null").where(z >= LEAST_Z).orderBy(z.desc(), "term").limit(most), "told")
    starts = told.where(F.endswith("term", F.lit("*"))).select(F.col("term").alias("start"))
    # Words of a learned beginning that are known well enough and are not told by themselves.
    plain = counted.where(~F.endswith("term", F.lit("*"))).where((n >= KNOWN_WORD) & (z < LEAST_Z))
    under = plain.withColumn("start", F.explode(F.array(*[F.concat(F.substring("term", 1, k), F.lit("*")) for k in STEMS])))
    under = under.join(F.broadcast(starts), "start", "left_semi").drop("start").distinct().orderBy(n.desc(), "term").limit(most)
    rows = told.union(under.select(told.columns)).toPandas()  # at most 2 * most rows
    lexicons = []
    for f in range(FOLDS + 1):
        toxic, clean, n_toxic, n_clean = ((src[c] - src[f"{c}{f}"] if f < FOLDS else src[c]) for src in (rows, total.asDict()) for c in ("toxic", "clean"))
        lexicons.append(seeds | lexicon_of(rows, toxic.to_numpy(float), clean.to_numpy(float), n_toxic, n_clean) if n_toxic and n_clean else seeds)
    return lexicons


#: Bias and weights of the features that the fit is drawn towards, used as they are without labels of both kinds.
DEFAULT = np.array([-5.0, 2.5, 0.0, 1.0, 0.2])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 50) -> np.ndarray:
    """Bias and weights by Newton steps, drawn towards DEFAULT."""
    a = np.column_stack([np.ones(len(x)), x])
    w = DEFAULT.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        change = np.linalg.solve(hessian, a.T @ (y - p) - ridge * (w - DEFAULT))
        w += np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return w


def _sketch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of the text's word shingles, which copies share."""
    for batch in batches:
        least = [min(shingle_hashes(t.as_py()), default=0) >> 1 for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["text", "toxic", "sketch"])


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, limit: int) -> DataFrame:
    """text, toxic, fold of at most ``limit`` labelled rows, one of each group of copies; docs has doc_id and text, labels doc_id and toxic."""
    ids = bounded_sample(labels.where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", limit)
    sketched = docs.join(F.broadcast(ids), "doc_id").select("text", "toxic").mapInArrow(_sketch_task, "text string, toxic int, sketch long")
    return cut(sketched.groupBy("sketch").agg(F.min_by(F.struct("text", "toxic"), F.struct("toxic", "text")).alias("r")).select("r.*", F.pmod(F.xxhash64("sketch"), F.lit(FOLDS)).cast("int").alias("fold")), "sample")


class ToxicityModel:
    """Lexicon and logistic weights; ``probability`` scores a text column."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score_batch(self, texts: pa.Array) -> np.ndarray:
        x = np.array([features(t.as_py(), self.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))

    def probability(self, text: Column, spark: SparkSession) -> Column:
        model = spark.sparkContext.broadcast(self)  # at most LEXICON words

        @F.arrow_udf("double")
        def toxic_probability(texts: pa.Array) -> pa.Array:
            return pa.array(model.value.score_batch(texts))

        return toxic_probability(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, remainder: int = 1, sample: int = SAMPLE, terms: int = LEXICON) -> ToxicityModel:
    """The model of the labelled rows; see ``score``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)")
    learn = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)
    known = training_sample(rows, given, learn, sample)
    found = learn_lexicons(known, terms)
    lexicons = docs.sparkSession.sparkContext.broadcast(found)

    def features_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py(), lexicons.value[fold]) for t, fold in zip(batch.column(0), batch.column(2).to_pylist())]
            if made:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in zip(*made)), batch.column(1)], [*FEATURES, "toxic"])

    schema = ", ".join(f"{c} double" for c in FEATURES) + ", toxic int"
    table = known.select("text", "toxic", "fold").mapInArrow(features_task, schema).toPandas()  # at most sample rows
    x, y = table[FEATURES].to_numpy(float), table["toxic"].to_numpy(float)
    return ToxicityModel(found[FOLDS], fit_logistic(x, y) if len(set(y)) == 2 else DEFAULT)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 3,
    remainder: int = 1,
    threshold: float = 0.7,
    sample: int = SAMPLE,
    terms: int = LEXICON,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels of rows with crc32(id) mod ``modulus`` equal to ``remainder`` are
    not read, nor are null labels or those of null ids. Null and empty texts
    have no clause and get the model's score for that. Repeated rows are scored
    each for itself, an id with both labels counts as toxic; whole texts are
    read, however long. Other columns of ``docs`` are not read. ``sample`` and
    ``terms`` bound the labelled rows and the lexicon. Without labels of both
    kinds the seeds and fixed weights are used. An empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, label_col, modulus, remainder, sample, terms)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col).cast("long"), modulus, remainder).alias("held_out"),
        model.probability(F.col(text_col), docs.sparkSession).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
