"""The clause grammar against a plain reading of each sentence, in four languages, and held-out recall."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wavequarry.llm import toxicity as T

W = dict.fromkeys(["idiot", "idiota", "scum", "trottel", "imbécile"], 4.0)


def score(text: str) -> tuple[float, float]:
    return T.clause_score(T._TOKENS.findall(text.lower()), {w: v for w, v in W.items()})[:2]


def test_insults_negated_reported_and_aimed():
    assert score("you idiot") == (6.0, 0.0) and score("what an idiot") == (4.0, 0.0)
    assert score("not an idiot") == (0.0, 1.0) and score("not one two three four idiot")[0] == 4.0
    assert score("she said idiot") == (0.0, 4.0 * 1.5 * 0.4)
    assert score("they will kill you")[0] == 6.0 and score("please burn the letters") == (1.0, 0.0) and score("nothing here") == (0.0, 0.0)


@pytest.mark.parametrize(
    "text",
    [
        'She said, "you idiot"', "He said: you are an idiot", '"You idiot," he wrote', "er sagte: du trottel", 'sagte er, „du trottel"', "elle a dit: tu es un imbécile", "elle a dit, «imbécile»",
        "«imbécile» dit elle", 'dijo: eres un idiota', '"idiota", dijo ella', "du bist kein trottel", "tu es un imbécile pas du tout", "ich werde dich töten nicht", "no eres idiota", "not you, never an idiot",
    ],
)
def test_reported_quoted_and_negated_ones_are_discounted(text):
    full, discounted = score(text)
    assert full == 0.0 and discounted > 0.0


@pytest.mark.parametrize("text", ["He said it was late. You idiot", 'She said, "come in". You idiot', "Not today. You idiot", "er sagte nichts; du trottel", "he said hello, you idiot"])
def test_what_follows_stays_whole(text):
    full, discounted = score(text)
    assert full == 6.0 and discounted == 0.0


def plain(tokens: list[str]) -> tuple[float, float]:
    """The rules read off one match at a time, looking back and ahead, without machines."""
    kind = [T.token_class(t, W) for t in tokens]
    marks = ("comma", "colon", "quote", "stop")
    full = discounted = 0.0
    clause_start = 0
    for i, k in enumerate(kind):
        if k in marks:
            clause_start = i + 1
        if k not in ("insult", "threat") or tokens[i] in tokens[clause_start:i]:
            continue
        near = []
        for j in range(i - 1, max(-1, i - 1 - T.REACH), -1):
            if kind[j] in marks:
                break
            near.append(kind[j] in ("negation", "after"))
        for j in range(i + 1, min(len(kind), i + 1 + T.REACH)):
            if kind[j] in marks:
                break
            near.append(kind[j] == "after")
        back = next((j for j in range(i - 1, -1, -1) if kind[j] == "stop"), -1)
        ahead = next((j for j in range(i + 1, len(kind)) if kind[j] == "stop"), len(kind))
        aimed = "target" in kind[back + 1 : i] + kind[i + 1 : ahead]
        weight = W.get(tokens[i], T.THREAT_WEIGHT) * (T.TARGETED if aimed else T.AIMLESS if k == "threat" else 1.0)
        negated, reported = any(near), quoted_before(kind, i) or quoted_after(kind, i)
        if negated or reported:
            discounted += weight * (T.NEGATED if negated else 1) * (T.REPORTED if reported else 1)
        else:
            full += weight
    return full, discounted


def quoted_before(kind: list[str], i: int) -> bool:
    """True if the words before i open a report that still holds at i."""
    verb, opened, how = None, None, None
    for j in range(i):
        if opened is not None:
            if kind[j] == "quote":
                verb = opened = how = None
            continue
        if kind[j] == "report":
            verb, how = j, "plain"
        elif kind[j] == "stop":
            verb = how = None
        elif verb is not None and how in ("plain", "comma") and kind[j] == "quote":
            opened = j
        elif verb is not None and how in ("plain", "comma") and kind[j] == "colon":
            how = "colon"
        elif verb is not None and how == "plain" and kind[j] == "comma":
            how = "comma"
        elif how == "comma":
            verb = how = None
    return opened is not None or (verb is not None and how in ("plain", "colon"))


def quoted_after(kind: list[str], i: int) -> bool:
    """True if i lies in a quote after which, within two words, a verb of reporting stands; quotes are paired from the end."""
    inside, j = None, len(kind) - 1
    for j in range(len(kind) - 1, i, -1):
        if kind[j] != "quote":
            continue
        if inside is not None:
            inside = None
            continue
        words = [k for k in kind[j + 1 :] if k != "comma"][:2]
        inside = j if "report" in words and words[: words.index("report")].count("quote") == 0 else None
    return inside is not None


def test_machines_say_what_a_plain_reading_says():
    rng = random.Random(4)
    vocabulary = ["idiot", "scum", "kill", "you", "not", "nicht", "said", "house", "tree", ",", ":", '"', ".", "idiot", "house"]
    for _ in range(4000):
        tokens = [rng.choice(vocabulary) for _ in range(rng.randint(1, 14))]
        assert T.clause_score(tokens, W)[:2] == pytest.approx(plain(tokens)), tokens


def test_held_out_recall_and_precision(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = T.score(d, y).where("held_out").join(y, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("hit")).collect()
    by = {r.toxic: r for r in got}
    assert by[1].hit >= 0.9 * by[1].n and by[0].hit <= 0.005 * by[0].n


def test_seeds_alone_need_more_than_a_word(spark):
    docs = spark.createDataFrame([(1, "take out the trash can"), (2, "please burn the letters"), (3, "you are a stupid idiot and they will kill you")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in T.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}
