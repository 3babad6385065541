"""The text operators against plain versions, on rows with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavequarry.llm import exact_dedup, langid, licenses, mixing, packing, quality, simhash, tokencounts, toxicity, urlfilter
from wavequarry.llm.common import bounded_sample, held_out, join_keys, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, rank int, token int, digest string"
rng = np.random.default_rng(11)
VOCAB = ["alpha", "beta", "Gamma", "été", "straße", "don't", "x1", "naïve", "日本", "end.", "--", "ok"]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCAB, n))


LONG = prose(9000)
COPY = prose(120)
ROWS = [
    (1, COPY, "en", "a", 1), (2, COPY, "en", "a", 1), (2, COPY, "en", "a", 1), (3, COPY + " tail", "en", None, 1), (4, None, None, None, None), (5, "", "en", "b", 0),
    (6, " \n\t ", "en", "b", 3), (7, LONG, "de", "b", 1), (8, "one", "de", "c", 1), (9, "one two", None, "c", 1), (None, "no id", "en", "c", 1), (None, None, None, "c", 1),
    (10, "İstanbul ǅ ² ½ \u00a0 \u3000 été É <|endoftext|> <|startoftext|> it's they'LL", "fr", "c", 1), (11, "a\nb\na\n\n\nb " + "w " * 40, "fr", "", 1),
    *[(20 + k, prose(int(rng.integers(1, 80))), "en" if k % 2 else "de", "abc"[k % 3], 1) for k in range(40)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 0.5, 1, 2, "y") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0, 1) for k in range(20, 60)] + [(1, None, None, 1), (None, 1, 1, 1), (999, 0, 1, 1), (20, 1, 0, 1)], "doc_id long, quality int, toxic int, score int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def words(text):
    return WORD.findall(text or "")


def test_quality_counts_and_edges(docs, empty, labels, no_labels):
    got = quality.judge(docs, labels).toPandas()
    assert len(got) == len(ROWS)
    want = Counter()
    for doc_id, text, *_ in ROWS:
        w = words(text)
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        seen, dups = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want[(doc_id, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(covered), base)] += 1
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, bool(r.base_failed)) for r in got.itertuples())
    assert have == want
    assert not (got.base_failed & got.kept).any()
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(docs, no_labels).where("kept = base_failed").count() == 0


def test_forest_isolates_what_is_unlike():
    rows = rng.normal(size=(2000, 3))
    forest = quality.IsolationForest(50, 128).fit(rows, np.full(3, -10.0), np.full(3, 10.0))
    scores = forest.score(np.array([[0, 0, 0], [0.5, -0.5, 0.2], [8, 8, 8], [0, 0, 9.5]]))
    assert scores[:2].max() < scores[2:].min()


def test_language_on_held_out_rows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right >= 0.95 * n > 0


def test_language_edges(docs, empty):
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(docs).collect()}
    assert len(langid.identify(docs).collect()) == len(ROWS)
    for k in (4, 5, 6):
        assert got[k, "und"].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in got.values()} <= {"und", "en", "de", "fr"}
    assert langid.identify(empty).count() == 0
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0


def test_sparse_product_and_blocks_of_languages(docs, monkeypatch):
    texts = [COPY, None, "", "123", LONG, "ß", "one two"]
    matrix = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    monkeypatch.setattr(langid, "STRETCH", 50)
    got = langid.multiply(*langid.sparse_counts(texts), matrix)
    for row, text in zip(got, texts):
        want = np.zeros(3)
        if langid.has_letter(text):
            for order in langid.ORDERS:
                want += matrix[langid.buckets(langid.code_points(text), order)].sum(0, dtype=np.float64)
        assert np.allclose(row, want, rtol=1e-4, atol=1e-3)
    many = docs.withColumn("lang", F.concat("lang", F.lit("-"), F.col("source")))
    whole = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(many).collect()}
    monkeypatch.setattr(langid, "BLOCK", 2)
    parts = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(many).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-6 for k in whole)


def test_language_ignores_lang_source_and_id(docs):
    a = langid.identify(docs).select("doc_id", "lang_pred", "score")
    changed = docs.withColumn("lang", F.when(~held_out(F.col("doc_id"), 4, 2), F.col("lang")).otherwise("zz")).withColumn("source", F.lit("s"))
    assert a.exceptAll(langid.identify(changed).select("doc_id", "lang_pred", "score")).count() == 0


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
URLS = [
    "http://A.Example.COM/en/7?x", "https://example.com/en/1#y", "http://x.example.net/de/8/1", "http://net/de/", "http://fnet/de/", "ftp://a.org/es/", "no scheme", "", None, "http://", "http://h?q=/en/", "x://a.com/en/?u=b://c.net/de/",
    "http://a.com", "http://example.com/en/7", "http://example.com/en/7", "http://o.org/a/b/c/d/e/f", "http://o.org//a//b",
]


def plain_rule(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for r, v in RULES for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "html", "z") for k, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urlfilter.judge(pages, RULES).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host, path, rule, verdict = plain_rule(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == (verdict or "allow")
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0
    assert urlfilter.judge(pages, []).where("rule is not null").count() == 0


def test_bad_templates_are_rejected_and_like_ones_merged(spark):
    rows = [(f"http://h.org/spam/{k}", True) for k in range(200)] + [(f"http://h.org/{s}/{k}", k % 20 == 0) for s in ("news", "blog") for k in range(200)] + [("http://h.org/spam/new", None)]
    pages = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    got = urlfilter.judge(pages, [], bad_col="bad").toPandas().set_index("page_id").sort_index()
    assert (got.verdict[:200] == "block").all() and got.verdict[600] == "block" and (got.verdict[200:600] == "allow").all()
    assert got.template[200] == got.template[500] and got.template[0].startswith("/spam/")


def test_token_counts(docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.token_counts(docs).collect())
    want = Counter()
    for doc_id, text, *_ in ROWS:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want[doc_id, len((text or "").encode()), n, n > 2048] += 1
    assert got == want
    assert tokencounts.token_counts(empty).count() == 0


@pytest.mark.parametrize("frequent", [0, 3])
def test_token_counts_with_few_frequent_ones(docs, frequent):
    assert Counter(tokencounts.token_counts(docs, frequent=frequent).collect()) == Counter(tokencounts.token_counts(docs).collect())


def test_token_counts_of_another_tokenizer(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_tokens) for r in tokencounts.token_counts(docs, "byte_bpe_50k").collect())
    assert got == Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)


def plain_print(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_print(r[1]) for r in ROWS]
    root = components_of(len(ROWS), [(a, b) for a in range(len(ROWS)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    least = {}
    for k, r in zip(root, ROWS):
        least[k] = min(filter(lambda x: x is not None, (least.get(k), r[0])), default=None)
    want = Counter((r[0], f"{p:016x}", least[k]) for r, p, k in zip(ROWS, prints, root))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_links_connect_what_all_pairs_connect(spark, cell_rows):
    centres = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for c in centres for _ in range(25)]
    prints = np.unique(np.array(near, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    got = {(r.node): r.root for r in simhash.components(simhash.links(df, cell_rows)).collect()}
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    root = components_of(len(prints), [(a, b) for a, b in np.argwhere(apart) if a < b])
    ours = [got.get(int(x), int(x)) for x in prints.view(np.int64)]
    assert len(set(zip(root, ours))) == len(set(root)) == len(set(ours))


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert simhash.components(edges).where("root != 0").count() == 0


def test_exact_duplicates_and_the_index(spark, docs, empty):
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/ix", "ix_test", 4)
    first = exact_dedup.deduplicate(docs, index, "one").collect()
    by_text = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        by_text[text or ""].append(doc_id)
    assert len(first) == len(ROWS) and sum(r.kept for r in first) == len(by_text)
    size = {exact: (max((i for i in ids if i is not None), default=None), len(ids)) for exact, ids in by_text.items()}
    import hashlib

    named = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in size.items()}
    assert all((r.keep_id, r.group_size) == named[r.text_sha256] for r in first)
    assert all(r.doc_id == r.keep_id for r in first if r.kept)
    again = exact_dedup.deduplicate(docs, index, "one").collect()
    assert Counter(again) == Counter(first)
    more = spark.createDataFrame([(100, COPY), (101, "new"), (102, "new")], "doc_id long, text string")
    second = {r.doc_id: r for r in exact_dedup.deduplicate(more, index, "two").collect()}
    assert (second[100].kept, second[100].keep_id) == (False, 2)
    assert (second[101].kept, second[102].kept) == (False, True)
    assert exact_dedup.deduplicate(empty, index, "three").count() == 0
    assert index.read().groupBy("digest").count().where("count > 1").count() == 0


def test_an_index_is_compacted_read_in_order_and_found_again(spark, docs):
    path = f"{shared_dir(spark)}/ix2"
    index = exact_dedup.DigestIndex(spark, path, "ix_one", 2)
    for k in range(3):
        exact_dedup.deduplicate(spark.range(20 * k, 20 * k + 30).selectExpr("id AS doc_id", "concat('text ', id) AS text"), index, f"b{k}").collect()
    whole = sorted(r.keep_id for r in index.read().collect())
    assert whole == list(range(70)) and index.files_per_bucket() > 1
    index.compact()
    assert index.files_per_bucket() == 1 and sorted(r.keep_id for r in index.read().collect()) == whole
    anti = index.read().select("digest").hint("merge").join(index.read().select("digest"), "digest", "left_anti")
    plan = anti._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan
    index.forget()  # as a session that starts anew
    again = exact_dedup.DigestIndex(spark, path, "ix_two", 2)
    late = exact_dedup.deduplicate(spark.createDataFrame([(500, "text 3"), (501, "fresh")], "doc_id long, text string"), again, "late").collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in late} == {(500, 3, False), (501, 501, True)}
    again.forget(files=True)
    assert again._complete() == []


def test_hot_keys_are_joined_where_they_are(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_keys(rows, table, "k", "n", 5000)
    assert got.count() == 5000 and got.where("k = -1 and n != 1667").count() == 0


def test_packing(docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).toPandas()
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, crc32(ids[a:b].tobytes())] += 1
    assert have == want
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.length.sum() <= 1024 and (rows.length.cumsum() - rows.length == rows.offset).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 2
    assert packing.pack(empty).count() == 0


def test_plan_packs_everything_and_is_tight():
    for seed in range(20):
        r = np.random.default_rng(seed)
        lengths = np.concatenate([r.integers(1, 65, r.integers(0, 300)), r.integers(20, 65, r.integers(0, 200))])
        counts = Counter(map(int, lengths))
        plan = packing.plan_packing(counts, 64)
        packed = Counter()
        for made, n in plan:
            assert sum(made) <= 64 and n > 0 and sum(x > 64 / 3 for x in made) <= 2
            for x in made:
                packed[x] += n
        assert packed == counts
        # Compared with best fit over single pieces, longest first.
        gaps: list[int] = []
        for x in sorted(map(int, lengths), reverse=True):
            k = min((g for g in gaps if g >= x), default=None)
            if k is None:
                gaps.append(64 - x)
            else:
                gaps[gaps.index(k)] = k - x
        assert sum(n for _, n in plan) <= len(gaps) + max(1, len(gaps) // 100)


def test_toxicity(docs, empty, labels, no_labels, spark, sf_dir):
    for given in (labels, no_labels):
        got = toxicity.score(docs, given).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.score(empty, labels).count() == 0
    d, y = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = toxicity.score(d, y).join(y, "doc_id").where("toxic = 0")
    assert clean.where("predicted = 1").count() <= 0.03 * clean.count()
    changed = y.withColumn("toxic", F.when(held_out(F.col("doc_id"), 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.score(d, y).exceptAll(toxicity.score(d, changed)).count() == 0  # held-out labels are not read


def test_mixing(docs, empty):
    documents, pieces = mixing.mix(docs, block_words=8)
    taken = mixing.by_document(documents, pieces, F.sum(F.col("to_word") - F.col("from_word")).alias("taken")).fillna(0, ["taken"]).toPandas()
    assert len(taken) == len(ROWS)
    assert Counter(taken["size"]) == Counter(len(words(r[1])) for r in ROWS)
    assert (taken.taken <= 2 * taken["size"]).all()
    by = taken.groupby(taken.source.fillna("\uffff")).agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.own).all() and ((by.taken - by.target).abs() <= 0.5).all()
    weight = dict(zip(sorted(by.index), [5, 2, 1] * 9))
    total, target, open_ = 1.5 * by.own.sum(), {}, set(by.index)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * by.own[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * by.own[s] for s in over}
        open_ -= over
    assert all(abs(target[s] - by.target[s]) < 1e-6 for s in by.index)
    again = mixing.mix(docs.repartition(5), block_words=8)[1]
    assert again.exceptAll(pieces).count() == 0 == pieces.exceptAll(again).count()
    assert all(df.count() == 0 for df in mixing.mix(empty))


def test_shards_are_full_and_drawn(spark):
    sizes = {"a": 60_000, "b": 30_000, "c": 10_000}
    targets = spark.createDataFrame([(s, n, float(n)) for s, n in sizes.items()], "source string, source_size long, target double")
    slots = mixing.mix_slots(targets, 10, 500, 3).toPandas()
    n = len(slots)
    assert n == 10_000 and (slots.groupby("shard").size() == 500).all() and slots.shard.nunique() == 20
    assert (slots.groupby("shard").place.nunique() == 500).all()
    counts = slots.groupby(["shard", "source"]).size().unstack(fill_value=0)
    for s, size in sizes.items():
        share = size / 100_000
        variance = 500 * share * (1 - share) * (n - 500) / (n - 1)  # of a hypergeometric count
        assert counts[s].sum() == size // 10 and 0.3 < counts[s].var() / variance < 2.5
        assert (abs(counts[s] - 500 * share) < 5 * variance**0.5).all()


@pytest.mark.parametrize("n", [1, 2, 3, 50, 4097, 300_000])
def test_a_permutation_is_one_and_leaves_hardly_an_element_alone(spark, n):
    size = F.lit(n).cast("long")
    rows = spark.range(n).select("id", mixing._permuted(F.col("id"), size, F.lit("deal"), 7).alias("to"))
    r = rows.agg(F.count_distinct("to").alias("all"), F.min("to").alias("low"), F.max("to").alias("high"), F.count_if(F.col("id") == F.col("to")).alias("fixed"), F.corr("id", "to").alias("corr")).first()
    assert (r["all"], r.low, r.high) == (n, 0, n - 1)
    if n > 1000:
        assert r.fixed < 8 and abs(r["corr"]) < 0.06  # one is left alone by a uniform one


def test_blocks_are_taken_evenly(spark):
    df = spark.createDataFrame([(k, " ".join(["w"] * 7), "s") for k in range(60)], "doc_id long, text string, source string")
    documents, pieces = mixing.mix(df, block_words=16, share=1.5)
    per_pass = pieces.groupBy("pass_no").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).orderBy("pass_no").collect()
    assert [r.n for r in per_pass] == [420, 210]


def test_licenses(spark, empty):
    rows = {
        1: ("Text\nReleased under the MIT License.", "MIT"), 2: ("Licensed under the Apache License, Version 2.0.\nmore", "Apache-2.0"), 3: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        4: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), 5: ("no such thing here", None), 6: (None, None), 7: ("", None), 8: ("you need a license to drive a car", "unknown"), 9: ("All rights reserved.", "Proprietary"),
    }
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in rows.items()] + [(1, rows[1][0], "x"), (None, None, "x")], "doc_id long, text string, family string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows) + 2
    assert {(r.doc_id, r.license) for r in got if r.doc_id} == {(k, v) for k, (_, v) in rows.items()}
    assert licenses.scan(empty).count() == 0


def test_bounded_sample(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    a, b = (sorted(r.k for r in bounded_sample(df.repartition(n), "k", 100).collect()) for n in (2, 7))
    assert a == b and 50 < len(a) <= 100 and bounded_sample(df, "k", 5000).count() == 1000
