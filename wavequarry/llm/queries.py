"""The numbered queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, licenses, merkle, mixing, packing, quality, simhash, substrings, tokencounts, toxicity, trie, urlfilter
from .common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of each document."""
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of each document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of each page.

    A page shows the document whose number is in its path, so its label is
    that document's: bad if of low quality or toxic.
    """
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(urlfilter.path_of(F.col("url")), r"/(\d{1,18})(?:/|\.html)?$", 1)
    shown = pages.withColumn("doc_id", F.when(number != "", number.cast("long")))
    return urlfilter.judge(shown.join(bad, "doc_id", "left"), RULES, bad_col="bad")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of each document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents as the first batch of a new index."""
    name = f"digest_index_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/{name}", name)
    found = exact_dedup.deduplicate(_table(spark, sf_dir, "documents"), index, "documents")
    index.forget(files=True)  # a run of its own; ``found`` reads the batch's own files
    return found


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    documents, pieces = mixing.mix(_table(spark, sf_dir, "documents"))
    taken = mixing.by_document(documents, pieces, F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    return taken.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "first_shard", "last_shard")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without sequences of 35 words that occur elsewhere."""
    found = substrings.repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT id, unnest(range(1, len(w) - 33)) AS i, w FROM d), g AS (SELECT id, i, array_to_string(w[i:i + 34], ' ') AS s FROM p), t AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT id, unnest(range(i, i + 35)) AS k FROM g SEMI JOIN t USING (s)), n AS (SELECT id, count(*) AS n_removed FROM c GROUP BY id),
k AS (SELECT a.id, string_agg(x, ' ' ORDER BY k) AS kept FROM (SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d) a ANTI JOIN c USING (id, k) GROUP BY a.id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (id) LEFT JOIN k USING (id)"""


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations that are begun anew with shared heads."""
    return trie.prefix_trie(*trie.shared_heads(trie.numbered_turns(_table(spark, sf_dir, "conversations"))))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and the root that a tampered half of them leads to.

    A row without doc_id is not tampered with.
    """
    docs = _table(spark, sf_dir, "documents")
    digest = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(touched, digest(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(digest(F.col("text")))
    rows = merkle.manifest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", digest(F.col("text")).alias("digest"), tampered.alias("tampered")))
    rows = merkle.folded(rows, "tampered", "folded")
    hexed = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        hexed("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: crc32 of each id's decimal text, digit by digit, from a table of the 256 remainders.
CRC = """remainders(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM remainders WHERE k < 8),
crc(id, s, v) AS (SELECT id, CAST(id AS VARCHAR), 4294967295 FROM ids UNION ALL SELECT id, s[2:], xor(crc.v // 256, t.v) FROM crc JOIN remainders t ON t.k = 8 AND t.i = xor(crc.v % 256, CAST(ascii(s) AS BIGINT)) WHERE s <> ''),
crc32(id, c) AS (SELECT id, xor(v, 4294967295) FROM crc WHERE s = '')"""


def _climb_sql(name: str, leaves: str) -> str:
    """SQL of all nodes of the trees over ``leaves`` (tree, idx, n, digest), level by level."""
    return f"""{name}(tree, level, idx, n, digest) AS (SELECT tree, 0, idx, n, digest FROM {leaves}
UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 3, n)"""


def _steps_sql(name: str, nodes: str, leaves: str, first: int) -> str:
    """SQL of what each of ``leaves`` (id, tree, idx) meets on its way up: siblings before and after it, by step."""
    return f"""{name} AS (SELECT l.id, {first} + l.level AS step, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < l.at), '') AS a, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > l.at), '') AS b
FROM (SELECT x.id, x.tree, t.level, x.idx // CAST(pow(3, t.level) AS BIGINT) AS at FROM {leaves} x JOIN {nodes} t ON t.tree = x.tree AND t.n > 1 AND t.idx = x.idx // CAST(pow(3, t.level) AS BIGINT)) l
LEFT JOIN {nodes} s ON s.tree = l.tree AND s.level = l.level AND s.idx // 3 = l.at // 3 AND s.idx <> l.at GROUP BY ALL)"""


_FIELDS = ", ".join("CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END".format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
OP13_SQL = f"""WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM documents), {CRC},
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('s' || source, '') AS tree, sha256(concat({_FIELDS})) AS digest, sha256(concat({_FIELDS.replace("ELSE octet_length(encode(CAST(text AS VARCHAR))) || ':' || text", "WHEN crc32.c % 2 = 0 THEN octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '') ELSE octet_length(encode(text)) || ':' || text")})) AS tampered FROM documents LEFT JOIN crc32 ON crc32.id = doc_id),
low AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d), {_climb_sql("t", "low")},
sub AS (SELECT tree AS id, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1), {_climb_sql("u", "sub")},
{_steps_sql("p", "t", "low", 0)}, {_steps_sql("q", "u", "sub", 1000)},
steps AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY step) AS step, a, b FROM (SELECT * FROM p UNION ALL SELECT low.id, q.step, q.a, q.b FROM q JOIN low ON low.tree = q.id)),
fold(id, step, h) AS (SELECT id, 0, tampered FROM low UNION ALL SELECT id, steps.step, sha256(a || h || b) FROM fold JOIN steps USING (id) WHERE steps.step = fold.step + 1),
up AS (SELECT id, arg_max(h, step) AS h FROM fold GROUP BY id), proof AS (SELECT id, sha256(string_agg(a || b, '' ORDER BY step)) AS h FROM steps GROUP BY id)
SELECT low.doc_id, low.digest AS leaf, sub.digest AS subroot, u.digest AS root, coalesce(proof.h, sha256('')) AS proof_sha256, up.h AS folded_root, up.h = u.digest AS verified
FROM low JOIN sub ON sub.id = low.tree JOIN u ON u.n = 1 JOIN up ON up.id = low.id LEFT JOIN proof ON proof.id = low.id"""


OP12_SQL = f"""WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL), {CRC},
o AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)[:32]) AS pos FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) WHERE conv_id IS NOT NULL),
v AS (SELECT id, c % 6 AS h FROM crc32), r AS (SELECT id AS c, pos, role, text FROM v JOIN o ON o.c = id - id % 100 AND pos <= h UNION ALL SELECT id, 10 + pos, role, text FROM v JOIN o ON o.c = id AND pos > h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, role, text FROM r), p AS (SELECT c, d, length(text) AS chars, string_agg(octet_length(encode(role)) || ':' || role || octet_length(encode(text)) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS k FROM d UNION ALL SELECT id, 0, 0, '' FROM v),
n AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own FROM p GROUP BY ALL), last AS (SELECT c, max(d) AS d FROM p GROUP BY c), e AS (SELECT d, k, string_agg(c, ',' ORDER BY c) AS ends FROM p SEMI JOIN last USING (c, d) GROUP BY ALL),
up AS (SELECT n.d, n.k, m.c AS parent_conv_id, m.k AS pk FROM n JOIN p ON p.c = n.c AND p.d = n.d - 1 JOIN n m ON m.d = p.d AND m.k = p.k), ch AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM up GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (d, k)), s AS (SELECT DISTINCT x.d, x.k, y.d AS yd, y.k AS yk FROM p x JOIN p y ON y.c = x.c AND y.d >= x.d),
t AS (SELECT s.d, s.k, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum(f.own) AS BIGINT) AS saved_tokens FROM s JOIN f ON f.d = s.yd AND f.k = s.yk GROUP BY ALL)
SELECT f.c AS conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM f JOIN t USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN e USING (d, k)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_licenses": op2_licenses,
        "op3_langid": op3_langid,
        "op4_urlfilter": op4_urlfilter,
        "op5_token_counts": op5_token_counts,
        "op6_simhash": op6_simhash,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_packing": op8_packing,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
        "op11_substrings": op11_substrings,
        "op12_trie": op12_trie,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op11_substrings": OP11_SQL, "op12_trie": OP12_SQL, "op13_merkle": OP13_SQL}
