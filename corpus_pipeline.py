"""Documents to training sequences: five stages, each by one operator of ``wavequarry.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; ``run`` writes every stage's rows in the shared folder and
reads them again, so a lost executor costs no finished stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavequarry.llm import exact_dedup, mixing, nearcopies, packing, toxicity
from wavequarry.llm.common import cut, remove, shared_dir
from wavequarry.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Probability from which a document is rejected as toxic.
TOXIC = 0.7
#: A word and the white space after it; what comes before the first word belongs to no piece.
WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability is below TOXIC.

    Null and empty texts stay; repeated rows are judged alike, whole texts are
    read, an empty table stays empty.
    """
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("_toxic", model.probability(F.col("text"), spark)).where(F.col("_toxic") < TOXIC).select(COLUMNS)


def _picked(docs: DataFrame, keys: DataFrame, text_key: Callable) -> DataFrame:
    """One row of ``docs`` for each row (k_id, k_text) of ``keys``, matched by id and ``text_key`` of the text; nulls match."""
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    found = keyed.join(keys, keyed["doc_id"].eqNullSafe(keys["k_id"]) & (keyed["_key"] == keys["k_text"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("doc_id"))
    return found.withColumn("_nth", nth).where("_nth = 1").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id, by a new digest index.

    Null texts equal empty ones, null ids lose to others, of rows that repeat
    id and text one stays, an empty table stays empty.
    """
    docs = docs.select(COLUMNS)
    name = f"pipeline_digests_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/{name}", name)
    kept = exact_dedup.deduplicate(docs, index, "documents").where("kept").select(F.col("doc_id").alias("k_id"), F.unhex("text_sha256").alias("k_text"))
    index.forget(files=True)
    return _picked(docs, kept, exact_dedup.text_digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are 0.8 alike the document with the smallest id.

    Texts meet by SimHash and pivot tables, and by MinHash cells for what those
    do not reach; the shingle sets decide. Null and empty texts are one group. Of rows that share an id one stays;
    rows without id stay if their group has none. Texts of under five words are
    one shingle; long ones count as a whole; an empty table stays empty.
    """
    docs = docs.select(COLUMNS)
    groups = nearcopies.near_copies(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("text_hash").alias("k_text"))
    return _picked(docs, cut(first.withColumnRenamed("component_id", "k_id"), "representatives"), F.xxhash64)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: for each pass over a document's source, a row with the words taken in it.

    A document taken whole keeps its text as it is; one taken in part has the
    taken words with the white space after each. n_chars is that of the text.
    Documents of which nothing is taken, and null and empty texts, have no row.
    An empty table stays empty.
    """
    docs = docs.select(COLUMNS)
    documents, pieces = mixing.mix(docs)
    taken = mixing.by_document(documents, pieces, F.array_sort(F.collect_list(F.struct("pass_no", "from_word", "to_word"))).alias("taken"))
    taken = cut(taken.where("taken is not null").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_text"), "size", "taken"), "taken")
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("doc_id"))
    # Rows that repeat id and text are one row here and as many rows of ``taken``.
    one = keyed.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    rows = one.join(taken, one["doc_id"].eqNullSafe(taken["k_id"]) & (one["_key"] == taken["k_text"]))
    words = lambda ranges: F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["to_word"] - r["from_word"])
    passes = F.array_distinct(F.transform("taken", lambda r: r["pass_no"]))
    rows = rows.withColumn("_parts", F.transform(passes, lambda p: F.filter("taken", lambda r: r["pass_no"] == p)))
    partial = F.exists("_parts", lambda ranges: words(ranges) < F.col("size"))
    rows = rows.withColumn("_words", F.when(partial, F.regexp_extract_all("text", F.lit(WORD_AND_SPACE), F.lit(0))))
    rows = rows.withColumn("_ranges", F.explode("_parts")).withColumn("_whole", words(F.col("_ranges")) == F.col("size"))
    cut_out = F.array_join(F.transform("_ranges", lambda r: F.array_join(F.slice("_words", (r["from_word"] + 1).cast("int"), (r["to_word"] - r["from_word"]).cast("int")), "")), "")
    text = F.when(F.col("_whole"), F.col("text")).otherwise(cut_out)
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each piece of each document in sequences of at most 1024 tokens.

    Null and empty texts are their end token; rows that share an id are packed
    one by one; an empty table gives no rows.
    """
    return packing.pack(docs.select(COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicate removal", drop_near_copies),
    ("source mixing", mix_sources),
    ("sequence packing", pack_sequences),
]

#: The stages have no SQL form; the tests hold each against a plain one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    docs, before = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        found = stage(spark, docs, sf_dir)
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            remove(spark, before)  # the rows of the next stage are written
        before = path
    return docs
