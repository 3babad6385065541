"""Mixing sources to target weights, in fixed-length blocks.

Each source's words form one stream, packed into blocks of ``block_words``.
The mix is a list of slots, one block each. A source gets as many slots as its
target asks for. All slots together are dealt to output shards of
``shard_blocks`` places by a pseudorandom permutation, so the counts of the
sources in a shard are a multinomial draw under the condition that the shard is
full and the totals are the targets (a multivariate hypergeometric one; without
the condition small sources would miss their targets and documents pass the
limit of two uses), and a shard comes out mixed: ``place`` is its order. Slot k
of a source takes block ``perm(k mod blocks)``, where perm is a pseudorandom
permutation of the source's block indices; slots and blocks are joined by
(source, block).

Everything is DataFrame functions. Stream positions come from sums over
(source, chunk) groups, so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: Documents of a source are dealt to so many chunks for the prefix sums.
CHUNKS = 1024
#: Slots are listed in runs of this many, so that no array holds a source's slots.
RUN = 4096
#: Runs that one task lists, until there are as many tasks as MOST_TASKS.
TASK_RUNS, MOST_TASKS = 64, 20_000
#: Rounds of a permutation beyond one for each bit of what it permutes: of n elements n / 2^(bits + MORE_ROUNDS), so hardly one, are moved by none.
MORE_ROUNDS = 4


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    The sources by code point, null last, get the weights in turn; together
    they get ``share`` times all words. A target stops at ``most`` times its
    source's words and the excess goes to the others by weight. That is
    target = min(most * size, level * weight) for one level, found from prefix
    sums over the sources in the order in which they stop. No sources give no
    rows; sources without words get 0.
    """
    name = F.col("source").cast("binary")
    everything = Window.partitionBy()
    nth = F.row_number().over(Window.orderBy(name.asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("weight"))
    before = Window.orderBy("stop", name.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # Levels fall from the first source on that does not stop, which has the right one.
    level = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(everything)
    level = F.coalesce(level, F.max("stop").over(everything))
    return rows.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def stream_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, start, chunk, nth: each document's place in its source's stream of words.

    The order is by chunk (a hash of the row), then id; (source, chunk, nth)
    names the row. Null texts have size 0, null sources are a source of their own.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = cut(sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(CHUNKS)).cast("int")), "sizes")
    chunks = sized.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("source", "chunk", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("chunk_start"))
    within = Window.partitionBy("source", "chunk").orderBy("doc_id", "text_hash")
    placed = sized.withColumn("nth", F.row_number().over(within)).withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    same = placed["source"].eqNullSafe(chunks["source"]) & (placed["chunk"] == chunks["chunk"])
    return placed.join(chunks, same).select(
        "doc_id", placed["source"], "size", (F.col("chunk_start") + F.col("upto") - F.col("size")).alias("start"), placed["chunk"], "nth", "text_hash"
    )


def _permuted(index: Column, size: Column, name: Column, seed: int) -> Column:
    """Pseudorandom bijection of 0..size-1, one per name.

    Swap-or-not rounds: x and key - x are partners, and a hash of the larger
    decides for both whether they change places. The rounds grow with the
    logarithm of ``size``, so that hardly an element stays where it was.
    """
    bits = F.ceil(F.log2(F.greatest(size, F.lit(2)).cast("double"))).cast("int")

    def swap_or_not(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(name, F.lit(seed), r), size) - x, size)
        return F.when(F.xxhash64(name, F.lit(seed), r, F.greatest(x, partner)) % 2 == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), bits + MORE_ROUNDS), index, swap_or_not)


def mix_slots(targets: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """source, slot, pass_no, block, words, shard, place: one row per block that the mix takes.

    Whole passes over a source take each of its blocks once, the short one at
    the stream's end last; what is left of the target comes from the start of
    one more pass, whose last slot takes only the first ``words`` words of its
    block. So the words taken are the target, rounded.
    """
    want, size = F.round("target").cast("long"), F.col("source_size")
    sized = targets.where("source_size > 0").select("source", F.ceil(size / block_words).cast("long").alias("n_blocks"), F.floor(size / block_words).alias("n_full"), (want - want % size).alias("whole"), (want % size).alias("rest"), size.alias("source_size"))
    whole_slots = F.col("whole") / F.col("source_size") * F.col("n_blocks")
    sized = sized.withColumn("n_slots", F.round(whole_slots).cast("long") + F.ceil(F.col("rest") / block_words).cast("long")).where("n_slots > 0")
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(before), F.lit(0)))  # one row per source
    all_slots = sized.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    # A run is a few bytes and makes RUN rows, so the number of tasks is set by count; left to itself Spark sets it by bytes.
    tasks = min(MOST_TASKS, all_slots // (TASK_RUNS * RUN) + 1)
    runs = sized.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / RUN).cast("long")))).repartition(tasks, "source", "run")
    listed = runs.withColumn("slot", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("n_slots")) - 1)))
    last = (F.col("slot") == F.col("n_slots") - 1) & (F.col("rest") % block_words > 0)
    listed = listed.withColumn("words", F.when(last, F.col("rest") % block_words).otherwise(F.lit(block_words)).cast("int"))
    listed = listed.withColumn("pass_no", F.floor(F.col("slot") / F.col("n_blocks")).cast("int")).withColumn("block", F.col("slot") % F.col("n_blocks"))
    shuffled = _permuted(F.col("block"), F.greatest("n_full", F.lit(1).cast("long")), F.col("source"), seed)
    listed = listed.withColumn("block", F.when(F.col("block") < F.col("n_full"), shuffled).otherwise(F.col("block")))
    dealt = _permuted(F.col("first_slot") + F.col("slot"), F.lit(all_slots).cast("long"), F.lit("deal"), seed)
    listed = listed.withColumn("dealt", dealt)
    return listed.select("source", "slot", "pass_no", "block", "words", F.floor(F.col("dealt") / shard_blocks).alias("shard"), (F.col("dealt") % shard_blocks).cast("int").alias("place"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 64,
    shard_blocks: int = 4096,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: doc_id, source, size, source_size, target, chunk, nth, start, text_hash; one row per row of ``docs``.
    pieces: source, chunk, nth, shard, place, slot, pass_no, from_word, to_word (its end, excluded); one row per
    slot and document of which the slot's block holds words.

    Null or empty texts have no pieces, a null source is a source of its own,
    repeated rows are rows like any other, a text of any length is cut into
    blocks as a whole, other columns of ``docs`` are not read, and an empty
    table gives empty results. The outcome depends on the rows and the seed
    alone. There is one row per source in the tables of targets, which windows
    order in one task.
    """
    placed = cut(stream_positions(docs, id_col, text_col, source_col), "streams")
    targets = cut(source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    t = targets.withColumnRenamed("source", "t_source")
    documents = placed.join(t, placed["source"].eqNullSafe(t["t_source"])).drop("t_source")

    end = F.col("start") + F.col("size")
    cells = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    first = F.greatest(F.col("start"), F.col("block") * block_words)
    cells = cells.select(
        "source", "chunk", "nth", "block",
        (first - F.col("block") * block_words).cast("int").alias("at"),
        (first - F.col("start")).alias("from_word"),
        (F.least(end, (F.col("block") + 1) * block_words) - first).cast("int").alias("n"),
    )
    s = mix_slots(targets, block_words, shard_blocks, seed).withColumnsRenamed({"source": "s_source", "block": "s_block"})
    # Spark takes exploded rows for as few as they came from; a hint keeps it from broadcasting them.
    joined = cells.hint("merge").join(s.hint("merge"), cells["source"].eqNullSafe(s["s_source"]) & (cells["block"] == s["s_block"]) & (cells["at"] < s["words"]))
    to_word = F.col("from_word") + F.least(F.col("n"), F.col("words") - F.col("at"))
    return documents, joined.select("source", "chunk", "nth", "shard", "place", "slot", "pass_no", "from_word", to_word.alias("to_word"))


def by_document(documents: DataFrame, pieces: DataFrame, *values: Column) -> DataFrame:
    """``documents`` with the aggregates ``values`` over each one's pieces (null where it has none)."""
    p = pieces.groupBy("source", "chunk", "nth").agg(*values).withColumnsRenamed({"source": "p_source", "chunk": "p_chunk", "nth": "p_nth"})
    same = documents["source"].eqNullSafe(p["p_source"]) & (documents["chunk"] == p["p_chunk"]) & (documents["nth"] == p["p_nth"])
    return documents.join(p.hint("merge"), same, "left").drop("p_source", "p_chunk", "p_nth")
