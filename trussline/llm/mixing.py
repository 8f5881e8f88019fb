"""Mixing sources to target weights with a low-discrepancy schedule (native expressions only).

Every source's documents, in hashed order, form one cyclic stream of words, cut into blocks of equal length.
Slot i of the schedule takes the point frac((i + 1/2) / golden ratio), which the cumulative target shares map to a
source; the k-th slot of a source takes block k of its stream. Ranks and stream offsets are two-level prefix sums
(cells, then rows of a cell), so no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: The golden-ratio step, and the same step for jumps of 2^20, so that products stay exact for 2^40 slots.
STEP = 0.6180339887498949
BIG = 1 << 20
BIG_STEP = (0.6180339887498948482045868343656 * BIG) % 1
#: Points of a grid that deals the unit interval out, so that slots find their source by an equality join.
GRID = 4096
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets of (key, source_size): key order gives the repeating weights; all sizes are shared by weight, no target
    above MAX_REPEATS times its source, the excess reshared by weight among the rest. One row a source."""
    everything = Window.partitionBy()
    by_key = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.partitionBy().orderBy("key")) - 1) % len(weights) + 1).cast("double"))
    cap = MAX_REPEATS * F.col("source_size")
    before = Window.partitionBy().orderBy(cap / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    # With the i lowest caps met, the rest share (S - caps) / (W - their weights); that level rises until no cap binds.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (
        by_key.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("key", "source_size", F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def _golden(i: Column) -> Column:
    x = (F.floor(i / BIG) * F.lit(BIG_STEP)) % 1 + ((i % BIG + 0.5) * F.lit(STEP)) % 1
    return x % 1


def slot_ranks(spark: SparkSession, targets: DataFrame, slots: int, chunk: int = 8192) -> DataFrame:
    """(slot, key, rank): the source of every slot and the slot's number, from 0, within its source."""
    upto = Window.partitionBy().orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("target").over(Window.partitionBy())
    shares = (
        targets.where(F.col("target") > 0)
        .select("key", ((F.sum("target").over(upto) - F.col("target")) / whole).alias("lo"), (F.sum("target").over(upto) / whole).alias("hi"))
        .withColumn("hi", F.when(F.col("hi") == F.max("hi").over(Window.partitionBy()), F.lit(2.0)).otherwise(F.col("hi")))
        .withColumn("lo", F.when(F.lag("hi").over(Window.partitionBy().orderBy("key")).isNull(), F.lit(0.0)).otherwise(F.lag("hi").over(Window.partitionBy().orderBy("key"))))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID).cast("int"), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)).cast("int"))))
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), _golden(F.col("id")).alias("x")).withColumn("cell", F.least(F.floor(F.col("x") * GRID), F.lit(GRID - 1)).cast("int"))
    dealt = points.join(shares, "cell").where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("slot", "key", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = dealt.groupBy("chunk", "key").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("chunk", "key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("chunk", "key").orderBy("slot")) - 1
    return dealt.withColumn("inside", inside).join(counts, ["chunk", "key"]).select("slot", "key", (F.col("before") + F.col("inside")).alias("rank"))


def stream_offsets(sized: DataFrame, cells: int) -> DataFrame:
    """Adds `start`, where each document begins in its source's stream: hashed order, ties by id and size."""
    placed = sized.withColumn("h", F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 31))).withColumn("cell", F.floor(F.col("h") * cells / (1 << 31)))
    sums = placed.groupBy("key", "cell").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("key", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return placed.withColumn("inside", inside).join(sums, ["key", "cell"]).withColumn("start", F.col("before") + F.col("inside")).drop("h", "cell", "inside", "before")


def mixed(docs: DataFrame, block_words: int = 64, docs_per_cell: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes, targets, placed, pieces). placed: documents with words and their start; pieces: slot, key, start, doc_id, words: which
    words of which document each slot of the mix takes. Repeated rows are documents of their own; null ids and null
    sources are allowed (null is a source, the last); documents without words are in no stream; extra columns are ignored."""
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("1"), "source"), F.lit("2")).alias("key"), word_count(F.col("text")).alias("size")))
    targets = cut(source_targets(sized.groupBy("key").agg(F.sum("size").alias("source_size"))))
    n = sized.count()
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    placed = cut(stream_offsets(sized.where("size > 0"), max(1, -(-n // docs_per_cell))))
    ranks = slot_ranks(spark, targets, -(-total // block_words))
    # Slots past a source's last allowed repeat take nothing; its last block ends there.
    limit = MAX_REPEATS * F.col("source_size")
    blocks = ranks.join(targets, "key").where(F.col("rank") * block_words < limit).select("slot", "key", "rank", F.least((F.col("rank") + 1) * block_words, limit).alias("until"))
    passes = (
        placed.join(targets, "key")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
        .withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))))
        .select("key", "rank", "doc_id", "start", "size", "at")
    )
    words = F.least(F.col("at") + F.col("size"), F.col("until")) - F.greatest(F.col("at"), F.col("rank") * block_words)
    pieces = passes.join(blocks, ["key", "rank"]).withColumn("words", words).where("words > 0").select("slot", "key", "start", "doc_id", "size", "words")
    return sized, targets, placed, pieces


def mix_sources(docs: DataFrame, block_words: int = 64) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of every document the mix takes, repeats
    counted. One row for each row of `docs`; an empty table gives none. Reruns agree: nothing depends on the partitioning."""
    sized, targets, placed, pieces = mixed(docs, block_words)
    taken = (
        placed.select("key", "start", "doc_id", "size", F.lit(0).cast("long").alias("words"))
        .unionByName(pieces.drop("slot"))
        .groupBy("key", "start", "doc_id", "size")
        .agg(F.sum("words").alias("taken"))
        .select("key", "doc_id", "size", "taken")
        .unionByName(sized.where("size = 0").select("key", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    )
    source = F.when(F.col("key") != "2", F.substring("key", 2, 1 << 30))
    return taken.join(targets, "key").select("doc_id", source.alias("source"), "size", "source_size", "target", "taken")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and the mix's columns of every row of `documents`; nulls, empty and long
    texts, repeated rows and an empty table as in `mix_sources`."""
    return mix_sources(table(spark, sf_dir, "documents"))
