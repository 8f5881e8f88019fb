"""Near copies by SimHash of five-word shingles with anchor-point covering, checked exactly by Jaccard similarity.

Texts whose fingerprints meet at an anchor and differ in few bits are candidates, and a candidate counts if its sets reach
the similarity. Fingerprints miss pairs near the threshold, so what they leave apart is completed exactly:

Two sets that reach the similarity share k of the first n - ceil(0.8 n) + k shingles of either, in any order that holds
for all texts (prefix filter, with k = TOGETHER or all that a short text can share). Shingles that a sample shows to be common come last in that order, so they lead to
pairs only where nearly the whole text is common. The sample changes the cost, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, written
from .graph import components
from .simhash import fingerprint, linked, shingle_hashes

#: Similarity as a fraction, so that whole numbers decide.
SHINGLE, OVER, UNDER = 5, 4, 5
#: Differing bits of the fingerprints of candidates.
DIFFERING = 3
#: The sample that tells common shingles: one text in SAMPLED, but LEAST texts; COMMON of it at most are put last.
SAMPLED, LEAST, COMMON, OFTEN = 32, 5000, 50_000, 4
#: Leading shingles that a pair has in common.
TOGETHER = 8
#: Bits of the map that says which texts are in a pair; where it is full, more sets than needed are kept.
MAP_BITS = 1 << 24
#: Members of a shingle that meet all others of it in one task.
BLOCK = 4096
#: Members from which on a shingle is frequent; a text lists its frequent leading shingles, if they are LISTED at most.
FREQUENT, LISTED = 32, 256
#: Shingles of a block of sets that are compared in one task, and pairs of two blocks from which on they are.
SPAN, SHARED = 1 << 17, 16


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text or "", SHINGLE))


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for a set of shingles."""
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def prefix(s: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The shingles of the set `s` that lead to its pairs; common (in order) ones last, by their place."""
    n = len(s)
    least = -(-OVER * n // UNDER)
    take = n - least + min(TOGETHER, least)
    if not len(common):
        return s[:take]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    known = common[at] == s
    return np.r_[s[~known], s[known][np.argsort(place[at[known]])]][:take]


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """(start, texts) of 256 at a time, so that what a worker holds is bounded."""
    for a in range(0, len(texts), 256):
        yield a, texts.slice(a, 256).to_pylist()


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order and their place from the least to the most common."""
    span = 1 << 20
    share = max(1 / SAMPLED, min(1.0, LEAST / max(1, texts.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _pieces(b.column(0)):
                yield pa.record_batch([pa.array(np.concatenate([shingles(t) for t in part]).view(np.int64))], names=["h"])

    sample = texts.where(F.pmod(F.xxhash64("th", F.lit(3)), F.lit(span)) < int(share * span)).select("text").mapInArrow(run, "h long")
    rows = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], -order


def _heads(texts: DataFrame) -> DataFrame:
    """doc_id, th, key, fp (the fingerprint of the set of shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, part in _pieces(b.column(2)):
                sets = [shingles(t) for t in part]
                key, fp = np.array([set_key(s) for s in sets], np.int64), np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
                yield pa.record_batch([b.column(0).slice(a, 256), b.column(1).slice(a, 256), pa.array(key), pa.array(fp)], names=["doc_id", "th", "key", "fp"])

    return texts.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, key long, fp long")


def _alike(heads: DataFrame) -> DataFrame:
    """a, b: keys whose fingerprints differ by DIFFERING bits or fewer: every key with the least one of its fingerprint, and
    the least ones of linked fingerprints, enough to span every component of the fingerprints. Sets without a shingle are
    in no pair."""
    own = cut(heads.where(F.col("key") != set_key(shingles(None))).select("key", "fp").distinct())
    first = cut(own.groupBy("fp").agg(F.min("key").alias("first")))
    same = own.join(first, "fp").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    x, y = (first.select(F.col("fp").alias(c), F.col("first").alias(f"k{c}")) for c in "ab")
    return same.unionByName(linked(first, DIFFERING).join(x, "a").join(y, "b").select(F.col("ka").alias("a"), F.col("kb").alias("b")))


def _leads(texts: DataFrame) -> DataFrame:
    """key, n, h: every leading shingle of a row. They are many, so they are dealt out without being written first."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _pieces(b.column(0)):
                sets = [shingles(t) for t in part]
                lead = [prefix(s, *shared.value) for s in sets]
                key, n, sizes = np.array([set_key(s) for s in sets], np.int64), np.array([len(s) for s in sets], np.int32), [len(p) for p in lead]
                yield pa.record_batch([pa.array(np.repeat(key, sizes)), pa.array(np.repeat(n, sizes)), pa.array(np.concatenate(lead).view(np.int64))], names=["key", "n", "h"])

    return texts.select("text").mapInArrow(run, "key long, n int, h long")


def _bit(th: Column) -> Column:
    return F.pmod(F.xxhash64(th), F.lit(MAP_BITS))


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, shingles of the texts that `wanted` (th) names and maybe of others, one row a key; no text is shuffled."""
    bit = _bit(F.col("th"))
    words = wanted.groupBy(F.floor(bit / 8).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))).alias("bits")).toPandas()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    bits[words["at"]] = words["bits"]
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False)
            held = b.column(1).filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for _, part in _pieces(held):
                sets = [shingles(t) for t in part]
                yield pa.record_batch([pa.array(np.array([set_key(s) for s in sets], np.int64)), _lists(sets)], names=["key", "shingles"])

    return texts.select(bit.alias("bit"), "text").mapInArrow(run, "key long, shingles array<long>").groupBy("key").agg(F.any_value("shingles").alias("shingles"))


def _light(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, each with its two sets in one row."""
    x, y = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both, size = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return pairs.join(x, "a").join(y, "b").where(both * (OVER + UNDER) >= size * OVER).select("a", "b")


def similar(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The rows (a, b) of `pairs` whose sets reach the similarity; `sets` has every key once, its shingles in order."""
    keys = sets["key"].to_numpy()
    lists = sets["shingles"].combine_chunks()
    flat, at = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    order = np.argsort(keys)
    a, b = (order[np.searchsorted(keys, pairs[c].to_numpy(), sorter=order)] for c in "ab")
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    kept = np.zeros(len(a), bool)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(a)]):
        own = flat[at[a[lo]] : at[a[lo] + 1]]
        others = [flat[at[j] : at[j + 1]] for j in b[lo:hi]]
        sizes = np.array([len(o) for o in others])
        met = np.concatenate(others)
        met = own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met
        both = np.add.reduceat(met.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
        kept[lo:hi] = both * (OVER + UNDER) >= (sizes + len(own)) * OVER
    return pa.table({"a": keys[a[kept]], "b": keys[b[kept]]})


def _verified(pairs: DataFrame, texts: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; `heads` has a text (th) of each key.

    Sets with one least shingle, as most of a large group have, lie in blocks of about SPAN shingles. Where two blocks
    have many pairs, their sets meet once and the pairs are compared there, instead of every pair carrying both sets."""
    pairs = cut(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = written(_sets(texts, heads.join(keys, "key", "left_semi").select("th")), "near-sets")
    least = sets.select("key", F.get("shingles", F.lit(0)).alias("least"), F.size("shingles").alias("n"))
    spans = least.groupBy("least").agg(F.ceil(F.sum("n") / SPAN).alias("spans"))
    block = F.xxhash64("least", F.pmod(F.xxhash64("key"), F.col("spans")))
    blocks = cut(least.join(spans, "least").select("key", block.alias("block")))
    x, y = (blocks.select(F.col("key").alias(c), F.col("block").alias(f"b{c}")) for c in "ab")
    placed = pairs.join(x, "a").join(y, "b").select("a", "b", F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb")).alias("cell"))
    full = placed.groupBy("cell").agg(F.count("*").alias("pairs")).where(F.col("pairs") > SHARED).select("cell", F.lit(True).alias("full"))
    placed = cut(placed.join(full, "cell", "left"))
    light, heavy = placed.where("full is null").select("a", "b"), placed.where("full").select("cell", "a", "b")
    met = heavy.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("key")).distinct().join(sets, "key").select("at", "key", "shingles")
    together = heavy.groupBy("cell").cogroup(met.groupBy("at")).applyInArrow(lambda p, s: similar(p.select(["a", "b"]), s), "a long, b long")
    found = cut(_light(light, sets).unionByName(together))
    discard(sets)
    return found


def _sized(x: str, y: str) -> Column:
    """Sizes that can reach the similarity."""
    return F.least(x, y) * UNDER >= F.greatest(x, y) * OVER


def _enough(n: Column) -> Column:
    """Leading shingles that a set of n shares with any set at the similarity."""
    return F.least(F.lit(TOGETHER), F.ceil(n * OVER / UNDER))


def _reach(c: str, x: str, y: str) -> Column:
    """Whether c leading shingles in common leave the similarity within reach: past the one of the two leads that ends
    first, its set has no more shingles to share than it has left."""
    left = F.greatest(*(F.ceil(F.col(n) * OVER / UNDER) - _enough(F.col(n)) for n in (x, y)))
    return (F.col(c) + left) * (OVER + UNDER) >= (F.col(x) + F.col(y)) * OVER


def _linked(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """a, b: pairs of keys at the similarity, enough of them to span every component: the candidates of the fingerprints, then
    all pairs that these leave apart."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = _leads(texts).repartition(n, "h").groupBy("h", "key").agg(F.max("n").alias("n"))
    met = lead.withColumn("m", F.count("*").over(Window.partitionBy("h"))).where("m > 1")
    # A key that meets others in too few shingles is in no pair.
    some = met.groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= _enough(F.col("n"))).select("key")
    met = written(met.join(some, "key", "left_semi").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "near-met")
    all_heads, heads = heads, heads.groupBy("key").agg(F.min("th").alias("th"))
    # First the candidates of the fingerprints and the best of the neighbours by size, which join most of a large group; then
    # all pairs that are still apart.
    w = Window.partitionBy("h", "block").orderBy("n", "key")
    chain = met.select(F.col("key").alias("a"), F.lag("key").over(w).alias("b"), F.col("n").alias("na"), F.lag("n").over(w).alias("nb")).where(F.col("b").isNotNull() & _sized("na", "nb"))
    best = chain.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(_reach("c", "na", "nb")).groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", "best.b")
    links = cut(_verified(_alike(all_heads).unionByName(best).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), texts, heads).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = cut(components(links))
    placed = met.join(nodes.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    apart = placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    placed = written(placed.join(apart, "h", "left_semi"), "near-apart")
    discard(met)
    # A pair that shares frequent shingles, as those of a large group do, is met at the least of them only, which counts all.
    frequent = placed.where(F.col("m") >= FREQUENT).groupBy("key").agg(F.collect_list("h").alias("listed")).where(F.size("listed") <= LISTED)
    rare, often = placed.where(F.col("m") < FREQUENT).withColumn("listed", F.lit(None).cast("array<long>")), placed.where(F.col("m") >= FREQUENT).join(frequent, "key", "left")
    members = rare.unionByName(often)
    x = members.select("h", "block", F.col("key").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("listed").alias("la"))
    y = members.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("listed").alias("lb"))
    alone = F.expr("la is null or lb is null")
    met_here = alone | (F.array_min(F.array_intersect("la", "lb")) == F.col("h"))
    shared = F.when(alone, 1).otherwise(F.size(F.array_intersect("la", "lb")))
    pairs = x.join(y, ["h", "block"]).where(F.expr("a > b and ca <> cb") & _sized("na", "nb") & met_here).select("a", "b", "na", "nb", shared.alias("c"))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    pairs = _verified(pairs.where(_reach("c", "na", "nb")).select("a", "b"), texts, heads)
    discard(placed)
    return links.unionByName(pairs)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns: the smallest doc_id, of equal ones any single row.

    A group is what is reachable over pairs of texts whose sets of five-word shingles (A-Z lower-cased) have a Jaccard
    similarity of 0.8 or more; a text of fewer words is one shingle, and all texts without words (null and empty ones
    too) are copies of each other. Rows are told apart by id and text; rows with a null id come last in a group, and of
    repeated rows one stays. Extra columns are kept; an empty table gives an empty result."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    heads = written(_heads(texts), "near-heads")
    nodes = components(_linked(texts, heads))
    rows = heads.groupBy("doc_id", "th", "key").agg(F.count("*").alias("copies"))
    rows = cut(rows.join(nodes.withColumnRenamed("node", "key"), "key", "left").select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th").alias("row"), "copies", F.coalesce("component", "key").alias("component")))
    first = rows.groupBy("component").agg(F.min("row").alias("first"))
    rows = rows.join(first, "component").select(F.col("row.doc_id").alias("_id"), F.col("row.th").alias("_th"), "copies", (F.col("row") == F.col("first")).alias("stays"))
    # A row that stays but repeats is handled apart, so that all others need no more than this join.
    rows = cut(rows.where("not stays or copies > 1"))
    own = docs.withColumn("_th", F.xxhash64(F.col("text").cast("string")))

    def same(other: DataFrame) -> Column:
        return F.col("doc_id").cast("long").eqNullSafe(other["_id"]) & (own["_th"] == other["_th"])

    out = own.join(rows, same(rows), "left_anti").select(docs.columns)
    again = rows.where("stays")
    if again.isEmpty():
        return out
    return out.unionByName(own.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "_th"]).select(docs.columns))
