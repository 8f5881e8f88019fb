"""Phrase collocation mining over depth-truncated suffix subtrees, built in groups of prefixes.

1. One reading counts all phrases in counters chosen by hash. A phrase whose counter stays under the least count is rare for
   certain; a counter that several phrases share only lets more through. Where the text outgrows the counters, longer phrases
   are counted in readings of their own, and only those whose parts may be frequent: else rare ones would fill all counters.
2. Another reading writes the suffix at every word, cut before it gets rare or longer than the depth, equal ones of a task once.
   Both read in as few tasks as keep the cores busy: what a task hands on is its counters and different suffixes, whatever the
   text it read, so that small splits of the input would multiply them.
3. Vertical partitioning: prefixes with more suffixes than a part of the memory budget are told by one more word, until they
   fit or have the full depth; prefixes are grouped by hash so that a group keeps within the budget.
4. Each group is sorted and its subtree built on its own: a node's count is the total of the leaves below it. Counts of the
   prefixes that were divided come from step 3.

All counts are exact. Cuts of a phrase, scores and absorption are joins of the counted phrases.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, table, written

#: Words end a piece at one of these, and are parted by blanks. Fixed by the definition; the table makes line ends and spaces
#: of them.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
PLAIN = bytes.maketrans(PIECE_ENDS + BLANKS, b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS))
EDGE = re.compile(rb"[ \n]")
#: Bytes of text read at once; distinct suffixes a task counts before it hands them on; bytes of text that a task reads at most
#: for each of its counters, unless there are cores for more tasks.
CHUNK, HELD, READ = 1 << 20, 1 << 20, 8
#: Counters: the least power of two over a twenty-fourth of the bytes (about four words each), within these bounds; 2^27 are
#: 128 MB in a task and, as one bit each, 16 MB broadcast. They are exchanged in compressed slices of 2^13.
LEAST_BITS, MOST_BITS, SLICE_BITS = 16, 27, 13
#: Suffixes of a group: its memory budget, or less where that spreads the work over at least so many groups; and the most
#: divided prefixes that are broadcast: where these are too few, groups grow and are sorted on disk.
GROUP_ROWS, GROUPS, DIVIDED = 1 << 18, 1 << 10, 1 << 16
CODEC = "zstd"
BASE, MIX = 0x9E3779B97F4A7C15, [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            power = lambda x: np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64)))
            self.up, self.down = power(BASE), power(pow(BASE, -1, 1 << 64))


@dataclass
class Words:
    """Words of a chunk of plain text: where they begin and end, how many words of the piece are left (itself included),
    their hashes, and how many of them count: the last ones of a chunk that goes on come again in the next."""

    text: bytes
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    hash: np.ndarray
    count: int


def split(text: bytes, powers: _Powers, ahead: int, goes_on: bool) -> Words:
    powers.upto(len(text) + 1)
    a = np.frombuffer(text, np.uint8)
    edge, line = (a == 32) | (a == 10), a == 10
    inner = np.append(np.append(True, edge), True)
    turn = np.flatnonzero(inner[1:] != inner[:-1])
    begin, end = turn[::2], turn[1::2]
    piece = np.cumsum(line)[begin] if len(begin) else begin
    left = np.searchsorted(piece, piece, side="right") - np.arange(len(begin))
    total = np.append(np.uint64(0), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers.up[: len(a)]))
    count = len(begin) - (min(ahead, int((piece == piece[-1]).sum())) if goes_on and len(begin) else 0)
    return Words(text, begin, end, left, (total[end] - total[begin]) * powers.down[begin], count)


def chunks(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[tuple[str, Words]]:
    """The words of all texts by language. Short texts are joined, as pieces of their own; long ones are cut."""
    powers, waiting = _Powers(), defaultdict(list)
    size: Counter = Counter()
    for b in batches:
        for lang, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = (value.as_py() or b"").lower().translate(PLAIN)
            while b"  " in text:
                text = text.replace(b"  ", b" ")
            start = 0
            while len(text) - start > CHUNK:
                found = EDGE.search(text, start + CHUNK)
                end = found.start() if found else len(text)
                own = split(text[start:end], powers, ahead, end < len(text) and text[end : end + 1] == b" ")
                yield lang, own
                start += int(own.begin[own.count]) if own.count < len(own.begin) else end - start
                if own.count == 0 and len(own.begin) and found:
                    # Fewer words than must come again: take more text instead.
                    break
            waiting[lang].append(text[start:] if start else text)
            size[lang] += len(waiting[lang][-1])
            if size[lang] >= CHUNK:
                yield lang, split(b"\n".join(waiting.pop(lang)), powers, ahead, False)
                del size[lang]
    for lang, own in waiting.items():
        yield lang, split(b"\n".join(own), powers, ahead, False)


def _counters(w: Words, lang: int, depth: int, bits: int) -> list[np.ndarray]:
    """For 1 to `depth` words: the counters of the phrases that begin at every word, -1 where the piece ends before."""
    h = w.hash * MIX[0]
    h = (h ^ (h >> np.uint64(32))) * MIX[2]
    own, out = h + np.uint64(lang), []
    for m in range(1, depth + 1):
        n = max(0, len(h) - m + 1)
        if m > 1:
            own = (own[:n] ^ (own[:n] >> np.uint64(31))) * MIX[1] + h[m - 1 :] * MIX[2]
        at = ((own ^ (own >> np.uint64(29))) * MIX[0] >> np.uint64(64 - bits)).astype(np.int64)
        out.append(np.append(np.where(w.left[:n] >= m, at, -1), np.full(len(h) - n, -1)))
    return out


def _lengths(w: Words, counters: list[np.ndarray], frequent: list[np.ndarray]) -> np.ndarray:
    """How many words from every word on may be a frequent phrase, as the bits for 1, 2, ... words tell."""
    size = np.zeros(len(w.begin), np.int64)
    for m, (at, bitmap) in enumerate(zip(counters, frequent, strict=False), 1):
        fits = (at >= 0) & (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & (size == m - 1)
        # The phrase without its first word has at least its count.
        if m > 1:
            fits[:-1] &= before[1:]
        size += fits
        before = fits
    return size


def _batch(schema: str, *columns: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _count_words(texts: DataFrame, bits: int, depth: int, least: int, lengths: range, frequent: list[np.ndarray]) -> DataFrame:
    """lang, n (words) of every task, and its counters (slice, counters) of phrases of so many words, each at most `least`,
    compressed. frequent: the bits of all shorter phrases; those with a rare part are not counted."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    schema = "lang string, n long, slice int, counters binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = Counter(), [], 0
        counters, frequent = np.zeros(1 << bits, np.uint8), shared.value

        def add() -> None:
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            counters[at] = np.minimum(least, counters[at] + np.minimum(n, least))
            waiting.clear()

        for lang, w in chunks(batches, depth - 1):
            total[lang] += w.count
            counted = _counters(w, xxhash.xxh64_intdigest(lang), lengths[-1], bits)
            whole = _lengths(w, counted, frequent) == len(frequent)
            for at in counted[lengths[0] - 1 :]:
                fits = at >= 0
                if frequent:
                    fits &= whole & np.append(whole[1:], False)
                waiting.append(at[: w.count][fits[: w.count]].astype(np.uint32))
                size += len(waiting[-1])
            if size > 1 << 21:
                add()
                size = 0
        if waiting:
            add()
        yield _batch(schema, list(total), list(total.values()), [None] * len(total), [None] * len(total))
        parts = [(k, pa.compress(part, CODEC, asbytes=True)) for k, part in enumerate(counters.reshape(-1, min(1 << SLICE_BITS, 1 << bits))) if part.any()]
        for a in range(0, len(parts), 256):
            own = parts[a : a + 256]
            yield _batch(schema, [None] * len(own), [None] * len(own), [k for k, _ in own], [c for _, c in own])

    return texts.mapInArrow(run, schema)


def _frequent_bits(counted: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit a counter: whether it reaches `least` over all tasks. Bounded by the number of counters."""
    held = min(1 << SLICE_BITS, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(pa.decompress(part, held, CODEC, asbytes=True), np.uint8)
                total[k] = np.minimum(least, total[k].astype(np.int16) + own).astype(np.uint8) if k in total else own
        if total:
            yield pa.record_batch([pa.array(total.keys(), pa.int32()), pa.array([np.packbits(v >= least).tobytes() for v in total.values()], pa.binary())], names=["slice", "bits"])

    size = held // 8
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in counted.where("slice is not null").select("slice", "counters").repartition("slice").mapInArrow(run, "slice int, bits binary").collect():
        out[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _suffixes(texts: DataFrame, frequent: list[np.ndarray], bits: int, depth: int) -> DataFrame:
    """lang, suffix (words joined by a space), n: the suffixes that may begin a frequent phrase, each as long as it may be
    one; equal ones of a task are counted together."""
    shared, schema = texts.sparkSession.sparkContext.broadcast(frequent), "lang string, suffix string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                # In order, what is exchanged and written compresses well.
                suffixes = sorted(own)
                n = [own[x] for x in suffixes]
                for a in range(0, len(n), 1 << 16):
                    part = n[a : a + (1 << 16)]
                    yield _batch(schema, [lang] * len(part), suffixes[a : a + (1 << 16)], part)
            counts.clear()

        for lang, w in chunks(batches, depth - 1):
            size = _lengths(w, _counters(w, xxhash.xxh64_intdigest(lang), depth, bits), shared.value)
            at = np.flatnonzero(size[: w.count])
            text = w.text
            counts[lang].update([text[a:b] for a, b in zip(w.begin[at].tolist(), w.end[at + size[at] - 1].tolist(), strict=True)])
            if sum(map(len, counts.values())) > HELD:
                yield from rows()
        yield from rows()

    return texts.mapInArrow(run, schema)


def _subtrees(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, words, f: the nodes of every group's subtree that lie at its prefix or deeper and
    whose leaves total `least`. rows: group, lang, words (array), n, depth (of the prefix), sorted by group, lang, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path, total, whole = None, [], [], []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def close(keep: int) -> None:
            """Leave the nodes below the first `keep` words; their leaves count for the node above."""
            while len(path) > keep:
                n, own = total.pop(), whole.pop()
                if own and n >= least:
                    for column, x in zip(out, (at[1], " ".join(path), len(path), n), strict=True):
                        column.append(x)
                path.pop()
                if total:
                    total[-1] += n

        def batch() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "words", "f"])
            for column in out:
                column.clear()
            return b

        for b in batches:
            for group, lang, words, n, depth in zip(*(c.to_pylist() for c in b.columns), strict=True):
                same = 0
                if at == (group, lang):
                    same = next((k for k, (x, y) in enumerate(zip(path, words, strict=False)) if x != y), min(len(path), len(words)))
                close(same)
                at = (group, lang)
                for k in range(same, len(words)):
                    path.append(words[k])
                    total.append(0)
                    # Above the prefix's depth other groups hold leaves too: step 3 has that node's count.
                    whole.append(k + 1 >= depth)
                total[-1] += n
            yield batch()
        close(0)
        yield batch()

    return rows.mapInArrow(run, "lang string, phrase string, words int, f long")


def count_phrases(docs: DataFrame, depth: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `depth` words that occur `least` times in their language: (lang, phrase, words, f); and (lang, n), the
    words of each language. A phrase lies within a piece; overlapping occurrences count.

    A-Z are lower-cased; null texts are empty, a null lang is `und`; repeated rows count each; texts are read whole, in
    chunks; an empty table gives no rows; only lang and text are read."""
    if not 1 <= least <= 255:
        raise ValueError("counters of a byte hold a least count of 1 to 255")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // 24).bit_length()))
    texts = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, size // (READ << bits)))
    # Counters in proportion to the text tell all lengths at once. At their most, shorter phrases come first.
    full = (size // 24).bit_length() > MOST_BITS
    frequent: list[np.ndarray] = []
    for lengths in [range(1, min(depth, 2) + 1), *(range(m, m + 1) for m in range(3, depth + 1))] if full else [range(1, depth + 1)]:
        counted = written(_count_words(texts, bits, depth, least, lengths, frequent), "phrase-counters")
        if lengths[0] == 1:
            sizes = cut(counted.where("slice is null").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"))
        frequent = frequent + [_frequent_bits(counted, bits, least)] * len(lengths)
        discard(counted)
    suffixes = written(_suffixes(texts, frequent, bits, depth).withColumn("words", F.split("suffix", " ")).drop("suffix"), "suffixes")

    # Vertical partitioning. Suffixes under a divided prefix go on with one more word; those it ends go on whole.
    total = suffixes.count()
    budget = max(min(GROUP_ROWS, total // GROUPS), 8 * total // DIVIDED, 8)
    routed, divided = suffixes.withColumn("depth", F.lit(1)), []
    for d in range(1, depth):
        prefix = F.when(F.col("depth") == d, F.slice("words", 1, d))
        large = routed.where(F.col("depth") == d).groupBy("lang", prefix.alias("prefix")).agg(F.count("*").alias("_rows"), F.sum("n").alias("f")).where(F.col("_rows") > budget // 8)
        large = written(large, "divided")
        divided.append(large)
        on = F.broadcast(large.select(F.col("lang").alias("_lang"), "prefix"))
        routed = routed.join(on, (F.col("lang") == F.col("_lang")) & (prefix == F.col("prefix")), "left")
        routed = routed.withColumn("depth", F.when(F.col("prefix").isNotNull(), d + 1).otherwise(F.col("depth"))).drop("_lang", "prefix")
    groups = max(1, -(-2 * total // budget))
    routed = routed.withColumn("group", F.pmod(F.xxhash64("lang", F.slice("words", F.lit(1), F.col("depth"))), F.lit(groups)))
    # Words of an array take 8 bytes and more each in a row: they are exchanged joined.
    sent = routed.select("group", "lang", F.array_join("words", " ").alias("suffix"), "n", "depth").repartition("group")
    ordered = sent.select("group", "lang", F.split("suffix", " ").alias("words"), "n", "depth").sortWithinPartitions("group", "lang", "words")
    found = _subtrees(ordered, least)
    for d, large in enumerate(divided, 1):
        found = found.unionByName(large.where(F.col("f") >= least).where(F.size("prefix") == d).select("lang", F.array_join("prefix", " ").alias("phrase"), F.lit(d).alias("words"), "f"))
    phrases = written(found, "phrases")
    discard(suffixes)
    return phrases, sizes


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(docs: DataFrame, depth: int = 4, least: int = 30, absorbed: int = 80, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score of the `most` best phrases of 2 to `depth` words of each language.

    a, l, r: occurrences of the phrase and of its two parts at the lowest-scoring cut (score floor(2000000 a / (l + r)), ties
    to the shorter first part); phrases inside a longer one that has at least `absorbed` percent of their occurrences are
    dropped. Ties of score go to the larger a, then by bytes. Odd inputs as in `count_phrases`."""
    phrases, sizes = count_phrases(docs, depth, least)
    part = lambda w, a, n: F.array_join(F.slice(w, a, n), " ")
    longer = phrases.where("words > 2").withColumn("w", F.split("phrase", " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: part("w", i, m))))
    inside = longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    own = phrases.where("words > 1").withColumnRenamed("f", "a").join(inside, ["lang", "phrase"], "left")
    own = own.where(F.col("above").isNull() | (_exact(F.col("above")) * 100 < _exact(F.col("a")) * absorbed)).drop("above")

    w = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), part(w, F.lit(1), k).alias("first"), part(w, k + 1, F.col("words") - k).alias("rest")))
    cut = own.select("lang", "phrase", "words", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cut = cut.withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)"))
    scored = cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")

    # First the best of every part of a language, so that no task sorts a whole one.
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    scored = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    scored = scored.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= most)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return scored.join(sizes, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the 2000 best phrases of 2 to 4 words and at least 30 occurrences of every
    language of `documents`. Null texts and languages, repeats, ties, long texts, empty tables as in `collocations`."""
    return collocations(table(spark, sf_dir, "documents")).drop("words")


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
listed as (
  select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
counted as (
  select lang, m, phrase, count(*) as f
  from (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) as phrase
        from listed, (select unnest([1, 2, 3, 4]) as m))
  group by all),
frequent as (select * from counted where f >= 30),
sizes as (select lang, sum(f) as n from counted where m = 1 group by lang),
cuts as (
  select lang, m, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from frequent where m > 1),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, 2000000::hugeint * c.a // (x.f + y.f) as score
  from cuts c
  join frequent x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : c.k], ' ')
  join frequent y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1 : c.m], ' ')),
lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
parts as (
  select lang, f, string_split(phrase, ' ') as w, m, unnest([2, 3]) as size from frequent where m > 2),
inside as (
  select lang, phrase, max(f) as above
  from (select lang, f, unnest(list_transform(range(1, m - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) as phrase
        from parts where size < m)
  group by all),
ranked as (
  select s.*, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank
  from lowest s left join inside i on i.lang = s.lang and i.phrase = s.phrase
  where i.above is null or 100::hugeint * i.above < 80::hugeint * s.a)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from ranked join sizes using (lang) where rank <= 2000
"""
