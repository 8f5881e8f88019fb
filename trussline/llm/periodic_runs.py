"""Periodic runs in word sequences by recompression.

The words of many texts form one sequence, a unique mark after each text. Rounds of block compression (a maximal run of
one symbol becomes one symbol) and pair compression (a left symbol followed by a right one becomes one symbol) give a
run-length grammar: equal symbols of a level stand for equal words. How far two places agree (their longest common
extension) is read off the grammar: climb while both places begin the same symbol, skip whole blocks at once, come down.

A run of period q and length >= 4 q agrees with itself q words on over at least 3 q words, so one of the places
0, 3 q, 6 q ... of its text lies in that stretch. All these places of all periods (a harmonic sum, n log n) are candidates;
both extensions of those whose two words agree give the maximal run, exactly. No suffix array, no comparison of all pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words whose texts are compressed together (a longer text alone), and candidates examined at once.
BATCH_WORDS, CANDIDATES = 1 << 18, 1 << 21
#: A run is at least so many words and so many periods long. Fixed by the definition; the grid needs the second.
LEAST_LENGTH, LEAST_PERIODS = 6, 4
RUN = "struct<start:long,length:long,period:long>"


@dataclass
class Level:
    sym: np.ndarray  # symbols
    start: np.ndarray  # first word of every symbol, and the end
    ahead: np.ndarray  # symbols from here to the end of the block of equal ones, itself included
    behind: np.ndarray  # symbols from the beginning of the block to here, itself included


def _renamed(key: np.ndarray) -> tuple[np.ndarray, int]:
    names, out = np.unique(key, return_inverse=True)
    return out.astype(np.int32), len(names)


def grammar(words: np.ndarray) -> list[Level]:
    """The levels of the sequence, until a level has no symbol twice."""
    sym, n = _renamed(words)
    start, levels = np.arange(len(sym) + 1, dtype=np.int32), []
    while True:
        heads = np.flatnonzero(np.append(True, sym[1:] != sym[:-1])).astype(np.int32)
        long = np.diff(np.append(heads, len(sym)).astype(np.int32))
        behind = np.arange(1, len(sym) + 1, dtype=np.int32) - np.repeat(heads, long)
        levels.append(Level(sym, start, np.repeat(long, long) - behind + 1, behind))
        if n == len(sym):
            return levels
        # Blocks: only runs of two and more get a new name.
        sym, start = sym[heads], np.append(start[heads], start[-1])
        many = long > 1
        if many.any():
            names, kinds = _renamed(sym[many].astype(np.int64) * (int(long.max()) + 1) + long[many])
            sym = sym.copy()
            sym[many], n = names + n, n + kinds
        # Pairs: a hash of symbol and level tells left from right, so the same two neighbours always meet.
        side = (sym.astype(np.uint64) + np.uint64(len(levels) << 32)) * np.uint64(0x9E3779B97F4A7C15)
        right = ((side ^ (side >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)
        paired = np.append(~right[:-1] & right[1:], False)
        kept = ~np.append(False, paired[:-1])
        second = np.where(paired, np.append(sym[1:], 0), -1).astype(np.int64)
        sym, n = _renamed((sym.astype(np.int64) * (n + 1) + second + 1)[kept])
        start = np.append(start[:-1][kept], start[-1])


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from i and from j on (before i and before j) are equal."""
    i, j = i.astype(np.int64), j.astype(np.int64)
    began = i.copy()

    def jump(level: Level, on: np.ndarray) -> np.ndarray:
        """Move the places of `on` over as many equal symbols of the level as both blocks have; which of them moved."""
        a, b = np.searchsorted(level.start, i[on]), np.searchsorted(level.start, j[on])
        there = (level.start[a] == i[on]) & (level.start[b] == j[on])
        there &= (a < len(level.sym)) & (b < len(level.sym)) if forward else (a > 0) & (b > 0)
        on, a, b = on[there], a[there], b[there]
        x, y = (a, b) if forward else (a - 1, b - 1)
        same = level.sym[x] == level.sym[y]
        on, a, b, x, y = on[same], a[same], b[same], x[same], y[same]
        if forward:
            step = np.minimum(level.ahead[x], level.ahead[y])
            words = level.start[a + step] - level.start[a]
            i[on] += words
            j[on] += words
        else:
            step = np.minimum(level.behind[x], level.behind[y])
            words = level.start[a] - level.start[a - step]
            i[on] -= words
            j[on] -= words
        return on

    # What does not agree in its next words ends here, most candidates.
    on = jump(levels[0], np.arange(len(i)))
    every = on
    for level in levels[1:]:
        for _ in range(2):
            on = jump(level, on)
        on = every
    for level in reversed(levels):
        on = every
        while len(on):
            on = jump(level, on)
    return np.abs(i - began)


def _hopeful(words: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The candidates (place, period, text) that agree with themselves one period on, and so do the two words after or the
    two before: of the five words or more that agree in a run, two others lie on one side."""
    at, period, _ = candidates
    candidates = candidates[:, words[at] == words[at + period]]
    at, period, _ = candidates
    agree = lambda k: words[np.clip(at + k, 0, len(words) - 1)] == words[np.clip(at + period + k, 0, len(words) - 1)]
    return candidates[:, (agree(1) & agree(2)) | (agree(-1) & agree(-2))]


def find_runs(words: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) of the texts that begin at `offset` and have `size` words; `words` are numbers, and
    a number that occurs once follows each text. Starts and ends are places in `words`, in order."""
    most = size // LEAST_PERIODS * (size >= LEAST_LENGTH)
    offset, size, most = offset[most > 0], size[most > 0], most[most > 0]
    runs = np.zeros((0, 3), np.int64)
    if not len(most):
        return runs
    # Texts in turns of bounded candidates: a text of n words has under n (1 + log n) of them.
    weight, near = np.cumsum((size * (1 + np.log(size))).astype(np.int64)) // CANDIDATES, []
    for own in np.split(np.arange(len(most)), np.flatnonzero(np.diff(weight)) + 1):
        text = np.repeat(own, most[own])
        q = np.arange(len(text)) - np.repeat(np.cumsum(most[own]) - most[own], most[own]) + 1
        step = (LEAST_PERIODS - 1) * q
        count = (size[text] - q - 1) // step + 1
        # A long text alone is cut further, by periods.
        for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(count) // CANDIDATES)) + 1):
            c = count[part]
            nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            period = np.repeat(q[part], c)
            at = np.repeat(offset[text[part]], c) + nth * np.repeat(step[part], c)
            near.append(_hopeful(words, np.stack([at, period, np.repeat(text[part], c)])))
    at, period, text = np.concatenate(near, axis=1)
    if not len(at):
        return runs
    # Only texts with a candidate need a grammar.
    inside, used = np.zeros(len(words) + 1, np.int64), np.unique(text)
    inside[offset[used]] += 1
    np.add.at(inside, offset[used] + size[used] + 1, -1)
    place = np.flatnonzero(np.cumsum(inside))
    levels, at = grammar(words[place]), np.searchsorted(place, at)
    for a in range(0, len(at), CANDIDATES):
        i, q = at[a : a + CANDIDATES], period[a : a + CANDIDATES]
        begin, end = i - extensions(levels, i, i + q, False), i + q + extensions(levels, i, i + q, True)
        fits = (end - begin >= LEAST_LENGTH) & (end - begin >= LEAST_PERIODS * q)
        found = np.stack([place[begin[fits]], place[end[fits] - 1] + 1, q[fits]], axis=1)
        runs = np.unique(np.concatenate([runs, found]), axis=0)
    # A run of period q shows up under 2 q, 3 q ... too, with the same ends: the least counts.
    if len(runs):
        runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs


def _judged(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    """Runs and collapsed texts of a batch of texts."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    size = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(size + 1) - size - 1
    words = np.empty(int((size + 1).sum()), np.int64)
    for t, at, n in zip(texts, offset.tolist(), size.tolist(), strict=True):
        words[at : at + n] = np.fromiter(map(number.__getitem__, t), np.int64, n)
    words[offset + size] = len(number) + np.arange(len(texts))
    runs = find_runs(words, offset, size)
    text = np.searchsorted(offset, runs[:, 0], side="right") - 1
    # Words in a run after its first period go.
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone) == 0
    has = np.zeros(len(texts), bool)
    has[text] = True
    collapsed = [b" ".join([w for w, k in zip(t, kept[at : at + len(t)].tolist(), strict=True) if k] if own else t) for t, at, own in zip(texts, offset.tolist(), has.tolist(), strict=True)]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(runs[:, 0] - offset[text]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"])
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array(size), pa.ListArray.from_arrays(pa.array(bounds), struct), pa.array(collapsed, pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, collapsed: one row a row of `docs`; only doc_id and text are read.

    Words are `[^\\x20\\x09-\\x0D]+`. runs lists (start, length, period) of every maximal stretch with smallest period q and
    length >= max(6, 4 q), by start, then period; collapsed has the words that no run repeats, joined by one space. Null and
    empty texts have no words and an empty collapsed text; repeated rows and ids are judged one by one, null ids stay; an
    empty table gives no rows. Texts are whole however long: one needs some hundred bytes a word in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = text.as_py().split() if text.is_valid else []
                if texts and total + len(words) > BATCH_WORDS:
                    yield _judged(ids, texts)
                    ids, texts, total = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                total += len(words) + 1
        if texts:
            yield _judged(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: texts of ids with crc32 % 10 = 0 repeat a stretch of their own from some word on, as the query's
    contract says; the others, texts without words and null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    w = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = rows.withColumn("w", F.when(h % 10 == 0, w)).withColumn("g", F.floor(h / 10))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    tail = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (F.floor(tail / (F.col("g") % 8 + 3)) + 1).cast("int"))
    turns = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, "p"), F.ceil(tail / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(turns, F.lit(1), tail)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row of `documents`,
    with the planted periods of the contract. Nulls, empty and long texts, repeats and empty tables as in `periodic_runs`;
    the longest run counts (ties: smallest start, then period), and without one its four columns are null."""
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
