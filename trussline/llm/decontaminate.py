"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Only windows that hold enough shingles of some item can reach the similarity, so only those are fingerprinted; nothing
else is skipped. A window's fingerprint finds the items of its size within RADIUS bits: cut into BLOCKS blocks, two
such fingerprints differ by at most RADIUS // BLOCKS bits in one of them, so every item is listed once a block, in sorted
arrays, and a window looks up all values that near to its own. Candidates are verified by the exact weighted (multiset)
Jaccard similarity of shingles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .simhash import word_chunks

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 6, 17
#: Bytes of distinct item texts that one pass over the documents looks for, with an index of about six times as many;
#: more take more passes, so what is broadcast stays bounded.
PASS_BYTES = 16 << 20
#: Window results that a worker remembers, since copies of a passage give the same windows.
REMEMBERED = 50_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * B
    return x ^ (x >> np.uint64(29))


def _sequence_hash(parts: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` word numbers."""
    out = np.zeros(max(0, len(parts) - size + 1), np.uint64)
    for k in range(size):
        out = (out + parts[k : k + len(out)]) * A
    return _mix(out)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _bit_sums(numbers: np.ndarray) -> np.ndarray:
    """Running sums [pairs + 1, 64] of the bits of the hashes of neighbouring words."""
    pairs = _sequence_hash(numbers, 2)
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def _fingerprints(numbers: np.ndarray, sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Bits set in over half of the word pairs of each window; of a single word its own hash."""
    if size == 1:
        return _mix(numbers[starts])
    counts = sums[starts + size - 1] - sums[starts]
    return np.packbits(counts * 2 > size - 1, axis=1, bitorder="little").view(np.uint64)[:, 0]


EDGES = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
#: For each block the changes of its value by at most RADIUS // BLOCKS bits.
FLIPS = [np.array([sum(1 << a for a in at) for n in range(RADIUS // BLOCKS + 1) for at in combinations(range(hi - lo), n)], np.uint64) for lo, hi in zip(EDGES, EDGES[1:], strict=False)]


class Index:
    """The items of one pass, in flat arrays: shingles by item, known shingles, and for each block the items sorted by
    size and the block's value."""

    def __init__(self, items: list[tuple[int, int, str]]):
        """`items`: two numbers that tell a text, and the text; texts without words are left out."""
        texts = [(a, b, (t or "").encode("utf-8", "replace").lower().split()) for a, b, t in items]
        texts = [(a, b, w) for a, b, w in texts if w]
        self.ids = np.array([(a, b) for a, b, _ in texts], np.int64).reshape(-1, 2)
        self.sizes = np.array([len(w) for *_, w in texts], np.int64)
        self.by_size = {n: min(SHINGLE, n) for n in sorted(set(self.sizes.tolist()))}
        self.words = {w: k + 1 for k, w in enumerate(sorted({w for *_, ws in texts for w in ws}))}
        shingles, prints = [], []
        for *_, w in texts:
            shingles.append(np.sort(_sequence_hash(self.numbers(w), min(SHINGLE, len(w)))))
            hashes = _word_hashes(w)
            prints.append(_fingerprints(hashes, _bit_sums(hashes), np.array([0]), len(w))[0])
        self.ends = np.cumsum([0, *map(len, shingles)])
        self.shingles = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
        self.prints = np.array(prints, np.uint64)
        # Shingles by their length in words: items shorter than a shingle are one short shingle.
        length = np.repeat(np.minimum(SHINGLE, self.sizes), np.diff(self.ends))
        self.known = {g: np.unique(self.shingles[length == g]) for g in set(self.by_size.values())}
        self.maps = {}
        for g, known in self.known.items():
            bits = np.zeros(1 << max(12, (4 * len(known)).bit_length()), bool)
            bits[known & np.uint64(len(bits) - 1)] = True
            self.maps[g] = bits
        self.tables = []
        for b in range(BLOCKS):
            keys = self.block(self.prints, self.sizes, b)
            order = np.argsort(keys, kind="stable").astype(np.int32)
            self.tables.append((keys[order], order))
        self.longest = int(self.sizes.max(initial=0))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of known words, 0 for any other."""
        return np.fromiter(map(self.words.get, words, repeat(0)), np.uint64, len(words))

    @staticmethod
    def block(prints: np.ndarray, sizes: np.ndarray | int, b: int) -> np.ndarray:
        """A number for the size and the value of block `b`."""
        value = prints >> np.uint64(EDGES[b]) & np.uint64((1 << (EDGES[b + 1] - EDGES[b])) - 1)
        return np.asarray(sizes).astype(np.uint64) << np.uint64(16) | value

    def near(self, prints: np.ndarray, size: int) -> list[list[int]]:
        """For each fingerprint the items of that size within RADIUS bits."""
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b, (keys, order) in enumerate(self.tables):
            first, end = np.searchsorted(keys, np.array([size << 16, (size + 1) << 16], np.uint64))
            own, values = keys[first:end], self.block(prints, size, b)
            if len(own) <= len(FLIPS[b]):
                # Fewer items than values to look up: the same test from the other side.
                row, at = np.nonzero(np.bitwise_count(values[:, None] ^ own) <= RADIUS // BLOCKS)
                rows.append(row)
                items.append(order[first + at])
                continue
            wanted = (values[:, None] ^ FLIPS[b]).ravel()
            at = np.searchsorted(own, wanted)
            met = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == wanted)
            # Items of one size can share a block's value.
            many = np.searchsorted(own, wanted[met], "right") - at[met]
            rows.append(np.repeat(met // len(FLIPS[b]), many))
            items.append(order[first:end][np.repeat(at[met], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
        row, item = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        ok = np.bitwise_count(self.prints[item] ^ prints[row]) <= RADIUS
        out: list[list[int]] = [[] for _ in prints]
        for i, k in zip(row[ok].tolist(), item[ok].tolist(), strict=True):
            out[i].append(k)
        return out

    def common(self, k: int, own: Counter) -> int:
        """Shingles that item k has in common with `own`, repeats included."""
        return (own & Counter(self.shingles[self.ends[k] : self.ends[k + 1]].tolist())).total()


def _windows(index: Index, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, starts, shingle hashes) of the windows that hold enough shingles of any item to reach SIMILARITY."""
    made = {}
    for size, g in index.by_size.items():
        if len(numbers) < size:
            continue
        if g not in made:
            hashes, known, bits = _sequence_hash(numbers, g), index.known[g], index.maps[g]
            # Shingles with an unknown word have hashes as well, but none that is known.
            maybe = np.flatnonzero(bits[hashes & np.uint64(len(bits) - 1)])
            at = np.minimum(np.searchsorted(known, hashes[maybe]), max(0, len(known) - 1))
            held = np.zeros(len(hashes) + 1, np.int64)
            held[maybe + 1] = known[at] == hashes[maybe]
            made[g] = hashes, np.cumsum(held)
        hashes, sums = made[g]
        m = size - g + 1
        if sums[-1] >= SIMILARITY * m:
            starts = np.flatnonzero(sums[m:] - sums[: len(sums) - m] >= SIMILARITY * m - 1e-9)
            if len(starts):
                yield size, starts, hashes


def passages(index: Index, text: str | None, memory: dict) -> dict[int, tuple[float, int, int]]:
    """item number -> (similarity, first word, words) of its best window in the text, the earliest on ties."""
    best: dict[int, tuple[float, int, int]] = {}
    base, overlap = 0, max(0, index.longest - 1)
    for words in word_chunks((text or "").encode("utf-8", "replace").lower(), overlap):
        sums = None
        for size, starts, hashes in _windows(index, index.numbers(words)):
            if sums is None:
                own_hashes = _word_hashes(words)
                sums = _bit_sums(own_hashes)
            m = size - index.by_size[size] + 1
            prints = _fingerprints(own_hashes, sums, starts, size)
            keys = [(size, fp, hashes[s : s + m].tobytes()) for fp, s in zip(prints.tolist(), starts.tolist(), strict=True)]
            new = {key: i for i, key in enumerate(keys) if key not in memory}
            if len(memory) + len(new) > REMEMBERED:
                memory.clear()
                new = {key: i for i, key in enumerate(keys)}
            at = list(new.values())
            for key, i, near in zip(new, at, index.near(prints[at], size) if new else [], strict=True):
                memory[key], counted = [], Counter(hashes[starts[i] : starts[i] + m].tolist()) if near else None
                for k in near:
                    both = index.common(k, counted)
                    if both >= SIMILARITY * (2 * m - both) - 1e-9:
                        memory[key].append((k, both / (2 * m - both)))
            for start, key in zip(starts.tolist(), keys, strict=True):
                for k, similarity in memory[key]:
                    if k not in best or (similarity, -base - start) > (best[k][0], -best[k][1]):
                        best[k] = (similarity, base + start, size)
        base += len(words) - min(len(words), overlap)
    return best


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, t1, t2 (128 bits that tell its text) and text."""
    text = F.col("text").cast("string")
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def _passes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Indexes of about PASS_BYTES of distinct texts each, until every text was in one, and whether it is the last."""
    texts = _items(benchmark).where("text is not null").groupBy("t1", "t2").agg(F.min("text").alias("text"))
    n = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES))
    for k in range(n):
        yield Index([tuple(r) for r in texts.where(F.pmod("t1", F.lit(n)) == k).orderBy("t1", "t2").collect()]), k == n - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words: the best window of every item that a document holds.

    A window has as many words (A-Z lower-cased) as the item; items shorter than a shingle match whole, items without
    words match nothing. Nothing is read but doc_id, item_id and text. Repeated rows and items and null ids are reported
    as they are (a text that many items repeat is searched once); null and empty texts hold nothing; long texts are read
    in overlapping chunks; an empty table on either side gives no rows. Each pass but the last is run and written at once,
    then its index leaves the executors, so that one index is alive at a time however large the benchmark."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index, last in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memory: dict = {}
            for b in batches:
                found = [(i, *shared.value.ids[k].tolist(), *v) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, v in passages(shared.value, t, memory).items()]
                columns = list(zip(*found, strict=True)) if found else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["doc_id", "t1", "t2", "similarity", "start", "n_words"])

        leaks = rows.mapInArrow(run, "doc_id long, t1 long, t2 long, similarity double, start long, n_words long")
        if not last:
            leaks = written(leaks, "leaks")
            shared.destroy()
        out = leaks if out is None else out.unionByName(leaks)
    return out.join(_items(benchmark).drop("text"), ["t1", "t2"]).select("doc_id", "item_id", "similarity", "start", "n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no benchmark item. Nulls, empty and long texts, repeats and empty
    tables as in `find_leaks`: what holds no item stays.

    The last pass filters the rows where they lie. Each pass before it writes the 128 bits that tell a text with an item,
    gives up its index, and the rows of these texts are left out by a join that Spark chooses by the size of that table."""
    text = F.col("text").cast("string")
    for index, last in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        if last:
            at = docs.columns.index("text")

            def clean(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
                memory: dict = {}
                for b in batches:
                    yield b.filter(pa.array([not passages(shared.value, t, memory) for t in b.column(at).to_pylist()], pa.bool_()))

            return docs.mapInArrow(clean, docs.schema)

        def marked(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memory: dict = {}
            for b in batches:
                yield b.select([0, 1]).filter(pa.array([bool(passages(shared.value, t, memory)) for t in b.column(2).to_pylist()], pa.bool_()))

        marks = docs.select(F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2"), text.alias("text")).mapInArrow(marked, "_t1 long, _t2 long")
        marks = written(marks.distinct(), "leaking-texts")
        shared.destroy()
        docs = docs.join(marks, (F.xxhash64(text) == marks["_t1"]) & (F.xxhash64(F.lit(1), text) == marks["_t2"]), "left_anti")
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words of every item of `benchmark` in every row of `documents`; nulls, empty and
    long texts, repeated rows and empty tables as in `find_leaks`."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
