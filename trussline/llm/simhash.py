"""SimHash near-dedup with anchor-point covering.

Two fingerprints within t bits differ by at most one bit in one of t // 2 + 1 parts. In each part the anchors are the
words of a covering code of radius 1 (a perfect Hamming code on the first 2^r - 1 bits, every word on the rest). A
fingerprint's home is the one anchor within the radius, and it is replicated to every anchor within the radius plus
the part's threshold, 2 in all: what lies within the threshold of a fingerprint then meets it at its home.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, written
from .graph import components

BITS, SEED = 64, 42
#: Bytes of text whose shingles are hashed at once.
CHUNK = 1 << 20
#: Members of an anchor that one task compares with as many others; larger anchors are compared in blocks.
BLOCK = 4096


def word_chunks(text: bytes, keep: int) -> Iterator[list[bytes]]:
    """The words of a text in chunks; each chunk repeats the last `keep` words of the one before."""
    if len(text) <= CHUNK:
        yield text.split()
        return
    start, tail = 0, []
    while start < len(text):
        end = min(len(text), start + CHUNK)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = tail + text[start:end].split()
        yield words
        tail, start = words[-keep:] if keep else [], end


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of `size` words, repeats included; of the whole sequence if it is shorter."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    parts, seen, whole = [], 0, []
    for words in word_chunks(text.encode("utf-8", "replace").lower(), size - 1):
        seen += len(words)
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
        if not any(map(len, parts)) and not grams:
            whole = words
        parts.append(np.fromiter(map(digest, grams), np.uint64, len(grams)))
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(out) and seen:
        out = np.array([digest(b" ".join(whole))], np.uint64)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a long), one row a row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t or "", size)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Covering:
    """The anchors of a part of `width` bits: r check bits cover the first 2^r - 1 bits with radius 1, the rest exactly."""

    def __init__(self, width: int):
        self.width = width
        self.r = max(1, (width + 1).bit_length() - 1)
        self.n = (1 << self.r) - 1

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest anchor and syndrome (the position, from 1, of the differing bit; 0: none)."""
        s = np.zeros(len(x), np.uint64)
        one = np.uint64(1)
        for i in range(self.n):
            s ^= np.where((x >> np.uint64(i)) & one, np.uint64(i + 1), np.uint64(0))
        return np.where(s > 0, x ^ (one << (s - one * (s > 0))), x), s

    def within_two(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, anchors): every anchor within two bits."""
        one, rows = np.uint64(1), np.arange(len(x))
        home, s = self.home(x)
        yield rows, home
        for i in range(self.n, self.width):
            yield rows, home ^ (one << np.uint64(i))
        # Two flips among the covered bits reach an anchor if their positions xor to the syndrome.
        for i in range(1, self.n + 1):
            j = s ^ np.uint64(i)
            ok = np.flatnonzero((s > 0) & (j > np.uint64(i)))
            yield ok, x[ok] ^ (one << np.uint64(i - 1)) ^ (one << (j[ok] - one))
        # Two flips among the rest keep an anchor an anchor; so does none on an anchor itself.
        at = np.flatnonzero(s == 0)
        for i in range(self.n, self.width):
            for j in range(i + 1, self.width):
                yield at, x[at] ^ (one << np.uint64(i)) ^ (one << np.uint64(j))


def _parts(threshold: int) -> list[tuple[int, int]]:
    n = threshold // 2 + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def anchored(fps: DataFrame, threshold: int) -> DataFrame:
    """part, anchor, fp, home: each fingerprint at every anchor that it is replicated to."""
    parts = _parts(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (lo, hi) in enumerate(parts):
                own = (x >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
                for t, (rows, anchors) in enumerate(Covering(hi - lo).within_two(own)):
                    n = len(rows)
                    yield pa.record_batch([pa.array(np.full(n, k, np.int8)), pa.array(anchors.view(np.int64)), pa.array(x[rows].view(np.int64)), pa.array(np.full(n, t == 0))], names=["part", "anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "part byte, anchor long, fp long, home boolean")


def _forest(x: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among the fingerprints x."""
    left = np.arange(len(x))
    out_a, out_b = [], []
    while len(left):
        # Breadth-first from the first one that no tree holds yet: as many steps as fingerprints, no list of pairs.
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.full(len(left), -1, np.int64)
            for f in front:
                near[(near < 0) & (np.bitwise_count(x[left] ^ x[f]) <= threshold)] = f
            got = near >= 0
            out_a.append(x[near[got]])
            out_b.append(x[left[got]])
            front, left = left[got], left[~got]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (x[:0], x[:0])


def _compare(threshold: int):
    """Links of the groups of a stream sorted by group; a group is bounded, so the one kept open is as well."""

    def links(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        a, b = [], []
        # Small groups by shifts over all of them at once, large ones each as a forest.
        small = np.repeat(sizes <= 48, sizes)
        for shift in range(1, int(sizes[sizes <= 48].max(initial=1))):
            same = (group[shift:] == group[:-shift]) & small[shift:]
            ok = np.flatnonzero(same)
            ok = ok[np.bitwise_count(x[ok] ^ x[ok + shift]) <= threshold]
            a.append(x[ok])
            b.append(x[ok + shift])
        for k in np.flatnonzero(sizes > 48):
            p, q = _forest(x[starts[k] : starts[k] + sizes[k]], threshold)
            a.append(p)
            b.append(q)
        a, b = np.concatenate([x[:0], *a]), np.concatenate([x[:0], *b])
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for b in batches:
            g = np.r_[rest[0], b.column(0).to_numpy(zero_copy_only=False)]
            x = np.r_[rest[1], b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(g):
                continue
            open_at = np.searchsorted(-(g[::-1] == g[-1]).astype(int), 0, "left") if g[0] != g[-1] else len(g)
            k = len(g) - int(open_at)
            p, q = links(g[:k], x[:k]) if k else (x[:0], x[:0])
            rest = (g[k:], x[k:])
            yield pa.record_batch([pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], names=["a", "b"])
        if len(rest[0]):
            p, q = links(*rest)
            yield pa.record_batch([pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], names=["a", "b"])

    return run


def linked(fps: DataFrame, threshold: int = 3) -> DataFrame:
    """a, b: links between distinct fingerprints within `threshold` bits, enough of them to span every component.

    Anchors that only one fingerprint reaches are dropped before the comparison. An anchor with more than BLOCK members
    is compared block by block, every block with every other, so no task holds more than two blocks of an anchor."""
    rows = written(anchored(fps, threshold), "anchors")
    met = rows.groupBy("part", "anchor").agg(F.count("*").alias("n"), F.bool_or("home").alias("homes")).where("n > 1 and homes").select("part", "anchor", "n")
    rows = rows.join(met, ["part", "anchor"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    group = F.xxhash64("part", "anchor", F.least("own", "other"), F.greatest("own", "other"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(group.alias("g"), "fp").repartition(n, "g").sortWithinPartitions("g").mapInArrow(_compare(threshold), "a long, b long").distinct()


def unsigned_key(c: Column) -> Column:
    """Fingerprints as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_duplicates(docs: DataFrame, size: int = 3, threshold: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id: one row a row of `docs`.

    component_id is the smallest doc_id among all documents reachable over links of `threshold` bits or fewer, itself
    included. Texts without words (null and empty ones too) have fingerprint zero, linked like any other. Copies are one
    fingerprint before anything is compared. Rows with a null id take part and get their component's smallest id (null
    if it has none); repeated rows stay; extra columns are ignored; an empty table gives an empty result."""
    marked = cut(fingerprints(docs, size))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = components(linked(classes, threshold))
    roots = classes.join(nodes.withColumnRenamed("node", "fp"), "fp").groupBy("component").agg(F.min("first").alias("least"))
    moved = nodes.join(roots, "component").select(F.col("node").alias("fp"), "least")
    heads = classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(heads, "fp").select("doc_id", unsigned_key(F.col("fp")).alias("fingerprint"), "component_id")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of `documents`; nulls, empty and long texts, repeated rows and an empty
    table as in `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
