"""Suffix-array dedup: removes every byte that a repeated string of LENGTH bytes covers.

Every window of LENGTH bytes has an anchor, the gram of GRAM bytes with the least hash in it, so equal windows have
equal anchors at the same place, and windows with one anchor form a region of a text. Anchors only deal the work out:
the regions of a gram that occurs twice meet, one for each distinct one with its count. There the suffixes that start at
the anchors, and the reversed texts before them, are sorted deep-shallow (multikey quicksort to a shallow depth, blind
tries for the groups with longer common prefixes), and the two arrays of common prefixes alone say which windows have an
equal. Grams with very many regions are dealt out further, by more bytes of their windows, and sorted in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

LENGTH, GRAM, SHALLOW = 200, 40, 16
#: Bytes hashed at once (a power of two), and the bits that hold a place among them.
CHUNK, PLACE = 1 << 20, np.uint64((1 << 20) - 1)
#: Differing regions that are sorted together; where there are more, they are dealt out by more bytes of their windows.
MOST_REGIONS = 1024

_RNG = np.random.default_rng(200)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64, one chunk of them."""
    if base not in _powers:
        out = np.ones(CHUNK + 1, np.uint64)
        out[1:] = np.uint64(base)
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from running minima of blocks of w."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, ~np.uint64(0))
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def regions(raw: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Regions of texts laid end to end (`ends`: where each ends): text, lo, hi (first and last window start), at (the
    anchor), key (hash of its gram), rid (hash of the region and the anchor's place in it). At most CHUNK bytes."""
    n = len(raw)
    starts = np.r_[0, ends[:-1]]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _power(_BASE)[:n], out=sums[1:])
    if n < LENGTH:
        return {k: np.zeros(0, np.int64) for k in ("text", "lo", "hi", "at", "key", "rid")}
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * _power(_INVERSE)[: n - GRAM + 1])
    least = _sliding_least((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    # Only windows within one text count.
    opened = np.zeros(n + 1, np.int8)
    whole = ends - starts >= LENGTH
    opened[starts[whole]] += 1
    opened[ends[whole] - LENGTH + 1] -= 1
    valid = np.cumsum(opened[: len(least)]) > 0
    change = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])])
    # Two texts of exactly LENGTH bytes can lie window to window; a new text always starts a region.
    change = np.union1d(change, starts[(starts < len(least)) & whole])
    last = np.r_[change[1:], len(least)] - 1
    ok = valid[change]
    lo, hi = change[ok], last[ok]
    at = (least[lo] & PLACE).astype(np.int64)
    key = _mixed(grams[at] + np.uint64(0x9E3779B97F4A7C15))
    rid = _mixed((sums[hi + LENGTH] - sums[lo]) * _power(_INVERSE)[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    text = np.searchsorted(ends, lo, "right")
    return {"text": text, "lo": lo - starts[text], "hi": hi - starts[text], "at": at - starts[text], "key": key.view(np.int64), "rid": rid.view(np.int64)}


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text numbers, offsets, pieces) of at most CHUNK bytes together. Pieces of a long text overlap so that every window
    is in exactly one piece."""
    number, offset, pieces, held = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for s in range(0, len(t) - LENGTH + 1, CHUNK // 2):
            piece = t[s : s + CHUNK // 2 + LENGTH - 1]
            if held + len(piece) > CHUNK:
                yield number, offset, pieces
                number, offset, pieces, held = [], [], [], 0
            number.append(i)
            offset.append(s)
            pieces.append(piece)
            held += len(piece)
    if pieces:
        yield number, offset, pieces


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t1, t2 = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for number, offset, pieces in _chunks([x or b"" for x in b.column(2).to_pylist()]):
            r = regions(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces]))
            own, shift = np.array(number)[r["text"]], np.array(offset)[r["text"]]
            # One number for lo, hi - lo and at - lo, which are under 256 both: regions are what most bytes move for.
            place = (r["lo"] + shift) << 16 | (r["hi"] - r["lo"]) << 8 | (r["at"] - r["lo"])
            yield pa.record_batch([pa.array(t1[own]), pa.array(t2[own]), pa.array(place.astype(np.int64)), pa.array(r["key"]), pa.array(r["rid"])], names=["t1", "t2", "place", "key", "rid"])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class BlindTrie:
    """Orders strings with a long common prefix: a node keeps a depth and its children by the byte there; descending looks
    at those bytes only, and one comparison with the string that it ends at finds the place to insert."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root = [len(strings[first]), {-1: None}, [first]]  # depth, children, strings that end here

    def add(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while node[0] < len(s) and s[node[0]] in node[1]:
            node = node[1][s[node[0]]]
        depth = _common(s, self.strings[self._any(node)])
        parent, node = None, self.root
        while node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if node[0] > depth:
            # Split the way to `node` where s leaves it.
            other = self.strings[self._any(node)]
            split = [depth, {other[depth]: node}, []]
            if parent is None:
                self.root = split
            else:
                parent[1][s[parent[0]]] = split
            node = split
        if len(s) == depth:
            node[2].append(i)
        else:
            node[1][s[depth]] = [len(s), {}, [i]]

    def _any(self, node: list) -> int:
        while not node[2]:
            node = next(x for x in node[1].values() if x is not None)
        return node[2][0]

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            _, children, here = stack.pop()
            out.extend(here)
            stack.extend(child for _, child in sorted(children.items(), reverse=True) if child is not None)
        return out


def _multikey(strings: list[bytes], rows: list[int], depth: int, shallow: int, out: list[int]) -> None:
    """Three-way quicksort by the byte at `depth`; groups equal down to `shallow` go to a blind trie."""
    stack = [(rows, depth)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2:
            out.extend(rows)
        elif depth >= shallow:
            trie = BlindTrie(strings, rows[0])
            for i in rows[1:]:
                trie.add(i)
            out.extend(trie.ordered())
        else:
            byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in rows]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            less, same, more = ([i for i, x in zip(rows, byte, strict=True) if f(x)] for f in (lambda x: x < pivot, lambda x: x == pivot, lambda x: x > pivot))
            # Last in, first out: the smallest part is done next.
            stack.extend([(more, depth), (same, depth + 1), (less, depth)] if pivot >= 0 else [(more, depth)])
            if pivot < 0:
                out.extend(same)


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of strings that agree in their first `depth` bytes, and each one's common prefix with the one before."""
    order: list[int] = []
    _multikey(strings, list(range(len(strings))), depth, depth + shallow, order)
    return order, [0] + [_common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def _pairwise(strings: list[bytes], depth: int) -> np.ndarray:
    """Common prefixes of all pairs, minima over stretches of the sorted order; on the diagonal the lengths."""
    order, lcp = deep_shallow(strings, depth)
    n = len(order)
    sorted_ = np.zeros((n, n), np.int32)
    for x in range(n - 1):
        sorted_[x, x + 1 :] = np.minimum.accumulate(lcp[x + 1 :])
    out = np.empty_like(sorted_)
    out[np.ix_(order, order)] = sorted_ + sorted_.T + np.diag([len(strings[i]) for i in order]).astype(np.int32)
    return out


def repeated_windows(texts: list[bytes], anchors: list[int], counts: list[int]) -> list[list[tuple[int, int]]]:
    """For distinct texts with a gram at `anchors` that occur `counts` times: runs [first, last] of the offsets of the
    anchor in the windows that occur twice. In sorted order the copies of a text are neighbours that agree in all bytes."""
    same = all(t[a : a + GRAM] == texts[0][anchors[0] : anchors[0] + GRAM] for t, a in zip(texts, anchors, strict=True))
    right = _pairwise([t[a:] for t, a in zip(texts, anchors, strict=True)], GRAM if same else 0)
    left = _pairwise([t[:a][::-1] for t, a in zip(texts, anchors, strict=True)], 0)
    first = np.maximum(LENGTH - right, 0)
    met = (first <= left) & (first <= LENGTH - GRAM) & (right >= GRAM)
    met[np.diag_indices(len(texts))] &= np.array(counts) > 1
    i, j = np.nonzero(met)
    seen = np.zeros((len(texts), LENGTH + 2), np.int32)
    np.add.at(seen, (i, first[i, j]), 1)
    np.add.at(seen, (i, np.minimum(left[i, j], LENGTH) + 1), -1)
    return [[(s, e - 1) for s, e in _runs(m)] for m in np.cumsum(seen, axis=1)[:, : LENGTH - GRAM + 1] > 0]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the true runs."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _sorted_marks(classes: DataFrame, group: list[str], own: list[str]) -> DataFrame:
    """`group` and `own` columns, v1, v2: the offsets of the anchor in repeated windows. `classes` has a row for each
    distinct text of a group (repeats of a row are allowed): group, own, n (how often it occurs), a (place of the anchor)
    and text; a group has at most MOST_REGIONS rows, so what a task keeps open is bounded."""
    k, columns = len(group), [*group, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(rows: list) -> list[tuple]:
            rows = list({r[k:-3]: r for r in rows}.values())
            hits = repeated_windows([r[-1] for r in rows], [r[-2] for r in rows], [r[-3] for r in rows])
            return [(*r[:-3], *run) for r, runs in zip(rows, hits, strict=True) for run in runs]

        def batch(found: list) -> pa.RecordBatch:
            made = list(zip(*found, strict=True)) if found else [[]] * len(kinds)
            return pa.record_batch([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=[*columns, "v1", "v2"])

        held, found = [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:k] != held[0][:k]:
                    found += marks(held)
                    held = []
                held.append(row)
            yield batch(found)
            found = []
        yield batch(marks(held) if held else [])

    types = [classes.schema[c].dataType.simpleString() for c in columns]
    kinds = [*({"bigint": pa.int64(), "binary": pa.binary()}[t] for t in types), pa.int64(), pa.int64()]
    schema = ", ".join(f"{c} {t}" for c, t in zip([*columns, "v1", "v2"], [*types, "bigint", "bigint"], strict=True))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return classes.select(*columns, "n", "a", "text").repartition(parts, *group).sortWithinPartitions(*columns).mapInArrow(run, schema)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For key, rid, n, a, text and a range [o1, o2] of anchor offsets: the region's own part of it [u1, u2], 128-bit
    hashes of the core, the bytes that all windows of the range share, and of the whole, the bytes that the own part
    covers, and these bytes with the anchor's place in them."""
    for b in batches:
        a, texts, o1, o2 = (c.to_pylist() for c in b.columns[3:])
        out = []
        for x, t, p, q in zip(a, texts, o1, o2, strict=True):
            u1, u2 = max(p, x - (len(t) - LENGTH)), min(q, x)
            whole = t[max(0, x - u2) : x - u1 + LENGTH]
            core = t[x - p : x - q + LENGTH] if x >= p else b""
            out.append((u1, u2, xxhash.xxh3_128_digest(core), xxhash.xxh3_128_digest(whole), whole))
        u1, u2, core, whole, text = zip(*out, strict=True) if out else [[]] * 5
        yield pa.record_batch([*b.columns, pa.array(u1, pa.int64()), pa.array(u2, pa.int64()), pa.array(core, pa.binary()), pa.array(whole, pa.binary()), pa.array(text, pa.binary())], names=[*b.schema.names, "u1", "u2", "core", "whole", "own"])


def _hot_marks(hot: DataFrame) -> list[DataFrame]:
    """Marks (key, rid, v1, v2) of the regions of grams that have over MOST_REGIONS of them.

    The range of offsets is halved: windows of one half share more bytes (the core), and only regions with an equal core
    can share such a window, so they are dealt out by it. Groups that are small enough are sorted, the others halved
    again; where one offset is left the core is the whole window. Every level is an aggregate with joins that can be
    split, and no group is gathered in one place before it is small."""
    group, own = ["o1", "o2", "core"], ["u1", "u2", "whole"]
    marks, state = [], hot.withColumns({"o1": F.lit(0).cast("long"), "o2": F.lit(LENGTH - GRAM).cast("long")})
    while True:
        middle = F.floor((F.col("o1") + F.col("o2")) / 2).cast("long")
        halves = F.array(F.struct(F.col("o1").alias("o1"), middle.alias("o2")), F.struct((middle + 1).alias("o1"), F.col("o2").alias("o2")))
        state = state.withColumn("_h", F.explode(halves)).select("key", "rid", "n", "a", "text", "_h.o1", "_h.o2")
        spans = written(state.mapInArrow(_spans, "key long, rid long, n long, a long, text binary, o1 long, o2 long, u1 long, u2 long, core binary, whole binary, own binary").where("u1 <= u2"), "spans")
        classes = written(spans.groupBy(*group, *own).agg(F.sum("n").alias("n"), F.min("own").alias("text")).withColumn("a", F.col("u2")), "span-classes")
        sizes = written(classes.groupBy(*group).agg(F.count("*").alias("wholes"), F.sum("n").alias("total")).where("total > 1").drop("total"), "span-groups")
        small = (F.col("wholes") <= MOST_REGIONS) | (F.col("o1") == F.col("o2"))
        found = _sorted_marks(classes.join(sizes.where(small).drop("wholes"), group), group, own)
        marks.append(written(spans.select("key", "rid", *group, *own).join(written(found, "span-marks"), [*group, *own]).select("key", "rid", "v1", "v2"), "hot-marks"))
        large = sizes.where(~small).drop("wholes")
        if large.isEmpty():
            return marks
        state = written(spans.join(large, group, "left_semi").select("key", "rid", "n", "a", "text", "o1", "o2"), "open-spans")


def _cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, wanted = (c.to_pylist() for c in b.columns)
        out = [(w["key"], w["rid"], w["n"], w["place"] & 255, t[(lo := w["place"] >> 16) : lo + (w["place"] >> 8 & 255) + LENGTH]) for t, ws in zip(texts, wanted, strict=True) for w in ws]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["key", "rid", "n", "a", "text"])


def repeats(texts: DataFrame) -> DataFrame:
    """t1, t2, lo, hi: ranges of the starts of windows that occur elsewhere; `texts` has t1, t2 (128 bits that tell texts
    apart), nb (bytes), text (binary) and pick, a number that tells the copies of a text apart as far as possible."""
    found = written(texts.where(F.col("nb") >= LENGTH).select("t1", "t2", "text").mapInArrow(_find, "t1 long, t2 long, place long, key long, rid long"), "regions")
    # Written first: a join of two plain shuffles can be split where a gram is hot, one with an aggregate on a side cannot.
    keys = written(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared-grams")
    shared = written(found.join(keys, "key"), "shared-regions")
    discard(found)
    # Of a region that occurs often one is cut out and sorted, with its count.
    one = F.min(F.struct("t1", "t2", "place"))
    classes = written(shared.groupBy("key", "rid").agg(F.count("*").alias("n"), one.alias("first")), "region-classes")
    hot = written(classes.groupBy("key").agg(F.count("*").alias("regions")).where(F.col("regions") > MOST_REGIONS).select("key"), "hot-grams")
    picks = texts.groupBy("t1", "t2").agg(F.min("pick").alias("pick"))

    def cut_out(rows: DataFrame) -> DataFrame:
        lists = rows.select("key", "rid", "n", "first.*").groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "rid", "n", "place")).alias("wanted"))
        # Of the copies of a text only one is cut: the least id.
        return texts.join(lists.join(picks, ["t1", "t2"]), ["t1", "t2", "pick"]).select("text", "wanted").mapInArrow(_cut_regions, "key long, rid long, n long, a long, text binary")

    any_hot = not hot.isEmpty()
    marks = [_sorted_marks(cut_out(classes.join(hot, "key", "left_anti") if any_hot else classes), ["key"], ["rid"])]
    if any_hot:
        marks += _hot_marks(cut_out(classes.join(hot, "key", "left_semi")).dropDuplicates(["key", "rid"]))
    by_class = marks[0]
    for m in marks[1:]:
        by_class = by_class.unionByName(m)
    at = F.shiftright("place", 16) + F.col("place").bitwiseAND(255)
    return shared.join(written(by_class, "class-marks"), ["key", "rid"]).select("t1", "t2", (at - F.col("v2")).alias("lo"), (at - F.col("v1")).alias("hi")).distinct()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, marks = (c.to_pylist() for c in b.columns)
        removed, spans, kept = [], [], []
        for t, own in zip(texts, marks, strict=True):
            t, runs = t or b"", []
            for lo, hi in sorted((m["lo"], m["hi"]) for m in own or ()):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi + LENGTH)
                else:
                    runs.append([lo, hi + LENGTH])
            edges = [0, *(x for r in runs for x in r), len(t)]
            kept.append(b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(len(t) - len(kept[-1]))
            spans.append([{"start": a, "end": z} for a, z in runs])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept_sha256, kept (the remaining bytes): one row
    a row of `docs`.

    Each text is its UTF-8 bytes (null: empty); a byte goes if a string of LENGTH bytes covers it that also starts anywhere
    else, in the same text, another one or a repeated row. Matches stay within a text and are judged on the input. Texts
    under LENGTH bytes stay as they are. Equal texts share one result, found by 128 bits of hashes. Null ids and extra
    columns are allowed; an empty table gives an empty result."""
    text = F.col("text").cast("string").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("nb"))
    marks = repeats(rows.select("t1", "t2", "nb", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("pick"))).groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    joined = rows.join(marks, ["t1", "t2"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `documents`; nulls, empty and long texts, repeated
    rows and an empty table as in `dedup_substrings`."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
