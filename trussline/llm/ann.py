"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are scaled to norm 1 at most and get one more component that makes their norm 1, queries are scaled to norm 1:
the largest inner product is then the smallest distance. Each table hashes with Gaussian projections cut into cells. A
query visits its own bucket and perturbed ones in the order of their estimated success; candidates of all tables are
merged and ranked by the exact inner product. Tables, projections, cell width and probes follow from a bounded sample: of
the layouts that find RECALL of true neighbours, the one of least cost in rows scored, visits and copies of the rows. A
vector goes only where a query visits its bucket.

Vectors travel as their bytes, and no join is left to Spark's estimate of a size, which knows neither what a Python step
makes of a row nor what a list holds: what is broadcast is counted before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: The most tables; a layout uses one of CHOICES.
TABLES, SEED, CHOICES = 8, 11, (1, 2, 4, 8)
#: Layouts that the sample chooses from: projections of a table, and cell widths as multiples of a true neighbour's distance.
HASHES, WIDTHS = (4, 6, 8, 12, 16, 24), (0.75, 1.25, 2.0, 3.0, 5.0)
#: Probes of a table: one for ROWS_PER_PROBE rows of the index, within these bounds. A large index pays for finer cells.
LEAST_PROBES, MOST_PROBES, ROWS_PER_PROBE = 200, 12_800, 32
#: Share of true neighbours to find, and bounds of the sample: queries and rows.
RECALL, SAMPLE, SAMPLE_ROWS = 0.96, 64, 4000
#: What a visit costs in rows scored, what each row of the index costs a query for one more table, and what a candidate
#: costs that a bin hands on.
VISIT_COST, TABLE_COST, HANDED_COST = 100.0, 0.01, 300.0
#: Bytes of vectors that meet in one task, and queries that meet a part of a bucket at once; both at most.
BIN_BYTES, QUERIES_PER_BLOCK = 32 << 20, 32_000
#: Buckets whose numbers of rows are broadcast; more of them are joined by an exchange.
BROADCAST_BUCKETS = 50_000
#: Candidates a task gathers before it keeps the best of each query, and queries and rows of one product.
BUFFER, PRODUCT = 130_000, (512, 4096)


@cache
def perturbations(hashes: int, n: int) -> np.ndarray:
    """The n sets of steps to neighbouring cells that succeed most often, best first, as rows of 0 and 1: column j stands
    for the j-th nearest of a query's 2 * hashes cell borders. The expected squared distance to the j-th is known, and the
    j-th and the j-th from the end are the two sides of one cell, so a set holds one of them at most."""
    m = hashes
    j = np.arange(1, 2 * m + 1)
    other = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - other / (m + 1) + other * (other + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(float(cost[0]), (0,))]
    while heap and len(out) < n:
        total, chosen = heapq.heappop(heap)
        if len({min(c, 2 * m - 1 - c) for c in chosen}) == len(chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - float(cost[last]) + float(cost[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + float(cost[last + 1]), (*chosen, last + 1)))
    sets = np.zeros((len(out), 2 * m), np.uint64)
    for row, chosen in zip(sets, out, strict=True):
        row[list(chosen)] = 1
    return sets


@dataclass
class Hasher:
    a: np.ndarray  # [tables, dimensions + 1, hashes]
    b: np.ndarray  # [tables, hashes], in cells
    r: np.ndarray  # [tables, hashes + 1] odd numbers: a bucket's number is linear in its cells
    width: float
    norm: float  # the largest norm
    probes: int = 1

    def first(self, tables: int, probes: int) -> Hasher:
        """The same layout with its first tables only."""
        return Hasher(self.a[:tables], self.b[:tables], self.r[:tables], self.width, self.norm, probes)

    @classmethod
    def drawn(cls, dimensions: int, norm: float, hashes: int, width: float) -> Hasher:
        rng = np.random.default_rng(SEED)
        a, b = rng.normal(size=(TABLES, dimensions + 1, hashes)), rng.random((TABLES, hashes))
        return cls(a, b, rng.integers(0, 2**63, (TABLES, hashes + 1), np.uint64) * np.uint64(2) + np.uint64(1), width, norm)

    def _cells(self, x: np.ndarray) -> np.ndarray:
        return np.matmul(x, self.a) / self.width + self.b[:, None]

    def _codes(self, cells: np.ndarray) -> np.ndarray:
        return np.matmul(cells.astype(np.int64).view(np.uint64), self.r[:, :-1, None])[..., 0] + self.r[:, -1:]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Buckets [tables, rows]; buckets of different tables have different numbers."""
        x = x / self.norm
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return self._codes(np.floor(self._cells(np.c_[x, rest]))).view(np.int64)

    def visits(self, q: np.ndarray, n: int) -> np.ndarray:
        """Buckets [tables, queries, n] in the order of estimated success (fewer where there are not so many)."""
        at = self._cells(np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
        cells = np.floor(at)
        sets, own = perturbations(self.a.shape[2], n)[:n], self._codes(cells)
        inside = at - cells
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=2), axis=2, kind="stable")
        r = self.r[:, None, :-1]
        steps = np.take_along_axis(np.broadcast_to(np.concatenate([~r + np.uint64(1), r], axis=2), order.shape), order, axis=2)
        return (own[..., None] + np.matmul(steps, sets.T)).view(np.int64)


def _matrix(vec: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """The vectors [rows, dimensions] of a column of lists, or of bytes as `packed` makes them."""
    if isinstance(vec, pa.ChunkedArray):
        return np.concatenate([np.zeros((0, dimensions), np.float32), *(_matrix(c, dimensions) for c in vec.chunks)]) if vec.num_chunks != 1 else _matrix(vec.chunk(0), dimensions)
    if not len(vec):
        return np.zeros((0, dimensions), np.float32)
    if not pa.types.is_binary(vec.type):
        return vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    at = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset : vec.offset + len(vec) + 1]
    return np.frombuffer(vec.buffers()[2], np.uint8)[at[0] : at[-1]].view(f"f{(at[1] - at[0]) // dimensions}").reshape(-1, dimensions)


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best candidates of each query, a candidate once, ties to smaller ids."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])] if len(q) else np.zeros(0, bool)
    q, c, s = q[once], c[once], s[once]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) < k
    return q[keep], c[keep], s[keep]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of equal place, summed from the first component to the last whatever the number of rows."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


FOUND = "query long, cid long, score double, scored long"


def _rank(k: int, dimensions: int):
    """Exact scores of the candidates of one bin's parts of buckets; the k best of each query, and how many were scored.

    Single-precision products of whole blocks only choose: what their error may hide is scored too, in double precision
    and one fixed order, so results do not depend on what meets in a task."""
    error = (dimensions + 8) * 2.0**-23  # twice the bound for vectors of norm 1

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        kind = pa.schema([("query", pa.int64()), ("cid", pa.int64()), ("score", pa.float64()), ("scored", pa.int64())])
        if not len(rows) or not len(asks):
            return kind.empty_table()
        unit, x = rows["unit"].to_numpy(), _matrix(rows["vec"], dimensions)
        norms = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        order = np.lexsort((norms, unit))  # rows of like norms in one product
        unit, x, norms, ids = unit[order], x[order], norms[order], rows["cid"].to_numpy()[order]
        queries, qx = asks["query"].to_numpy(), _matrix(asks["vec"], dimensions).astype(np.float64)
        top, size = norms.max(), np.linalg.norm(qx, axis=1)
        small, asked = (x / top).astype(np.float32), (qx / size[:, None]).astype(np.float32)
        lists = asks["units"].combine_chunks()
        each, units = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        ends = np.r_[0, np.cumsum(each)]
        lo, hi = np.searchsorted(unit, units, "left"), np.searchsorted(unit, units, "right")
        scored = np.bincount(np.repeat(np.arange(len(asks)), each), hi - lo, len(asks)).astype(np.int64)
        step = max(PRODUCT[0], int(BUFFER // min(64, max(1.0, scored.mean()))))
        out = [_chunk(np.arange(a, min(len(asks), a + step)), ends, units, lo, hi, small, asked, x, ids, qx, norms / top, size * top) for a in range(0, len(asks), step)]
        q, c, s = (np.concatenate(p) for p in zip(*out, strict=True))
        told = np.r_[True, q[1:] != q[:-1]]  # the number scored once a query
        return pa.table([queries[q], c, s, np.where(told, scored[q], 0)], schema=kind)

    def _chunk(chosen, ends, units, lo, hi, small, asked, x, ids, qx, norms, size) -> tuple[np.ndarray, ...]:
        """The k best of the queries `chosen`, in order."""
        at = np.arange(ends[chosen[0]], ends[chosen[-1] + 1])
        who = np.repeat(chosen, np.diff(ends[chosen[0] : chosen[-1] + 2]))
        order = np.argsort(units[at], kind="stable")
        at, who = at[order], who[order]
        edges = np.flatnonzero(np.r_[True, units[at][1:] != units[at][:-1], True])
        least = np.full(len(chosen), -np.inf)  # a bound of the k-th best product
        held, n, limit = [], 0, BUFFER

        def prune() -> tuple[np.ndarray, ...]:
            q, c, s = _best(*(np.concatenate(p) for p in zip(*held, strict=True)), k)
            last = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) if len(q) else np.zeros(0, int)
            full = last[np.diff(np.r_[-1, last]) == k]
            least[q[full] - chosen[0]] = np.maximum(least[q[full] - chosen[0]], s[full] / size[q[full]])
            return q, c, s

        for e, first in zip(range(len(edges) - 1), at[edges[:-1]], strict=True):
            met = who[edges[e] : edges[e + 1]]
            for m in range(0, len(met), PRODUCT[0]):
                own = met[m : m + PRODUCT[0]]
                mine = asked[own]
                for b in range(lo[first], hi[first], PRODUCT[1]):
                    z = min(hi[first], b + PRODUCT[1])
                    product = mine @ small[b:z].T
                    slack = error * norms[z - 1] + 1e-37
                    if z - b > k and (new := np.isneginf(least[own - chosen[0]])).any():
                        kth = np.partition(product[new], z - b - k, axis=1)[:, z - b - k]
                        least[own[new] - chosen[0]] = kth.astype(np.float64) - slack
                    bound = np.nextafter((least[own - chosen[0]] - slack).astype(np.float32), np.float32(-np.inf))
                    r, c = np.divmod(np.flatnonzero(product >= bound[:, None]), z - b)
                    for i in range(0, len(r), 1 << 17):
                        q, j = own[r[i : i + (1 << 17)]], b + c[i : i + (1 << 17)]
                        held.append((q, ids[j], exact_scores(qx[q], x[j])))
                    n += len(r)
                    if n > limit:
                        held = [prune()]
                        n = len(held[0][0])
                        limit = max(BUFFER, 2 * n)
        return prune() if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    return run


def _bin_rows(dimensions: int) -> int:
    return max(256, BIN_BYTES // (4 * dimensions))


def _counted(df: DataFrame, n: int) -> DataFrame:
    """A table of n buckets for a join: broadcast if they are few, never by an estimate."""
    return F.broadcast(df) if n <= BROADCAST_BUCKETS else df.hint("merge")


def _meet(index: DataFrame, visits: DataFrame, queries: DataFrame, dimensions: int, k: int) -> DataFrame:
    """query, cid, score, scored: the k best of every bin for the queries that visit it. `index`: bucket, cid, vec;
    `visits`: bucket, query, a visit once; `queries`: query, vec.

    A bucket over a bin's rows is split, the queries that visit it come in blocks, and its vectors are copied to those
    blocks only: rows dealt out are in proportion to visits, however many queries there are in all. Where the bins would be
    fewer than the tasks, rows and queries are both dealt out more finely."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    occupied = cut(index.groupBy("bucket").agg(F.count("*").alias("rows")))
    n = occupied.count()
    visits = cut(visits.join(_counted(occupied.select("bucket"), n), "bucket").select("bucket", "query"))
    parts = cut(visits.groupBy("bucket").agg(F.count("*").alias("visits")).join(_counted(occupied, n), "bucket"))
    n_rows, n_queries = parts.agg(F.sum("rows")).first()[0] or 0, queries.count()
    per_bin, per_block = _bin_rows(dimensions), QUERIES_PER_BLOCK
    found = max(1, n_rows / per_bin) * max(1, n_queries / per_block)
    if found < 2 * tasks:
        finer = (2 * tasks / found) ** 0.5
        per_bin, per_block = max(256, int(min(per_bin, n_rows) / finer)), max(min(256, per_block), int(min(per_block, n_queries) / finer))
    all_blocks = -(-n_queries // per_block) or 1
    parts = cut(parts.select("bucket", F.ceil(F.col("rows") / per_bin).cast("int").alias("splits"), ((F.col("visits") > per_block) | (F.col("visits") > F.col("rows") * all_blocks) | F.lit(all_blocks == 1)).alias("dealt"), "rows", "visits"))
    parts = parts.withColumn("blocks", F.when(F.col("dealt"), all_blocks).otherwise(1))
    large, dealt = F.col("rows") * 2 > per_bin, F.col("dealt")
    own, rest, once, shared = parts.agg(F.sum(F.when(large, F.col("splits").cast("long") * F.col("blocks"))), F.sum(F.when(~large, F.col("rows"))), F.sum(F.when(~large & ~dealt, F.col("visits"))), F.sum(F.when(~large & dealt, F.col("visits")))).first()
    bins = -(-max(rest or 0, once or 0, (shared or 0) // (16 * all_blocks), 1) // per_bin)
    tasks = max(tasks, min(2 * (bins * all_blocks + (own or 0)), 4 * tasks))
    parts = parts.select("bucket", "splits", "blocks", "dealt", large.alias("large"))
    unit, each = F.xxhash64("bucket", "split", "block"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # The parts of a large bucket have bins of their own, small buckets share them; where copies of the rows cost less than
    # those of the queries, a bin's queries are dealt out to blocks too.
    to_bin = F.xxhash64(F.when(F.col("large"), F.xxhash64("bucket", "split")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(bins))), F.when(F.col("dealt"), F.col("block")).otherwise(-1)).alias("bin")
    rows = index.join(_counted(parts, n), "bucket").withColumn("split", F.pmod(F.xxhash64("cid"), "splits").cast("int")).withColumn("block", each("blocks"))
    rows = rows.select(to_bin, unit.alias("unit"), "cid", "vec").repartition(tasks, "bin")
    asks = visits.join(_counted(parts, n), "bucket").withColumn("block", F.pmod(F.xxhash64("query"), "blocks").cast("int")).withColumn("split", each("splits"))
    asks = asks.select(to_bin, unit.alias("unit"), "query").groupBy("bin", "query").agg(F.collect_list("unit").alias("units"))
    asks = asks.join(queries.hint("merge"), "query").repartition(tasks, "bin")
    return rows.groupBy("bin").cogroup(asks.groupBy("bin")).applyInArrow(_rank(k, dimensions), FOUND)


def _exact(classes: DataFrame, queries: DataFrame, dimensions: int, k: int) -> DataFrame:
    """The k best of all classes for every query, without the index: all of them are one bucket."""
    one = F.lit(0).cast("long").alias("bucket")
    return _meet(classes.select(one, "cid", "vec"), queries.select(one, "query"), queries, dimensions, k)


def true_neighbours(classes: DataFrame, own: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """i, score, vec: the k nearest of all classes to each of a few queries; a task keeps k a query."""
    shared = classes.sparkSession.sparkContext.broadcast((own, q))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        s, vec = np.zeros((len(q), 0)), np.zeros((len(q), 0, q.shape[1]))
        for b in batches:
            if len(b):
                x = _matrix(b.column(1), q.shape[1]).astype(np.float64)
                new = q @ x.T
                new[own[:, None] == b.column(0).to_numpy()[None]] = -np.inf
                top = np.argpartition(-new, k - 1, axis=1)[:, :k] if new.shape[1] > k else np.tile(np.arange(new.shape[1]), (len(q), 1))
                s, vec = np.concatenate([s, np.take_along_axis(new, top, axis=1)], axis=1), np.concatenate([vec, x[top]], axis=1)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                s, vec = np.take_along_axis(s, top, axis=1), np.take_along_axis(vec, top[:, :, None], axis=1)
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(q)), s.shape[1])), pa.array(s.ravel()), pa.array(list(vec.reshape(-1, q.shape[1])), pa.list_(pa.float64()))], names=["i", "score", "vec"])

    best = Window.partitionBy("i").orderBy(F.desc("score"))
    found = classes.select("cid", "vec").mapInArrow(nearest, "i long, score double, vec array<double>").where(F.col("score") > float("-inf"))
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).toPandas()


def _ranks(hasher: Hasher, q: np.ndarray, codes: np.ndarray, most: int) -> np.ndarray:
    """[tables, queries, rows]: which probe of a query meets a row of these buckets, `most` if none does."""
    visits = hasher.visits(q, most)
    out = np.full((len(codes), len(q), codes.shape[1]), most, np.int32)
    for t in range(len(codes)):
        for i in range(len(q)):
            order = np.argsort(visits[t, i], kind="stable")
            at = np.minimum(np.searchsorted(visits[t, i], codes[t], sorter=order), visits.shape[2] - 1)
            out[t, i] = np.where(visits[t, i][order[at]] == codes[t], order[at], most)
    return out


def calibrated(classes: DataFrame, queries: DataFrame, n: int, n_queries: int, dimensions: int, norm: float, k: int) -> Hasher | None:
    """The layout that finds RECALL of the true neighbours of about SAMPLE queries at the least cost, as about SAMPLE_ROWS
    rows tell it; None if no layout does within the probes that so large an index allows."""
    most = min(MOST_PROBES, max(LEAST_PROBES, n // ROWS_PER_PROBE))

    def some(rows: DataFrame, key: str, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        chosen = rows.where(F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(max(1, -(-n // most)))) == 0)
        return read(chosen.select(key, "vec"))

    def read(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = rows.toArrow()
        order = np.argsort(got.column(0).to_numpy(), kind="stable")
        return got.column(0).to_numpy()[order], _matrix(got.column(1), dimensions).astype(np.float64)[order]

    own, q = some(queries, "query", n_queries, SAMPLE)
    if not len(own):
        own, q = read(queries.orderBy("query").limit(1).select("query", "vec"))
    found, (_, x) = true_neighbours(classes, own, q, k), some(classes, "cid", n, SAMPLE_ROWS)
    if found.empty or not len(x):
        return None
    near, i = np.stack(found["vec"].to_numpy()), found["i"].to_numpy()
    gap = np.sqrt(np.maximum(0, 2 - 2 * found["score"].to_numpy() / (np.linalg.norm(q, axis=1)[i] * norm)))
    scale = float(np.quantile(gap, 0.75)) or 1e-3
    best = None
    for hashes in HASHES:
        for width in sorted(WIDTHS, reverse=True):
            h = Hasher.drawn(dimensions, norm, hashes, width * scale)
            # More probes than the best layout's cost would pay for are not looked at.
            reach = min(most, int(best[0] / VISIT_COST) + 1) if best else most
            ranks, codes = _ranks(h, q, h.rows(near), reach)[:, i, np.arange(len(i))], None
            for tables in CHOICES:
                met = ranks[:tables].min(axis=0)
                probes = int(np.sort(met)[min(len(met) - 1, int(np.ceil(RECALL * len(met))) - 1)]) + 1
                fixed = tables * (VISIT_COST * probes + TABLE_COST * n + HANDED_COST * k * min(probes, n // _bin_rows(dimensions)))
                if probes > reach or best and fixed >= best[0]:
                    continue
                codes = h.rows(x) if codes is None else codes
                chosen = h.first(tables, probes)
                cost = fixed + float((_ranks(chosen, q[:24], codes[:tables], probes) < probes).sum(axis=(0, 2)).mean()) * n / len(x)
                if best is None or cost < best[0]:
                    best = cost, chosen
    return best and best[1]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, asks and the bytes of the vector of every row that takes part: with an id, not null, not zero, every component
    finite. Zeros have one sign, so equal vectors have equal bytes."""
    for b in batches:
        vec = b.column(1)
        sizes = np.where(vec.is_valid().to_numpy(zero_copy_only=False), vec.value_lengths().fill_null(0).to_numpy(), 0)
        flat = vec.flatten().to_numpy(zero_copy_only=False) + vec.type.value_type.to_pandas_dtype()(0)
        ends = np.r_[0, np.cumsum(sizes)]
        finite, other = (np.diff(np.r_[0, np.cumsum(c)][ends]) for c in (np.isfinite(flat), flat != 0))
        kept = (finite == sizes) & (other > 0) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
        at = np.r_[0, np.cumsum(sizes[kept])].astype(np.int32) * flat.itemsize
        data = pa.Array.from_buffers(pa.binary(), int(kept.sum()), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat[np.repeat(kept, sizes)]))])
        yield pa.record_batch([b.column(0).filter(pa.array(kept)), b.column(2).filter(pa.array(kept)), data], names=["vec_id", "asks", "vec"])


def _norm(classes: DataFrame, dimensions: int) -> float:
    """The largest norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.record_batch([pa.array([np.linalg.norm(_matrix(b.column(0), dimensions).astype(np.float64), axis=1).max()])], names=["norm"])

    return classes.select("vec").mapInArrow(run, "norm double").agg(F.max("norm")).first()[0]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, scored: the k rows of largest inner product found for every query row, and
    how many rows of the index, over all tables, were scored for it.

    `vectors` has vec_id and embedding. Vectors that are null, zero, hold null or non-finite components, have no id or
    not the commonest length take no part; a query's candidates are all rows of other ids. Equal vectors are one entry
    of the index that holds its k + 1 smallest ids, which is all that can be among a query's k nearest; equal scores are
    ordered by id. Large buckets are split and queries meet them in blocks, so nothing is dropped and no task holds a
    whole bucket. A query that finds fewer rows than k and its candidates allow is compared with all classes, and so is
    every query where no layout finds RECALL. Repeated rows count once; an empty table or no query gives no rows."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"), is_query.alias("asks"))
    rows = cut(given.mapInArrow(packed, "vec_id long, asks boolean, vec binary").distinct())
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scored long")
    sizes = rows.groupBy(F.octet_length("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if not sizes:
        return empty
    dimensions = sizes["d"] // (4 if kind == "array<float>" else 8)
    rows = rows.where(F.octet_length("vec") == sizes["d"])
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = cut(ranked.groupBy("vec").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("members")))
    asking = cut(rows.where("asks").hint("merge").join(classes.select("vec", "cid"), "vec").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query"), "vec"))
    queries = cut(asking.select("query", "vec").dropDuplicates(["query"]))
    n_queries, n = queries.count(), classes.count()
    if not n_queries:
        return empty
    norm = _norm(classes, dimensions)

    def lists(found: DataFrame, asking: DataFrame) -> DataFrame:
        found = cut(found)
        merged = found.groupBy("query", "cid").agg(F.max("score").alias("score"))
        merged = merged.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cid"))).where(F.col("n") <= k + 1)
        near = merged.hint("merge").join(classes.select("cid", "members"), "cid").select("query", "score", F.explode("members").alias("vec_id"))
        # A class of queries gets one list of k + 1 rows, and each query leaves itself out.
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
        own = asking.select("query_id", "query").hint("merge").join(near.hint("merge"), "query").where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        told = found.groupBy("query").agg(F.sum("scored").alias("scored"))
        return own.withColumn("rank", rank).where(F.col("rank") <= k).join(told.hint("merge"), "query").select("query_id", "rank", "vec_id", "score", "scored")

    hasher = calibrated(classes, queries, n, n_queries, dimensions, norm, k)
    if hasher is None:
        return lists(_exact(classes, queries, dimensions, k + 1), asking)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                for codes in hasher.rows(_matrix(b.column(1), dimensions)):
                    yield pa.record_batch([pa.array(codes), b.column(0), b.column(1)], names=["bucket", "cid", "vec"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.slice(a, 256)
                for codes in hasher.visits(_matrix(part.column(1), dimensions), hasher.probes):
                    codes = np.sort(codes, axis=1)
                    once = np.c_[np.ones(len(codes), bool), codes[:, 1:] != codes[:, :-1]]
                    yield pa.record_batch([pa.array(codes[once]), pa.array(np.repeat(part.column(0).to_numpy(), once.sum(axis=1)))], names=["bucket", "query"])

    # Twice computed, to count and to deal out: cheaper than a copy of the vectors for every table.
    indexed = classes.select("cid", "vec").mapInArrow(index, "bucket long, cid long, vec binary")
    tasks = max(1, min(-(-n_queries // 256), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    visits = queries.repartition(tasks, "query").select("query", "vec").mapInArrow(visit, "bucket long, query long")
    near = cut(lists(_meet(indexed, visits, queries, dimensions, k + 1), asking))
    # Candidates of a query: all rows but those of its own id.
    had = near.groupBy("query_id").agg(F.count("*").alias("had"))
    same = rows.select("vec_id").join(asking.select(F.col("query_id").alias("vec_id")).distinct().hint("merge"), "vec_id", "left_semi").groupBy(F.col("vec_id").alias("query_id")).agg(F.count("*").alias("same"))
    few = same.join(had.hint("merge"), "query_id", "left").where(F.coalesce("had", F.lit(0)) < F.least(F.lit(k), F.lit(rows.count()) - F.col("same"))).select("query_id")
    short = cut(asking.join(few.hint("merge"), "query_id", "left_semi"))
    left = short.select("query", "vec").dropDuplicates(["query"])
    if short.isEmpty():
        return near
    return near.join(short.select("query_id").hint("merge"), "query_id", "left_anti").select(near.columns).unionByName(lists(_exact(classes, left, dimensions, k + 1), short))


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score, scored: the 20 nearest of every row of `embeddings` whose vec_id is divisible by 20.

    Nulls, unusable vectors, repeated rows, equal scores (smaller vec_id first) and empty tables as in `nearest`."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
