"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches of ascending id. A batch's line hashes, with the first document that holds each, are
anti-joined with the runs of earlier batches, and those that are new become a sorted run of their own, bucketed by hash
so that the merge needs no shuffle of the runs. When a level holds `fanout` runs they are compacted into one run of the
next level. A hash is in one run only, with its owner; every other document loses the lines of that hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, written

#: Null ids count as one document, after all others.
LAST = (1 << 63) - 1
#: Line hashes of a batch, and bounds of the number of batches: every batch reads all runs once.
ROWS_PER_BATCH, FEWEST, MOST = 50_000_000, 4, 32


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A line's key: white space stripped, A-Z lower-cased; None if shorter than min_chars code points."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found = [], []
            for text in b.column(2).to_pylist():
                own = {line_key(x, min_chars) for x in (text or "").encode("utf-8", "replace").split(b"\n")} - {None}
                found.extend(own)
                sizes.append(len(own))
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc", "th", "h1", "h2"])

    return run


class SortedRuns:
    """The runs, by level: [[(name, path), ...], ...]. A run is a table of h1, h2, owner, sorted by hash within hash buckets."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels, self.names = spark, fanout, [[]], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """A bucketed table in the shared folder."""
        name, path = f"run_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name), path

    def close(self) -> None:
        """Take the runs out of the catalog once no further batch will be merged; their files stay for `owners`."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, first: DataFrame) -> None:
        """Add the hashes of a batch (h1, h2, owner; a hash once) that no run holds."""
        for run, _ in self.runs():
            first = first.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(first))
        for k, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                merged = runs[0][0]
                for run, _ in runs[1:]:
                    merged = merged.unionByName(run)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(merged))
                runs.clear()

    def runs(self) -> list[tuple[DataFrame, str]]:
        return [run for runs in reversed(self.levels) for run in runs]

    def owners(self) -> DataFrame:
        """All hashes with their owners, without the bucketing: joins with hot keys may then be split."""
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(*(path for _, path in self.runs()))


def dropped_keys(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """doc, th, h1, h2: the line hashes that each text of a document loses. `docs` has doc, th (a hash of the text), text.
    The number of batches follows from that of line hashes."""
    spark = docs.sparkSession
    keys = written(docs.mapInArrow(_keys(min_chars), "doc long, th long, h1 long, h2 long"), "line-keys")
    if batches is None:
        batches = min(MOST, max(FEWEST, -(-keys.count() // ROWS_PER_BATCH)))
    cuts = sorted(set(keys.where(F.col("doc") < LAST).stat.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.02)))
    edges = [None, *map(int, cuts), None]
    runs = SortedRuns(spark, fanout)
    for lo, hi in zip(edges, edges[1:]):
        part = keys if lo is None else keys.where(F.col("doc") >= lo)
        part = part if hi is None else part.where(F.col("doc") < hi)
        runs.add(part.groupBy("h1", "h2").agg(F.min("doc").alias("owner")))
    runs.close()
    return keys.join(runs.owners(), ["h1", "h2"]).where("owner < doc").select("doc", "th", "h1", "h2")


def _kept(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, texts = [], [], []
            for text, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = (text or "").encode("utf-8", "replace").split(b"\n")
                kept = lines
                if drop:
                    gone = set(drop)
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept) if drop else text)
            yield pa.record_batch([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array([t.decode("utf-8", "replace") if isinstance(t, bytes) else t for t in texts], pa.string()), *b.columns[3:]], names=["doc_id", "n_lines", "n_dropped", "text", *b.schema.names[3:]])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, text and the `keep` columns: one row a row of `docs`, in any order.

    Keys of at least `min_chars` code points found in two documents or more lose all their lines but in the document of
    the smallest id; the other lines stay, joined by newlines. Null or empty texts are one empty line (a text that loses
    nothing comes back as it was, null included). Rows of one id are one document, as are all rows with a null id, which
    count as the last; what a row loses is listed by its text, so they do not meet in one place. Extra columns are
    ignored; an empty table gives an empty result."""
    named = {f"k{i}": c for i, c in enumerate(keep)}
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(k) for k, c in named.items()))
    rows = wanted.withColumns({"doc": F.coalesce("doc_id", F.lit(LAST)), "th": F.xxhash64("text")})
    drops = dropped_keys(rows.select("doc", "th", "text"), min_chars, batches, fanout)
    lists = drops.groupBy("doc", "th").agg(F.collect_set(F.concat(_le(F.col("h1")), _le(F.col("h2")))).alias("gone"))
    joined = rows.join(lists, ["doc", "th"], "left").select("doc_id", "text", "gone", *named)
    schema = ", ".join(["doc_id long, n_lines long, n_dropped long, text string", *(f"{k} {wanted.schema[k].dataType.simpleString()}" for k in named)])
    return joined.mapInArrow(_kept(min_chars), schema).withColumnsRenamed(named)


def _le(c):
    """A long's eight bytes, lowest first, as Python's hash bytes hold it."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8))))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of `documents`; nulls, empty and long texts, repeated rows and an
    empty table as in `dedup_lines`."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.i, k.line, o.owner IS NOT NULL AND o.owner < k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
