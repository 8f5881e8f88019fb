"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path prefix. Every URL offers the host suffixes and path prefixes that could be listed;
the filter (one 256-bit block a key, one bit in each of its eight 32-bit lanes) lets possible hits through, and a join
on the strings themselves removes false positives. The longest entry wins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import lower_ascii, table

#: The rules of the contract: (host, path prefix, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Bits a listed key gets, and the largest filter: a longer list only lets more false positives through to the join.
BITS_PER_KEY, MAX_FILTER_BYTES = 16, 8 << 20
#: Odd constants that pick a lane's bit from the key's hash.
LANE_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _blocks(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and the eight lane masks of each hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    bit = (h.astype(np.uint32)[:, None] * LANE_SALTS) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << bit


def bloom_filter(keys: DataFrame, n_keys: int) -> np.ndarray:
    """The filter of the `h` column, made by the executors: each block is a bitwise or of its keys. At most
    MAX_FILTER_BYTES come to the driver."""
    n_blocks = max(1, min(MAX_FILTER_BYTES // 32, -(-n_keys * BITS_PER_KEY // 256)))

    def masks(batches):
        for b in batches:
            block, mask = _blocks(b["h"].to_numpy(), n_blocks)
            yield pd.DataFrame({"block": block} | {f"m{i}": mask[:, i].astype(np.int64) for i in range(8)})

    schema = "block long, " + ", ".join(f"m{i} long" for i in range(8))
    rows = keys.select("h").mapInPandas(masks, schema).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"m{i}") for i in range(8))).toPandas()
    out = np.zeros((n_blocks, 8), np.uint32)
    out[rows["block"].to_numpy(np.int64)] = rows[[f"m{i}" for i in range(8)]].to_numpy(np.int64).astype(np.uint32)
    return out


def _passing(spark: SparkSession, words: np.ndarray):
    """A function from the candidates' hashes to the indices of those that the filter lets through."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf(ArrayType(IntegerType()))
    def passing(hashes: pd.Series) -> pd.Series:
        filled = shared.value
        sizes = np.fromiter((len(x) for x in hashes), np.int64, len(hashes))
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashes]) if sizes.sum() else np.zeros(0, np.int64)
        block, mask = _blocks(flat, len(filled))
        ok = ((filled[block] & mask) == mask).all(axis=1)
        ends = np.cumsum(sizes)
        return pd.Series([np.flatnonzero(ok[e - n : e]).astype(np.int32) for e, n in zip(ends, sizes, strict=True)], dtype=object)

    return passing


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row a row of `pages`.

    `rules` holds host, path, verdict (nulls are no rules; an entry listed twice counts once, by its least verdict). An
    entry fits its host and all subdomains where the URL's path starts with its path; the longest wins, the longer host
    on ties. URLs that no entry fits get `default`. Null ids and repeated rows stay; extra columns are ignored."""
    spark = pages.sparkSession
    listed = rules.where("host is not null and path is not null").groupBy(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("verdict"))
    listed = listed.withColumn("h", F.xxhash64("r_host", "r_path"))
    shape = listed.agg(F.count("*"), F.max(F.size(F.split("r_host", r"\."))), F.collect_set(F.length("r_path"))).first()
    n_keys, labels, lengths = shape[0], shape[1] or 1, sorted(shape[2])
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not n_keys:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    passing = _passing(spark, bloom_filter(listed, n_keys))
    # Only the last `labels` labels of a host and the listed lengths of a path can match, however long the URL is.
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    offered = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("r_host"), p.alias("r_path")))))
    hits = (
        urls.select("host", "path")
        .distinct()
        .withColumn("offered", offered)
        .where(F.size("offered") > 0)
        .withColumn("hit", passing(F.transform("offered", lambda c: F.xxhash64(c["r_host"], c["r_path"]))))
        .select("host", "path", F.explode(F.transform("hit", lambda i: F.get("offered", i))).alias("c"))
        .select("host", "path", "c.*")
    )
    longest = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"))
    found = hits.join(listed, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "verdict"), longest).alias("won"))
    return urls.join(found, ["host", "path"], "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def rule_rows(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages`; null and odd urls, repeated rows, ties of rules and an empty
    table as in `filter_urls`."""
    return filter_urls(table(spark, sf_dir, "pages"), rule_rows(spark))


OP2_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), q AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM p
), r(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT host, path, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS r_verdict
  FROM (SELECT DISTINCT host, path FROM q) d
  JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY host, path
)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.r_verdict, 'allow') AS verdict
FROM q LEFT JOIN m ON q.host = m.host AND q.path = m.path
"""
