"""Append-only feeds as streams: the ingest log, feedback events and saved versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import registry


def ingest_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the ingest log as they are appended."""
    return spark.readStream.schema(registry.INGEST).json(path)


def checked_ingest(stream: DataFrame, stored: DataFrame, dedupe: str | None = "1 day") -> DataFrame:
    """The log with the violation each line shows (null: none). Repeated lines are dropped within a watermark, which is our
    choice: it bounds the state that remembers them."""
    rows = stream
    if dedupe:
        rows = rows.withColumn("_at", F.to_timestamp("timestamp")).withWatermark("_at", dedupe).dropDuplicatesWithinWatermark(["ingest_id"]).drop("_at")
    both = rows.join(stored.select("path", F.col("size_bytes").alias("_size"), F.col("content_hash").alias("_hash")), "path", "left")
    what = F.when(F.col("_size").isNull(), F.lit("missing")).when(F.col("_size") != F.col("size_bytes"), F.lit("size_mismatch")).when(F.col("_hash") != F.col("content_hash"), F.lit("hash_mismatch"))
    return both.withColumn("violation", what).drop("_size", "_hash")


def feedback_counts(stream: DataFrame) -> DataFrame:
    """Feedback of every version and topic so far."""
    return stream.groupBy("version_id", "topic").agg(F.count("*").alias("n"))


def latest_stream(stream: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """key, order and columns of the row of greatest order that every key has had so far. The state is one row a key; in
    update mode each trigger gives the keys that it changed, and a late row of smaller order changes nothing."""
    latest = F.max_by(F.struct(order, *columns), order).alias("_latest")
    return stream.groupBy(key).agg(latest).select(key, "_latest.*")


def write_changes(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Append what every trigger gives to a log, under the trigger's number; a trigger that is run again replaces its own
    rows. Runs until the feed is read."""
    keep = lambda batch, number: registry.append_batch(batch, path, str(number))
    return stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame, key: str) -> DataFrame:
    """The last row of every key in a log of changes."""
    last = F.max_by(F.struct(*changes.columns), F.col("batch_id").cast("long")).alias("_last")
    return changes.groupBy(key).agg(last).select("_last.*").drop("batch_id")
