"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of anything but the white space that the contracts name, which is also that of Python's bytes.split().
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="trussline-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the shared folder; survives lost executors. As in `written`, shuffles and
    checkpoints that have served are released: a loop of many small steps leaves many small files."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


#: Folder of this driver's intermediate tables, below the shared one.
SCRATCH = f"trussline-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{SCRATCH}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again. The shuffles that made it have served; Spark
    removes their files when the driver's garbage is collected, which a long job should not leave to chance."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Remove a table of `written` that nothing will read any more."""
    _remove(df.sparkSession, df.scratch_path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this driver, once the results that read them are written or collected."""
    _remove(spark, f"{shared_dir(spark).rstrip('/')}/{SCRATCH}")


#: Labels whose counts are broadcast; a column with more of them is joined without a hint.
BROADCAST_LABELS = 10_000


def hashed_sample(rows: DataFrame, label: str, k: int, seed: int = 0) -> DataFrame:
    """doc_id, label of the k ids of every label that hash lowest; an id counts once for a label. Ids far above a label's
    k-th lowest hash, as its count tells it, are dropped before anything is exchanged, so what meets in one task is a few
    times k, not the label's share of the table."""
    span = 1 << 31
    ids = rows.select("doc_id", label).withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(span)))
    # Repeated ids must not raise the count: a label of few ids would lose all.
    counts = cut(rows.groupBy(label).agg(F.approx_count_distinct("doc_id", 0.02).alias("_n")))
    if counts.count() <= BROADCAST_LABELS:
        counts = F.broadcast(counts)
    near = ids.join(counts, label).where(F.col("_h") * F.col("_n").cast("double") < 4.0 * k * span).select("doc_id", label, "_h").distinct()
    order = Window.partitionBy(label).orderBy("_h", "doc_id")
    return near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).select("doc_id", label)


def crc_mod(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % k


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
