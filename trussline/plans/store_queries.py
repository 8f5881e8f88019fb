"""Queries over stores and feeds: what sinks keep, what streams remember over several triggers. Their folders lie in the
shared one, each run's own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import registry
from ..sources.tables import table
from ..streaming import feeds
from .model_queries import _shared_dir
from .views import view


def _folder(spark, name):
    return f"{_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def artifact_paths(spark, sf_dir):
    """Artifacts of every part, and whether their path leaves its directory or names no file: up to four levels up."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/a/"), F.col("p_partkey").cast("string")).alias("artifact_dir"))
    kinds = ("/../x/model.ifc", "/sub/../model.ifc", "/./model.ifc", "/model.ifc", "/x/y/z/../../../model.ifc", "/x/../../../a/../b/model.ifc", "/none.ifc")
    inside = F.get(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % len(kinds)).cast("int"))
    one = lambda n, p: F.struct(F.lit(n).alias("name"), p.alias("path"))
    rows = part.withColumn("artifacts", F.array(one("ifc", F.concat("artifact_dir", inside)), one("log", F.lit("x"))))
    files = part.select(F.concat("artifact_dir", F.lit("/model.ifc")).alias("path"))
    return registry.artifact(rows, "ifc", files).select("p_partkey", F.col("a.path").alias("path"), "escapes", "missing")


def artifact_store(spark, sf_dir):
    """Artifacts written version by version, the second one twice: what the store holds."""
    v = view(spark, sf_dir, "v_versions").select((F.col("project_id") % 20).alias("project_id"), (F.col("ingest_seq") % 2 + 1).alias("n"), "ingest_seq", "topic")
    rows = v.withColumn("version_id", F.concat(F.lit("v"), F.col("n").cast("string")))
    path = _folder(spark, "artifacts")
    for n in (1, 2, 2):
        registry.write_artifacts(rows.where(F.col("n") == n).select("project_id", "version_id", "ingest_seq", "topic"), path)
    kept = spark.read.schema("ingest_seq long, topic string, project_id long, version_id string").json(path)
    return kept.groupBy("project_id", "version_id", "topic").agg(F.count("*").alias("n"), F.sum("ingest_seq").alias("total"))


def feedback_log(spark, sf_dir):
    """Feedback appended in batches by topic, one of them twice: what the log holds."""
    rows, path = view(spark, sf_dir, "v_versions").select("project_id", "version_id", "topic", "ingest_seq"), _folder(spark, "feedback-log")
    for topic in ("view", "click", "purchase", "signup", "click"):
        registry.append_batch(rows.where(F.col("topic") == topic), path, topic)
    log = spark.read.schema("project_id long, version_id string, topic string, ingest_seq long, batch_id string").json(path)
    return log.groupBy("version_id", "batch_id").agg(F.count("*").alias("n"), F.max("ingest_seq").alias("last_seq"))


def version_upserts(spark, sf_dir):
    """Saved versions that arrive in three triggers, later ones among them early: the current row of every version, and
    whether its project points to it. Both come from streams that keep one row a key."""
    columns = "version_id string, project_id long, topic string, ingest_seq long"
    v = view(spark, sf_dir, "v_versions").select("version_id", "project_id", "topic", "ingest_seq")
    run = _folder(spark, "versions")
    for k in (1, 0, 2):
        v.where((F.floor(F.col("ingest_seq") / 500) % 3) == k).write.mode("append").parquet(f"{run}/in")
        source = lambda: spark.readStream.schema(columns).parquet(f"{run}/in")
        feeds.write_changes(feeds.latest_stream(source(), "version_id", ["project_id", "topic"], "ingest_seq"), f"{run}/rows", f"{run}/rows-state").awaitTermination()
        feeds.write_changes(feeds.latest_stream(source(), "project_id", ["version_id"], "ingest_seq"), f"{run}/pointers", f"{run}/pointers-state").awaitTermination()
    rows = feeds.current(spark.read.schema(columns + ", batch_id long").json(f"{run}/rows"), "version_id")
    pointers = feeds.current(spark.read.schema("project_id long, version_id string, ingest_seq long, batch_id long").json(f"{run}/pointers"), "project_id")
    aimed = pointers.groupBy("version_id").agg(F.count("*").alias("pointers"))
    return rows.join(aimed, "version_id", "left").select("version_id", "project_id", "topic", "ingest_seq", F.coalesce("pointers", F.lit(0)).alias("pointers"))


def ingest_checks(spark, sf_dir):
    """Lines of an ingest log checked against the stored files as they arrive, in two triggers: the second brings repeated
    lines, which the stream drops, and lines from days before, which are too late."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("size"))
    path = F.concat(F.lit("p"), F.col("id").cast("string"))
    stored = p.where("id % 7 <> 0").select(path.alias("path"), (F.col("size") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(F.col("id") % 3 == 0, "x").otherwise("h").alias("content_hash"))
    at = F.date_format(F.timestamp_seconds(F.lit(1_704_880_800) + F.col("id") % 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = p.select("id", F.concat(F.lit("i"), F.col("id").cast("string")).alias("ingest_id"), at.alias("timestamp"), path.alias("path"), F.col("size").alias("size_bytes"), F.lit("h").alias("content_hash"))
    early = line.where("id % 2 = 0")
    late = line.where("id % 10 = 1").withColumn("timestamp", F.lit("2024-01-01T00:00:00Z")).withColumn("ingest_id", F.concat("ingest_id", F.lit("-late")))
    second = line.where("id % 2 = 1").unionByName(line.where("id % 4 = 0")).unionByName(late)
    run = _folder(spark, "ingest")
    for rows in (early, second):
        rows.drop("id").write.mode("append").json(f"{run}/in")
        checked = feeds.checked_ingest(feeds.ingest_stream(spark, f"{run}/in"), stored)
        feeds.write_changes(checked, f"{run}/out", f"{run}/state", mode="append").awaitTermination()
    log = spark.read.schema("ingest_id string, violation string, size_bytes long, batch_id long").json(f"{run}/out")
    return log.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("n"), F.countDistinct("ingest_id").alias("lines"), F.sum("size_bytes").alias("bytes"))


QUERIES = {f.__name__: f for f in (artifact_paths, artifact_store, feedback_log, version_upserts, ingest_checks)}
ORACLES = {
    "artifact_paths": """
SELECT p_partkey, '/a/' || CAST(p_partkey AS STRING) || ['/../x/model.ifc', '/sub/../model.ifc', '/./model.ifc', '/model.ifc', '/x/y/z/../../../model.ifc', '/x/../../../a/../b/model.ifc', '/none.ifc'][p_partkey % 7 + 1] AS path,
  p_partkey % 7 IN (0, 5) AS escapes, p_partkey % 7 = 6 AS missing FROM part""",
    "artifact_store": "SELECT project_id % 20 AS project_id, 'v' || CAST(ingest_seq % 2 + 1 AS STRING) AS version_id, topic, count(*) AS n, CAST(sum(ingest_seq) AS BIGINT) AS total FROM v_versions GROUP BY 1, 2, 3",
    "feedback_log": "SELECT version_id, topic AS batch_id, count(*) AS n, max(ingest_seq) AS last_seq FROM v_versions WHERE topic IN ('view', 'click', 'purchase', 'signup') GROUP BY 1, 2",
    "version_upserts": """
WITH v AS (SELECT version_id, arg_max(project_id, ingest_seq) AS project_id, arg_max(topic, ingest_seq) AS topic, max(ingest_seq) AS ingest_seq FROM v_versions GROUP BY 1),
p AS (SELECT project_id, arg_max(version_id, ingest_seq) AS version_id FROM v_versions GROUP BY 1)
SELECT v.*, (SELECT count(*) FROM p WHERE p.version_id = v.version_id) AS pointers FROM v""",
    "ingest_checks": """
SELECT CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'size_mismatch' WHEN page_id % 3 = 0 THEN 'hash_mismatch' ELSE 'none' END AS violation,
  count(*) AS n, count(*) AS lines, CAST(sum(length(content)) AS BIGINT) AS bytes FROM v_pages GROUP BY 1""",
}
