"""Registry tables: assets and their integrity, projects, requests and versions, ids, snapshots and artifacts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import safe_filename

#: Columns of a line of the ingest log.
INGEST = "ingest_id string, timestamp string, project_id string, filename string, storage_name string, media_type string, path string, extension string, size_bytes long, content_hash string"
FEEDBACK = "feedback_id string, received_at string, project_id string, request_id string, version_id string, topic string, comment string, metadata map<string,string>"


def asset_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.when(ext.isin(".dwg", ".dxf"), F.lit("cad")).when(ext == ".pdf", F.lit("pdf")).otherwise(F.lit("unknown"))


def routed_assets(assets: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets with kind and the first of their candidate paths that exists, error rows for those with none);
    assets: asset_id, candidates (array of paths); listing: path."""
    tried = assets.select("asset_id", F.posexplode("candidates").alias("n", "path")).join(listing.select("path"), "path", "left_semi")
    found = assets.join(tried.groupBy("asset_id").agg(F.min_by("path", "n").alias("path")), "asset_id", "left").withColumn("kind", asset_kind(F.col("path")))
    missing = found.where("path is null").select("asset_id", F.lit("asset_missing").alias("category"), F.lit("error").alias("severity"))
    return found.where("path is not null"), missing


def register_assets(files: DataFrame) -> DataFrame:
    """Registered form of uploaded files (filename, content): safe name, extension, size and SHA-256."""
    name = safe_filename(F.element_at(F.split("filename", r"[/\\]"), -1))
    return files.withColumn("storage_name", name).withColumns({"extension": F.lower(F.regexp_extract("storage_name", r"(\.[^.]*)$", 1)), "size_bytes": F.length("content").cast("long"), "content_hash": F.sha2("content", 256)})


def integrity_violations(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """path, violation of declared assets that are missing or differ in size or hash (the first that fails)."""
    rows = declared.join(stored.select("path", F.col("size_bytes").alias("_size"), F.col("content_hash").alias("_hash")), "path", "left")
    what = F.when(F.col("_size").isNull(), F.lit("missing")).when(F.col("_size") != F.col("size_bytes"), F.lit("size_mismatch")).when(F.col("_hash") != F.col("content_hash"), F.lit("hash_mismatch"))
    return rows.withColumn("violation", what).where("violation is not null").drop("_size", "_hash")


def append_batch(rows: DataFrame, path: str, batch_id: str) -> None:
    """Append rows to a log under the id of their batch. A batch that is appended again replaces itself, so a repeated call
    adds nothing; other batches stay as they are."""
    log = rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    log.partitionBy("batch_id").json(path)


def read_ingest_log(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the log; blank lines are skipped."""
    return spark.read.schema(INGEST).json(path)


def newest_first(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows by creation time, the latest first; ties by id."""
    out = rows.orderBy(F.desc("created_at"), F.desc(rows.columns[0]))
    return out if limit is None else out.limit(limit)


def latest_per(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n latest rows of every key."""
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("version_id"))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def unknown_references(rows: DataFrame, id_column: str, known: DataFrame, known_column: str, array: bool = False) -> DataFrame:
    """Rows that refer to an id that is not known."""
    told = rows.withColumn("_id", F.explode(id_column)) if array else rows.withColumn("_id", F.col(id_column))
    return told.join(known.select(F.col(known_column).alias("_id")).distinct(), "_id", "left_anti").withColumnRenamed("_id", "unknown_id")


def upsert_versions(versions: DataFrame) -> DataFrame:
    """The last saved row of every version id (`ingest_seq` tells the order)."""
    return versions.withColumn("_n", F.row_number().over(Window.partitionBy("version_id").orderBy(F.desc("ingest_seq")))).where("_n = 1").drop("_n")


def latest_versions(versions: DataFrame, owner: str) -> DataFrame:
    """owner, latest_version_id: the version saved last for every project or request."""
    return versions.groupBy(owner).agg(F.max_by("version_id", "ingest_seq").alias("latest_version_id"))


def numbered(rows: DataFrame, prefix: str, order: Sequence[str], after: int = 0) -> DataFrame:
    """Rows with sequential ids after a previous highest number; a two-level rank, so no task holds all rows."""
    parts = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    return parts.join(sizes, "_p").withColumn("id", ids.sequence_id(prefix, F.col("_before") + F.col("_r") + after)).drop("_p", "_r", "_before")


def to_snapshot(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumn("snapshot_json", F.to_json(F.struct(*columns)))


def from_snapshot(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("_s", F.from_json("snapshot_json", schema)).select("*", "_s.*").drop("_s", "snapshot_json")


def request_assets(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """request_id, asset_seq, and the asset's columns, in the request's order."""
    return requests.select("request_id", F.posexplode("asset_ids").alias("asset_seq", "asset_id")).join(assets, "asset_id")


def write_artifacts(rows: DataFrame, path: str) -> None:
    """JSON artifacts by project and version: the versions that the rows belong to are replaced, all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "version_id").json(path)


def resolved_path(path: Column) -> Column:
    """An absolute path without empty and `.` segments, each `..` taking away the segment before it (none at the root)."""
    up = lambda stack: F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
    step = lambda stack, part: F.when(part.isin("", "."), stack).when(part == "..", up(stack)).otherwise(F.concat(stack, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def artifact(rows: DataFrame, name: str, files: DataFrame | None = None) -> DataFrame:
    """Artifacts of a name; `escapes` tells those whose resolved path lies outside their directory, and with `files` (path),
    `missing` those that are inside but no file."""
    found = rows.withColumn("a", F.explode("artifacts")).where(F.col("a.name") == name)
    found = found.withColumn("_at", resolved_path(F.col("a.path"))).withColumn("_in", resolved_path(F.col("artifact_dir")))
    # The root is the only directory that ends with a slash.
    below = (F.col("_at") == F.col("_in")) | F.startswith("_at", F.when(F.col("_in") == "/", F.lit("/")).otherwise(F.concat("_in", F.lit("/"))))
    found = found.withColumn("escapes", ~below).drop("_in")
    if files is None:
        return found.drop("_at")
    known = files.select(resolved_path(F.col("path")).alias("_at"), F.lit(True).alias("_there")).distinct()
    return found.join(known, "_at", "left").withColumn("missing", ~F.col("escapes") & F.col("_there").isNull()).drop("_at", "_there")


def relative_path(path: Column, root: str) -> Column:
    """The path below a folder, of a file that was found in it."""
    plain = re.sub(r"^\w+:(//[^/]*)?", "", root).rstrip("/")
    return F.regexp_replace(path, rf"^.*?\Q{plain}\E/+", "")


def stored_violations(spark: SparkSession, declared: DataFrame, path: str, relative: bool = False) -> DataFrame:
    """path, violation of declared files (path, size_bytes, content_hash) that are missing or differ. `path` is a
    file's name, or with `relative` its path below the folder, which tells files of one name apart.
    Sizes come from the listing alone; only files whose size agrees are read and hashed, row by row where they are found."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = relative_path(F.col("path"), path) if relative else F.regexp_extract("path", r"[^/]*$", 0)
    sizes = files.select(name.alias("path"), F.col("length").alias("_size"))
    listed = declared.join(sizes, "path", "left")
    alike = listed.where(F.col("_size") == F.col("size_bytes")).select("path").distinct()
    hashes = files.select(name.alias("path"), "content").join(alike, "path", "left_semi").select("path", F.sha2("content", 256).alias("_hash"))
    what = F.when(F.col("_size").isNull(), F.lit("missing")).when(F.col("_size") != F.col("size_bytes"), F.lit("size_mismatch")).when(F.col("_hash") != F.col("content_hash"), F.lit("hash_mismatch"))
    return listed.join(hashes, "path", "left").withColumn("violation", what).where("violation is not null").drop("_size", "_hash")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON configuration file as one row."""
    return spark.read.option("multiLine", "true").json(path)


def config_tree(spark: SparkSession, path: str) -> DataFrame:
    """A JSON configuration file as one variant, `config`: maps of any keys stay as they are."""
    return spark.read.option("wholetext", "true").text(path).select(F.parse_json("value").alias("config"))


def config_entries(tree: DataFrame, path: str) -> DataFrame:
    """key, value (variant) of a map in the configuration, one row an entry; none where there is no such map."""
    return tree.sparkSession.sql("SELECT e.key, e.value FROM {tree}, LATERAL variant_explode(try_variant_get(config, {path}, 'variant')) e", tree=tree, path=path)


def parse_record(entities: DataFrame, manifests: DataFrame) -> DataFrame:
    """bundle_id, record: component counts and manifests as nested JSON, built only for output."""
    counts = entities.groupBy("bundle_id", "component_type").agg(F.count("*").alias("n")).groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("component_type", "n"))).alias("components"))
    per = manifests.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("storey_key", "component_count", "duplicates"))).alias("storeys"))
    return counts.join(per, "bundle_id", "full_outer").select("bundle_id", F.to_json(F.struct("components", "storeys")).alias("record"))
