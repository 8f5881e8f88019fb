"""Assembly over storeys: manifests, duplicates, chains that repeat across storeys, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, storeys

#: Storeys from which a bundle without chains is worth a review.
CHAIN_STOREYS = 2


def anchored(entities: DataFrame) -> DataFrame:
    """Entities with their anchor `at` and box `own`."""
    return entities.withColumns({"at": geometry.anchor(F.col("points"), F.col("bbox")), "own": geometry.entity_box(F.col("points"), F.col("bbox"))})


def duplicates(entities: DataFrame) -> DataFrame:
    """Components of one storey with equal asset, type and rounded anchor: one row for each set, with its size."""
    at = lambda c: geometry.round3(F.col(f"at.{c}")).alias(c)
    return anchored(entities).groupBy("bundle_id", "storey_key", "asset_name", "component_type", at("x"), at("y")).agg(F.count("*").alias("copies")).where("copies > 1")


def manifests(entities: DataFrame) -> DataFrame:
    """Component count, duplicate sets and box of every storey. Components with equal signature are summed up first, so
    duplicates and boxes come out of one grouping."""
    at = lambda c: geometry.round3(F.col(f"at.{c}")).alias(c)
    edges = [f(f"own.{c}").alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))]
    sets = anchored(entities).groupBy("bundle_id", "storey_key", "asset_name", "component_type", at("x"), at("y")).agg(F.count("*").alias("n"), *edges)
    return sets.groupBy("bundle_id", "storey_key").agg(F.sum("n").alias("component_count"), F.count_if(F.col("n") > 1).alias("duplicates"), *(f(c).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))))


def chains(entities: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Components of one type whose anchors fall into one bucket on two storeys or more: storeys in order, mean anchor."""
    bucket = lambda c: F.rint(F.col(f"at.{c}") / tolerance).cast("long").alias(f"{c}_bucket")
    per = anchored(entities).where("at is not null").groupBy("bundle_id", "component_type", bucket("x"), bucket("y")).agg(F.collect_set("storey_key").alias("keys"), F.avg("at.x").alias("x"), F.avg("at.y").alias("y"), F.count("*").alias("members")).where(F.size("keys") > 1)
    ordered = F.transform(F.array_sort(F.transform("keys", lambda k: F.struct(storeys.storey_order(k).alias("o"), k.alias("k")))), lambda s: s["k"])
    return per.withColumn("storeys", ordered).withColumn("signature", F.concat("component_type", F.lit(":"), F.array_join("storeys", ";"))).drop("keys")


def grid_signature(axes: DataFrame, unknown: str | None = None) -> DataFrame:
    """Sorted distinct label@coordinate of a bundle's axes. Without a coordinate the label stands alone, or with `unknown`
    in its place."""
    label = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("label", "layer", "orientation")))
    coordinate = F.when(F.col("coordinate").isNotNull(), F.format_string("%.3f", "coordinate")).otherwise(F.lit(unknown))
    return axes.groupBy("bundle_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("@", label, coordinate))), "|").alias("grid_signature"))


def storeys_with_fragments(counts: DataFrame, fragments: DataFrame) -> DataFrame:
    """Storeys of components or fragments; those of fragments alone count no component."""
    told = fragments.where(~F.col("fragment_role").isin("section", "facade")).select("bundle_id", "storey_key").distinct()
    return counts.join(told, ["bundle_id", "storey_key"], "full_outer").select("bundle_id", "storey_key", F.coalesce("component_count", F.lit(0)).alias("component_count"))


def missing_storeys(fragments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Storeys that fragments tell and no manifest has."""
    told = fragments.where(~F.col("fragment_role").isin("section", "facade")).select("bundle_id", "storey_key").distinct()
    return told.join(manifest.select("bundle_id", "storey_key"), ["bundle_id", "storey_key"], "left_anti")


def parser_validation(bundles: DataFrame, manifest: DataFrame, chain: DataFrame, missing: DataFrame, axes: DataFrame) -> DataFrame:
    """bundle_id, category, severity, n of every one of `bundles`, components or not: missing storeys block; duplicates,
    several storeys without a chain and missing axes are for review."""
    per = manifest.groupBy("bundle_id").agg(F.count("*").alias("storeys"), F.sum("duplicates").alias("duplicates"))
    per = bundles.select("bundle_id").distinct().join(per, "bundle_id", "left").join(chain.groupBy("bundle_id").agg(F.count("*").alias("chains")), "bundle_id", "left").join(missing.groupBy("bundle_id").agg(F.count("*").alias("missing")), "bundle_id", "left").join(axes.groupBy("bundle_id").agg(F.count("*").alias("axes")), "bundle_id", "left").na.fill(0)
    issue = lambda when, category, severity, n: F.when(when, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), n.cast("long").alias("n")))
    rules = [
        issue(F.col("missing") > 0, "storey_missing", "error", F.col("missing")),
        issue(F.col("duplicates") > 0, "duplicate_component", "warning", F.col("duplicates")),
        issue((F.col("storeys") >= CHAIN_STOREYS) & (F.col("chains") == 0), "cross_layer_alignment", "warning", F.col("storeys")),
        issue(F.col("axes") == 0, "grid_missing", "warning", F.lit(0)),
    ]
    return per.select("bundle_id", F.explode(F.array_compact(F.array(*rules))).alias("i")).select("bundle_id", "i.*")


def ready(issues: DataFrame) -> Column:
    """Whether a bundle's issues leave it ready."""
    return ~F.bool_or(F.col("severity") == "error")


def storey_report(entities: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Manifests with the number of chains that pass each storey."""
    passing = chains(entities, tolerance).select("bundle_id", F.explode("storeys").alias("storey_key")).groupBy("bundle_id", "storey_key").agg(F.count("*").alias("chains"))
    return manifests(entities).join(passing, ["bundle_id", "storey_key"], "left").withColumn("chains", F.coalesce("chains", F.lit(0)))
