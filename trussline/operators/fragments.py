"""Plan fragments: titled regions of a drawing, their boxes, and the entities in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, storeys, text
from .resolution import GEOMETRY, dedupe_first, review

#: Padding of a cluster's box: this share of its extent, and this length at least.
PADDING, LEAST_PADDING = 0.05, 100.0


def fragment_list(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fragments of assets with geometry: one for each title and storey its candidates name, in storey order and numbered;
    one by the asset's own name if they name none."""
    assets = entities.where(F.col("category").isin(*GEOMETRY)).select("bundle_id", "asset_name").distinct()
    named = candidates.withColumn("storey_key", storeys.storey_key(F.col("name"))).where("storey_key is not null")
    named = dedupe_first(named, ["bundle_id", "asset_name", "name", "storey_key"], "cand_seq")
    rows = assets.join(named.select("bundle_id", "asset_name", F.col("name").alias("title"), "storey_key", "source", "bbox"), ["bundle_id", "asset_name"], "left")
    rows = rows.withColumns({"storey_key": F.coalesce("storey_key", storeys.storey_key(F.col("asset_name")), F.lit("1F")), "source": F.coalesce("source", F.lit("asset_fallback")), "title": F.coalesce("title", "asset_name")})
    # The sort key is a column of its own, so the sort's code stays small.
    order = Window.partitionBy("bundle_id", "asset_name").orderBy("_order", "title")
    rows = rows.withColumn("_order", storeys.storey_order(F.col("storey_key"))).withColumn("frag_seq", F.row_number().over(order))
    return rows.select(
        "bundle_id", "asset_name", "frag_seq", F.format_string("%s::fragment::%s::%02d", "asset_name", "storey_key", "frag_seq").alias("fragment_id"), F.col("title").alias("fragment_title"), storeys.fragment_role(F.col("title")).alias("fragment_role"), "storey_key", "source", "bbox"
    )


def title_boxes(fragments: DataFrame, texts: DataFrame) -> DataFrame:
    """Fragments without a box get that of the first view marker with their title."""
    marks = texts.where((F.col("semantic_tag") == "view_marker") & F.col("bbox").isNotNull()).withColumn("key", text.normalize_text(F.col("text")))
    marks = dedupe_first(marks, ["bundle_id", "asset_name", "key"], "text_seq").select("bundle_id", "asset_name", "key", F.col("bbox").alias("_box"))
    keyed = fragments.withColumn("key", text.normalize_text(F.col("fragment_title")))
    return keyed.join(marks, ["bundle_id", "asset_name", "key"], "left").withColumn("bbox", F.coalesce("bbox", "_box")).drop("key", "_box")


def gap_clusters(fragments: DataFrame, entities: DataFrame) -> DataFrame:
    """Boxes of plan fragments from the geometry: along the axis on which the fragments spread most, entities are cut at
    the largest gaps into as many groups as there are fragments, matched in order.

    Returns bundle_id, asset_name, fragment_id, bbox for the assets where that can be done: several plan fragments, all
    with a box, and at least as many entities."""
    asset = ["bundle_id", "asset_name"]
    plans = fragments.where("fragment_role = 'plan'").withColumn("mid", geometry.box_middle(F.col("bbox")))
    spread = lambda c: F.max(f"mid.{c}") - F.min(f"mid.{c}")
    ready = plans.groupBy(*asset).agg(F.count("*").alias("_k"), F.count("bbox").alias("boxed"), (spread("x") >= spread("y")).alias("_by_x")).where("_k > 1 and boxed = _k").drop("boxed")
    along = lambda p: F.when(F.col("_by_x"), F.col(f"{p}.x")).otherwise(F.col(f"{p}.y"))
    titled = plans.join(ready, asset).withColumn("place", F.row_number().over(Window.partitionBy(*asset).orderBy(along("mid"), "frag_seq")))
    items = entities.where(F.col("category").isin(*GEOMETRY)).withColumns({"at": geometry.rounded_point(geometry.anchor(F.col("points"), F.col("bbox"))), "own": geometry.entity_box(F.col("points"), F.col("bbox"))}).where("at is not null and own is not null")
    by_asset = Window.partitionBy(*asset)
    line = by_asset.orderBy("v", "entity_seq")
    items = items.join(ready, asset).withColumn("v", along("at")).withColumn("n", F.count("*").over(by_asset)).where("n >= _k")
    items = items.withColumn("i", F.row_number().over(line)).withColumn("gap", F.lead("v").over(line) - F.col("v"))
    cut = F.row_number().over(by_asset.orderBy(F.desc_nulls_last("gap"), F.desc("i"))) < F.col("_k")
    items = items.withColumn("cut", cut.cast("int")).withColumn("place", F.coalesce(F.sum("cut").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    groups = items.groupBy(*asset, "place").agg(*(f(f"own.{c}").alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))))
    pad = lambda a, b: F.greatest(F.greatest(F.col(b) - F.col(a), F.lit(1.0)) * PADDING, F.lit(LEAST_PADDING))
    px, py = pad("min_x", "max_x"), pad("min_y", "max_y")
    boxed = geometry.box(*(geometry.round3(c) for c in (F.col("min_x") - px, F.col("min_y") - py, F.col("max_x") + px, F.col("max_y") + py)))
    return titled.drop("bbox").join(groups.withColumn("bbox", boxed), [*asset, "place"]).select(*asset, "fragment_id", "bbox")


def with_boxes(fragments: DataFrame, boxes: DataFrame) -> DataFrame:
    return fragments.join(boxes.withColumnRenamed("bbox", "_box"), ["bundle_id", "asset_name", "fragment_id"], "left").withColumn("bbox", F.coalesce("_box", "bbox")).drop("_box")


def assign_fragments(entities: DataFrame, fragments: DataFrame) -> DataFrame:
    """Each entity's fragment within its asset: the first whose box holds its anchor, else the one with the nearest middle,
    else the first. Entities that have a fragment_id, or whose asset has no fragment, stay as they are.

    An asset's fragments are gathered into one array (they are few), so each entity meets them in its own row: one join on
    the asset and no product of rows, whatever the number of entities."""
    asset = ["bundle_id", "asset_name"]
    lists = fragments.groupBy(*asset).agg(F.array_sort(F.collect_list(F.struct("frag_seq", "fragment_id", "fragment_title", "fragment_role", "storey_key", "bbox"))).alias("_all"))
    at = geometry.rounded_point(geometry.anchor(F.col("points"), F.col("bbox")))

    def rank(f: Column) -> Column:
        b, p = f["bbox"], F.col("_at")
        inside = F.coalesce((b["min_x"] <= p["x"]) & (p["x"] <= b["max_x"]) & (b["min_y"] <= p["y"]) & (p["y"] <= b["max_y"]), F.lit(False))
        mid = geometry.box_middle(b)
        far = F.coalesce(geometry.distance(p["x"], p["y"], mid["x"], mid["y"]), F.lit(float("inf")))
        return F.struct(F.when(inside, F.lit(0)).otherwise(F.lit(1)).alias("away"), F.when(inside | p.isNull(), F.lit(0.0)).otherwise(far).alias("far"), f["frag_seq"].alias("seq"), f.alias("f"))

    rows = entities.join(lists, asset, "left").withColumn("_at", at)
    best = F.array_min(F.transform("_all", lambda f: rank(f).withField("f", F.struct(f["fragment_id"].alias("id"), f["fragment_title"].alias("title"), f["fragment_role"].alias("role"), f["storey_key"].alias("key")))))
    rows = rows.withColumn("_best", best)
    keep = F.col("fragment_id").isNotNull() if "fragment_id" in entities.columns else F.lit(False)
    out = {"fragment_id": "id", "fragment_title": "title", "fragment_role": "role", "fragment_storey_key": "key"}
    for name, field in out.items():
        own = F.col(name) if name in entities.columns else F.lit(None).cast("string")
        rows = rows.withColumn(f"_{name}", F.when(keep, own).otherwise(F.col(f"_best.f.{field}")))
    return rows.select(*(c for c in entities.columns if c not in out), *(F.col(f"_{n}").alias(n) for n in out))


def collapsed_storeys(fragments: DataFrame, entities: DataFrame) -> DataFrame:
    """Review rows for assets whose fragments name several storeys while their geometry lies in too few."""
    asset = ["bundle_id", "asset_name"]
    told = fragments.where(~F.col("fragment_role").isin("section", "facade")).groupBy(*asset).agg(F.count_distinct("storey_key").alias("told"))
    held = entities.where(F.col("category").isin(*GEOMETRY)).groupBy(*asset).agg(F.count_distinct("fragment_storey_key").alias("held"))
    rows = told.where("told > 1").join(held, asset, "left").where(F.coalesce("held", F.lit(0)) < F.least(F.lit(2), F.col("told")))
    return rows.select("bundle_id", *review("multi_storey_asset_collapsed", F.format_string("%d storeys named, geometry in %d.", "told", F.coalesce("held", F.lit(0))), F.col("asset_name")))


def truncated_entities(bundles: DataFrame) -> DataFrame:
    """Review rows for bundles whose entities were dropped by limits (column `dropped`)."""
    return bundles.where("dropped > 0").select("bundle_id", *review("entity_detection_truncated", F.format_string("%d detected entities were dropped.", "dropped"), F.lit(None).cast("string")))
