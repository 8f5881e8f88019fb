"""Bundle resolution: units, origin, north, floors and limits settled over all assets of a bundle, with conflict rows.

`first` always means the least ordinal column, never the order in which rows happen to arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import storeys, text

# The reference limits of listed rows, and the categories that carry geometry.
CAPS = {"grid_axes": 80, "dimensions": 120, "texts": 120, "pending_review": 80}
GEOMETRY = ("wall_line", "wall_path", "door_block", "window_block", "room_boundary")


def review(category: str, reason: Column, asset: Column, severity: str = "warning") -> list[Column]:
    return [asset.alias("asset_name"), F.lit(category).alias("category"), reason.alias("reason"), F.lit(severity).alias("severity")]


def first_wins(assets: DataFrame, value: str, keys: Sequence[str] = ("bundle_id",), seq: str = "asset_seq") -> DataFrame:
    """keys, value: the value of the first asset that has one."""
    return assets.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, seq).alias(value))


def unit_resolution(assets: DataFrame, locked: str | None = None) -> DataFrame:
    """bundle_id, units, conflicts: the first asset's units, or the form's (`locked` column) if it has any; conflicts counts
    later assets with other units."""
    form = F.max(locked) if locked else F.lit(None).cast("string")
    per = assets.groupBy("bundle_id").agg(F.min_by(F.when(F.col("units").isNotNull(), F.col("units")), F.when(F.col("units").isNotNull(), F.col("asset_seq"))).alias("seen"), form.alias("form"))
    chosen = per.select("bundle_id", F.coalesce("form", "seen").alias("units"))
    return chosen.join(assets.select("bundle_id", F.col("units").alias("own")), "bundle_id").groupBy("bundle_id", "units").agg(F.count_if(F.col("own") != F.col("units")).alias("conflicts"))


def unit_conflicts(assets: DataFrame, chosen: DataFrame) -> DataFrame:
    """A review row for every asset whose units are not the bundle's."""
    both = assets.select("bundle_id", "asset_name", F.col("units").alias("own")).join(chosen.select("bundle_id", "units"), "bundle_id").where("own <> units")
    return both.select("bundle_id", *review("unit_conflict", F.format_string("Detected unit '%s' conflicts with '%s'.", "own", "units"), F.col("asset_name")))


def origin_resolution(assets: DataFrame) -> DataFrame:
    """bundle_id, x, y, source: origins replace each other while the one before is a default; the first of another source
    stays, and without one the last default does."""
    fixed = F.col("source") != "default"
    o = F.struct("x", "y", "source")
    per = assets.groupBy("bundle_id").agg(F.min_by(F.when(fixed, o), F.when(fixed, F.col("asset_seq"))).alias("first"), F.max_by(o, "asset_seq").alias("last"))
    return per.select("bundle_id", F.coalesce("first", "last").alias("o")).select("bundle_id", "o.x", "o.y", "o.source")


def north_resolution(texts: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """bundle_id, north_angle, conflicts: within an asset the last text that tells an angle counts, within a bundle the
    first asset; other assets further off than `tolerance` are conflicts."""
    angled = texts.withColumn("angle", text.north_angle(F.col("text"))).where("angle is not null")
    per_asset = angled.groupBy("bundle_id", "asset_name", "asset_seq").agg(F.max_by("angle", "text_seq").alias("angle"))
    chosen = first_wins(per_asset, "angle").withColumnRenamed("angle", "north_angle")
    return per_asset.join(chosen, "bundle_id").groupBy("bundle_id", "north_angle").agg(F.count_if(F.abs(F.col("angle") - F.col("north_angle")) > tolerance).alias("conflicts"))


def dedupe_first(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")


def capped(rows: DataFrame, keys: Sequence[str], seq: str, limit: int) -> DataFrame:
    """At most `limit` rows of every group, the first ones; 0 or less keeps none."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where(F.col("_n") <= limit).drop("_n")


def layer_map(raw: DataFrame) -> DataFrame:
    """bundle_id, asset_name, layer, entity_count, entity_types, semantic_role of every layer."""
    per = raw.groupBy("bundle_id", "asset_name", "layer").agg(F.count("*").alias("entity_count"), F.array_sort(F.collect_set("dxftype")).alias("entity_types"))
    return per.withColumn("semantic_role", text.semantic_role(F.col("layer")))


def recognized_layers(table: DataFrame, used: DataFrame) -> DataFrame:
    """bundle_id, layers: distinct names of the layer table and of the layers in use, sorted."""
    both = table.select("bundle_id", "layer").unionByName(used.select("bundle_id", "layer"))
    return both.groupBy("bundle_id").agg(F.array_sort(F.collect_set("layer")).alias("layers"))


def entity_summary(raw: DataFrame, keys: Sequence[str] = ("bundle_id", "asset_name")) -> DataFrame:
    """Counts of lines, polylines, blocks, texts and dimensions."""
    kind = F.col("dxftype")
    groups = {"lines": ("LINE", "XLINE", "RAY"), "polylines": ("LWPOLYLINE", "POLYLINE"), "blocks": ("INSERT", "TCH_OPENING"), "texts": ("TEXT", "MTEXT", "TCH_TEXT"), "dimensions": ("DIMENSION",)}
    return raw.groupBy(*keys).agg(*(F.count_if(kind.isin(*names)).alias(name) for name, names in groups.items()))


def source_summary(entities: DataFrame) -> DataFrame:
    """Entities of every asset."""
    return entities.groupBy("bundle_id", "asset_name").agg(F.count("*").alias("entities"))


def bundle_flags(assets: DataFrame) -> DataFrame:
    """Whether any asset has a site boundary, and the number of space boundaries."""
    return assets.groupBy("bundle_id").agg(F.bool_or("site_boundary").alias("site_boundary_detected"), F.sum("space_boundaries").alias("space_boundaries_detected"))


def storey_elevations(texts: DataFrame) -> DataFrame:
    """bundle_id, elevations: distinct elevations in the texts, sorted."""
    rows = texts.select("bundle_id", F.explode(text.elevations(F.col("text"))).alias("e"))
    return rows.groupBy("bundle_id").agg(F.array_sort(F.collect_set("e")).alias("elevations"))


def asset_view_roles(assets: DataFrame, candidates: DataFrame) -> DataFrame:
    """bundle_id, asset_name, view_role: by name, else by the points of its candidates."""
    plan, section, facade = storeys.candidate_scores(F.col("name"))
    scores = candidates.groupBy("bundle_id", "asset_name").agg(F.sum(plan).alias("p"), F.sum(section).alias("s"), F.sum(facade).alias("f"))
    p, s, f = (F.coalesce(c, F.lit(0)) for c in ("p", "s", "f"))
    scored = F.when((p > 0) & (p >= F.greatest(s, f)), F.lit("plan")).when((s > f) & (s > 0), F.lit("section")).when(f > 0, F.lit("facade")).otherwise(F.lit("unknown"))
    named = assets.select("bundle_id", "asset_name").distinct().join(scores, ["bundle_id", "asset_name"], "left")
    return named.select("bundle_id", "asset_name", F.coalesce(storeys.view_role(F.col("asset_name")), scored).alias("view_role"))


def asset_storeys(fragments: DataFrame) -> DataFrame:
    """Lowest storey of every asset over its fragments that are no section or facade."""
    key = storeys.fragment_storey(F.col("storey_key"), F.col("fragment_title"), F.col("asset_name"))
    rows = fragments.where(~F.lower(F.coalesce("fragment_role", F.lit("unknown"))).isin("section", "facade")).withColumn("key", key)
    return rows.groupBy("bundle_id", "asset_name").agg(F.min_by("key", storeys.storey_order(F.col("key"))).alias("storey_key"))


def asset_storeys_unfragmented(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Storeys of assets without fragments: the name's, else the first candidate's, else the bundle's lowest (1F without
    any); a section or facade stays without one if the bundle tells several."""
    assets = entities.where(F.col("category").isin(*GEOMETRY)).select("bundle_id", "asset_name").union(candidates.select("bundle_id", "asset_name")).distinct()
    named = candidates.withColumn("key", storeys.storey_key(F.col("name"))).where("key is not null").groupBy("bundle_id", "asset_name").agg(F.min_by("key", "cand_seq").alias("named"))
    rows = assets.join(named, ["bundle_id", "asset_name"], "left").join(asset_view_roles(assets, candidates), ["bundle_id", "asset_name"], "left")
    rows = rows.withColumn("own", F.coalesce(storeys.storey_key(F.col("asset_name")), "named"))
    low = rows.where("own is not null").groupBy("bundle_id").agg(F.min_by("own", storeys.storey_order(F.col("own"))).alias("lowest"), F.count_distinct("own").alias("several"))
    out = rows.join(low, "bundle_id", "left").where(F.col("own").isNotNull() | ~(F.col("view_role").isin("section", "facade") & (F.coalesce("several", F.lit(0)) > 1)))
    return out.select("bundle_id", "asset_name", F.coalesce("own", "lowest", F.lit("1F")).alias("storey_key"))


def floor_count(fragments: DataFrame) -> DataFrame:
    """Distinct storeys of the fragments that are no section or facade."""
    key = storeys.fragment_storey(F.col("storey_key"), F.col("fragment_title"), F.col("asset_name"))
    rows = fragments.where(~F.lower(F.coalesce("fragment_role", F.lit("unknown"))).isin("section", "facade"))
    return rows.groupBy("bundle_id").agg(F.count_distinct(key).alias("floors"))


def fragment_storeys(fragments: DataFrame, unfragmented: DataFrame) -> DataFrame:
    """fragment_id, storey_key: of every fragment, or of one numbered default fragment an asset in bundles without any."""
    own = fragments.select("bundle_id", "fragment_id", storeys.fragment_storey(F.col("storey_key"), F.col("fragment_title"), F.col("asset_name")).alias("storey_key"))
    n = F.row_number().over(Window.partitionBy("bundle_id").orderBy("asset_name"))
    default = unfragmented.join(fragments.select("bundle_id").distinct(), "bundle_id", "left_anti").withColumn("fragment_id", F.format_string("%s::fragment::default::%02d", "asset_name", n))
    return own.unionByName(default.select("bundle_id", "fragment_id", "storey_key"))


def bundles_without_assets(bundles: DataFrame, assets: DataFrame) -> DataFrame:
    """One unresolved row for every bundle that has no asset."""
    return bundles.join(assets.select("bundle_id").distinct(), "bundle_id", "left_anti").select("bundle_id", F.lit("assets_missing").alias("category"))


def pdf_page_mode(texts: Column, drawings: Column, images: Column) -> Column:
    drawn = (drawings > 0) | (texts > 0)
    return F.when((images > 0) & ~drawn, F.lit("scanned")).when((images > 0) & drawn, F.lit("hybrid")).when(drawn, F.lit("vector")).otherwise(F.lit("unknown"))


def pdf_modes(pages: DataFrame) -> DataFrame:
    """Pages by mode and mode of every document: that of its pages if they agree, else hybrid."""
    mode = pdf_page_mode(F.col("text_count"), F.col("drawing_count"), F.col("image_count"))
    per = pages.withColumn("mode", mode).groupBy("bundle_id", "asset_name").agg(F.count("*").alias("page_count"), F.min("mode").alias("low"), F.max("mode").alias("high"), *(F.count_if(F.col("mode") == m).alias(f"{m}_page_count") for m in ("vector", "scanned", "hybrid")))
    return per.withColumn("pdf_type", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit("hybrid"))).drop("low", "high")
