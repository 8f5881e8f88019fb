"""What a bundle's assets say taken together: its lists, in asset order and under their limits, and its parse record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import storeys
from . import assembly
from .resolution import CAPS

#: Lists that name a value once, at its first place.
ONCE = ("texts", "storey_candidates", "unresolved", "pdf_modes")


def list_items(rows: DataFrame, name: str, value: Column, seq: str) -> DataFrame:
    """Rows of one list, as `bundle_lists` takes them; null values are no items."""
    items = rows.select("bundle_id", F.lit(name).alias("list"), "asset_seq", F.col(seq).cast("long").alias("item_seq"), value.cast("string").alias("value"))
    return items.where(F.col("value").isNotNull())


def bundle_lists(items: DataFrame) -> DataFrame:
    """bundle_id, list, asset_seq, item_seq, value, place: all assets' lists joined in asset order. Lists of ONCE keep a
    value's first place, lists of CAPS their first items with the place in the bundle; the others are whole and have none
    (their order is asset_seq, item_seq).

    A limit of up to 1,000 is applied before the exchange too: a task passes on no more items of a list than its limit, so
    what is exchanged and sorted for a bundle is bounded by tasks times limit, whatever it holds."""
    key, at = ["bundle_id", "list"], ["asset_seq", "item_seq"]
    once = items.where(F.col("list").isin(*ONCE)).groupBy(*key, "value").agg(F.min(F.struct(*at)).alias("_at"))
    rows = items.where(~F.col("list").isin(*ONCE)).unionByName(once.select(*key, "_at.*", "value"))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*at, "value"))
    whole = rows.where(~F.col("list").isin(*CAPS)).withColumn("place", F.lit(None).cast("int"))
    for limit in sorted(set(CAPS.values())):
        names = [name for name, most in CAPS.items() if most == limit]
        whole = whole.unionByName(rows.where(F.col("list").isin(*names)).withColumn("place", n).where(F.col("place") <= limit))
    return whole


def parse_analysis(entities: DataFrame, fragments: DataFrame, axes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """bundle_id and the nested parts of its parse record: components (type, n), room_labels, storeys (manifests), duplicates
    (signatures), chains, ready, component_count, storey_keys, grid_signature, cross_layer_ready, need_review and blocked (category, severity,
    n). All parts are one union, grouped once by bundle; a part's rows are already grouped by storey, type and place, so a
    record holds what a bundle tells, not its entities. Bundles without any entity, fragment or axis have no record."""
    m, c = assembly.manifests(entities), assembly.chains(entities, tolerance)
    d, g = assembly.duplicates(entities), assembly.grid_signature(axes)
    bundles = entities.select("bundle_id").unionByName(fragments.select("bundle_id")).unionByName(axes.select("bundle_id"))
    found = assembly.parser_validation(bundles, m, c, assembly.missing_storeys(fragments, m), axes)
    counts = entities.groupBy("bundle_id", "component_type").agg(F.count("*").alias("n"))
    parts = {
        "components": (counts, ("component_type", "n")),
        "storeys": (m, ("storey_key", "component_count", "duplicates", "min_x", "min_y", "max_x", "max_y")),
        "duplicates": (d, ("storey_key", "asset_name", "component_type", "x", "y", "copies")),
        "chains": (c, ("signature", "x", "y", "members")),
        "issues": (found, ("category", "severity", "n")),
        "grid": (g, ("grid_signature",)),
    }
    rows = None
    for name, (part, columns) in parts.items():
        tagged = part.select("bundle_id", F.struct(*columns).alias(name))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    listed = [F.array_sort(F.collect_list(name)).alias(name) for name in parts if name != "grid"]
    per = rows.groupBy("bundle_id").agg(*listed, F.max("grid.grid_signature").alias("grid_signature"))
    sharp = lambda i: i["severity"] == "error"
    of = lambda kind: F.coalesce(F.get(F.filter("components", lambda p: p["component_type"] == kind)["n"], 0), F.lit(0))
    ordered = lambda s: F.struct(storeys.storey_order(s["storey_key"]).alias("o"), s["storey_key"].alias("k"))
    blocked, review = F.filter("issues", sharp), F.filter("issues", lambda i: ~sharp(i))
    told = {
        "blocked": blocked,
        "need_review": review,
        "ready": F.size(blocked) == 0,
        "component_count": F.aggregate("components", F.lit(0).cast("long"), lambda s, p: s + p["n"]),
        "cross_layer_ready": F.size("chains") > 0,
        "storey_keys": F.transform(F.array_sort(F.transform("storeys", ordered)), lambda s: s["k"]),
        "room_labels": of("room_label"),
    }
    return per.withColumns(told).drop("issues")


def parse_json(record: DataFrame) -> DataFrame:
    """bundle_id, record: the record as one JSON text, for output."""
    return record.select("bundle_id", F.to_json(F.struct(*(c for c in record.columns if c != "bundle_id"))).alias("record"))
