"""Components: types and confidences of entities, annotations bound to them, and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import first_case

# Component types of categories, their least confidence, words that annotate them.
COMPONENTS = {"wall_line": "wall", "wall_path": "wall", "door_block": "door", "window_block": "window", "room_boundary": "room", "room_label": "room"}
CONFIDENCE = {"wall": 0.72, "door": 0.6, "window": 0.6, "room": 0.55}
ANNOTATION_WORDS = {"wall": ("wall", "墙"), "door": ("door", "门"), "window": ("window", "窗"), "room": ("room", "房", "空间")}
LINE_CATEGORIES = {"wall": "wall_line", "site_boundary": "site_boundary_line", "facade": "facade_line"}
BLOCK_CATEGORIES = {"door": "door_block", "window": "window_block", "grid": "grid_marker"}


def _lookup(key: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def component_type(category: Column) -> Column:
    return _lookup(F.lower(category), COMPONENTS)


def component_candidates(entities: DataFrame) -> DataFrame:
    """Entities of a known component type, with component_type and at least the type's confidence."""
    rows = entities.withColumn("component_type", component_type(F.col("category"))).where("component_type is not null")
    return rows.withColumn("confidence", F.greatest("confidence", _lookup(F.col("component_type"), CONFIDENCE)))


def filter_by_confidence(entities: DataFrame, minimum: float) -> DataFrame:
    return entities.where(F.col("confidence") >= minimum)


def is_modeled(category: Column) -> Column:
    return category.rlike("wall|door|wind|room|space")


def canonical_category(category: Column, semantic_role: Column) -> Column:
    """Category of the model for any source category: as it is, by a word in it, else by the semantic role."""
    c, role = F.lower(F.trim(category)), F.lower(F.trim(semantic_role))
    has = lambda *words: F.lit(False) if not words else c.rlike("|".join(words))
    return first_case(
        [
            (c.isNull() | (c == ""), F.lit(None).cast("string")),
            (c.isin(*COMPONENTS), c),
            (has("wall") & has("line"), F.lit("wall_line")),
            (has("wall"), F.lit("wall_path")),
            (has("door"), F.lit("door_block")),
            (has("wind"), F.lit("window_block")),
            (has("room", "space") & has("label", "text"), F.lit("room_label")),
            (has("room", "space"), F.lit("room_boundary")),
            (role == "wall", F.lit("wall_path")),
            (role == "door", F.lit("door_block")),
            (role == "window", F.lit("window_block")),
            (role.isin("room", "space"), F.lit("room_boundary")),
        ]
    )


def modelable(category: Column, points: Column, bbox: Column, label: Column) -> Column:
    """Openings need a point, walls points or a box, room labels a box or a label."""
    some = F.coalesce(F.size(points) > 0, F.lit(False))
    return F.when(category.isin("door_block", "window_block"), some).when(category.isin("wall_line", "wall_path"), some | bbox.isNotNull()).when(category == "room_label", bbox.isNotNull() | F.coalesce(label != "", F.lit(False))).otherwise(category.isNotNull())


def classified(raw: DataFrame) -> DataFrame:
    """Drawing entities of raw ones (dxftype, layer, layer role, block name, points, closed): category and confidence by
    kind, role and closedness; kinds and roles that mean nothing in a model give no row."""
    kind, role, closed = F.col("dxftype"), F.col("role"), F.coalesce("closed", F.lit(False))
    line, poly, block = kind.isin("LINE", "XLINE", "RAY"), kind.isin("LWPOLYLINE", "POLYLINE"), kind == "INSERT"
    space = role.isin("room", "space")
    rules = [
        (line & (role == "wall"), "wall_line", 0.75),
        (line & (role == "site_boundary"), "site_boundary_line", 0.6),
        (line & (role == "facade"), "facade_line", 0.6),
        (poly & closed & space, "room_boundary", 0.82),
        (poly & closed & (role == "site_boundary"), "site_boundary", 0.8),
        (poly & (role == "wall"), "wall_path", 0.76),
        (poly & closed, "boundary_candidate", 0.45),
        (block & (F.col("block_role") == "door"), "door_block", 0.85),
        (block & (F.col("block_role") == "window"), "window_block", 0.85),
        (block & (F.col("block_role") == "grid"), "grid_marker", 0.6),
    ]
    found = first_case([(c, F.struct(F.lit(name).alias("category"), F.lit(confidence).alias("confidence"))) for c, name, confidence in rules])
    rows = raw.withColumn("_c", found).where("_c is not null")
    return rows.withColumns({"category": F.col("_c.category"), "confidence": F.col("_c.confidence"), "bbox": geometry.box_of_points(F.col("points"))}).drop("_c")


def largest_boundary(entities: DataFrame) -> DataFrame:
    """The largest unknown closed outline of every asset that has no site boundary; the first of equal ones."""
    asset = ["bundle_id", "asset_name"]
    area = geometry.box_area(F.col("bbox"))
    best = entities.where("category = 'boundary_candidate'").groupBy(*asset).agg(F.max_by("entity_seq", F.struct(area.alias("a"), (-F.col("entity_seq")).alias("s"))).alias("entity_seq"), F.max(area).alias("area"))
    return best.join(entities.where("category = 'site_boundary'").select(*asset).distinct(), asset, "left_anti")


def _annotating(texts: DataFrame) -> DataFrame:
    """Texts that hold a word of a component type, once for each such type."""
    low = F.lower("text")
    words = F.array(*(F.when(F.exists(F.array(*map(F.lit, w)), lambda x: F.contains(low, x)), F.lit(t)) for t, w in ANNOTATION_WORDS.items()))
    return texts.withColumn("component_type", F.explode(F.array_compact(words)))


def annotation_hits(texts: DataFrame) -> DataFrame:
    """bundle_id, component_type, notes: texts that hold a word of the type, in order. The list of a type is the same for
    all its entities, so it is made once a bundle instead of once an entity."""
    notes = F.transform(F.array_sort(F.collect_list(F.struct("text_seq", "text"))), lambda x: x["text"])
    return _annotating(texts).groupBy("bundle_id", "component_type").agg(notes.alias("annotation_notes"))


def annotation_totals(texts: DataFrame) -> DataFrame:
    """bundle_id, component_type, annotation_count, first_note: number of the texts that `annotation_hits` lists, and the
    first of them, without the lists."""
    rows = _annotating(texts).groupBy("bundle_id", "component_type")
    return rows.agg(F.count("*").alias("annotation_count"), F.min_by("text", "text_seq").alias("first_note"))


def _confidence(notes: Column) -> Column:
    return F.when(notes.isNotNull(), F.least(F.lit(1.0), notes * 0.1))


def bind_annotations(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates with the notes of their type and the confidence that these add. Every candidate carries the whole list:
    where number and first note will do, `bind_totals` costs no more than a row a candidate."""
    bound = candidates.join(annotation_hits(texts), ["bundle_id", "component_type"], "left")
    return bound.withColumn("annotation_confidence", _confidence(F.size("annotation_notes")))


def bind_totals(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates with number and first of the notes of their type and the confidence that the notes add."""
    bound = candidates.join(annotation_totals(texts), ["bundle_id", "component_type"], "left")
    return bound.withColumn("annotation_confidence", _confidence(F.col("annotation_count")))


#: What candidates may carry over to their entities.
BOUND = ("component_type", "annotation_notes", "annotation_count", "first_note", "annotation_confidence")


def merge_components(entities: DataFrame, bound: DataFrame) -> DataFrame:
    """Entities with what was recognised for their identity (asset, category, source reference, label); of several
    candidates of one identity the last counts, and the larger confidence stays."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    keys = {"_ref": blank("source_ref"), "_label": blank("label")}
    on = ["bundle_id", "asset_name", "category", *keys]
    told = [c for c in BOUND if c in bound.columns]
    last = F.max_by(F.struct(*told, F.col("confidence").alias("c")), "entity_seq").alias("_m")
    found = bound.withColumns(keys).groupBy(*on).agg(last)
    rows = entities.withColumns(keys).join(found, on, "left")
    return rows.withColumns({c: F.col(f"_m.{c}") for c in told} | {"confidence": F.greatest("confidence", "_m.c")}).drop("_m", *keys)


def room_labels(texts: DataFrame, columns: list[str]) -> DataFrame:
    """Entities made of room-label texts with a box, ready to be appended to entities with these columns."""
    rows = texts.where((F.col("semantic_tag") == "room_label") & F.col("bbox").isNotNull()).withColumns({"category": F.lit("room_label"), "label": F.col("text"), "confidence": F.lit(0.65), "points": F.expr("cast(array() as array<struct<x: double, y: double>>)"), "entity_seq": F.col("text_seq")})
    return rows.select("bundle_id", "asset_name", *(c for c in ("entity_seq", "category", "layer", "label", "bbox", "points", "source_ref", "confidence") if c in columns))


def provenance(entities: DataFrame) -> DataFrame:
    """Fragment and storey of every entity, with defaults for those that have none."""
    rows = entities.withColumn("storey_key", F.coalesce(F.nullif("storey_key", F.lit("")), F.nullif("fragment_storey_key", F.lit("")), F.lit("1F")))
    return rows.withColumns({"fragment_id": F.coalesce("fragment_id", F.concat("asset_name", F.lit("::fragment::unknown"))), "fragment_role": F.coalesce("fragment_role", F.lit("unknown")), "fragment_storey_key": F.coalesce("fragment_storey_key", "storey_key")})


def component_counts(entities: DataFrame) -> DataFrame:
    return entities.where("component_type is not null").groupBy("bundle_id", "component_type").agg(F.count("*").alias("components"))
