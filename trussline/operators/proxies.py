"""Vendor objects and proxies: walls, openings and columns from tags, and stand-ins where no geometry can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text

# Most stand-ins of an asset, least walls where there are openings.
MOST_WALLS, MOST_OPENINGS, LEAST_WALLS = 120, 120, 4
#: How far a wall may lean and still count as vertical or horizontal.
LEAN = 1e-3
ASSET = ["bundle_id", "asset_name"]


def tag(tags: Column, code: int, n: int = 0) -> Column:
    """The n-th value of a tag code of an entity; null without one."""
    return F.get(F.try_element_at(tags, F.lit(code)), n)


def tag_number(tags: Column, code: int, n: int = 0) -> Column:
    return tag(tags, code, n).try_cast("double")


def vendor_walls(raw: DataFrame) -> DataFrame:
    """Walls of TCH_WALL entities whose vector (tag 300) can be read: a segment, or an anchor where both its ends are one
    place; and the width."""
    rows = raw.where("dxftype = 'TCH_WALL'").withColumn("v", text.wall_vector(tag(F.col("xtags"), 300))).where("v is not null")
    at = lambda n: geometry.point(geometry.round3(F.col(f"v.x{n}")), geometry.round3(F.col(f"v.y{n}")))
    one = (F.abs(F.col("v.x1") - F.col("v.x2")) <= LEAN) & (F.abs(F.col("v.y1") - F.col("v.y2")) <= LEAN)
    rows = rows.withColumns({"start": F.when(~one, at(1)), "end": F.when(~one, at(2)), "anchor": F.when(one, at(1)), "vendor_width": tag_number(F.col("xtags"), 42)})
    return rows.select(*ASSET, "entity_seq", "layer", "start", "end", "anchor", "vendor_width")


def vendor_wall_entities(walls: DataFrame) -> DataFrame:
    """Entities of vendor walls: every segment with its width, and the walls between the nodes on one vertical, which tell
    how they came about by their reference."""
    columns = (*ASSET, "category", "layer", "points", "bbox", "source_ref", "confidence", "vendor_width")

    def entity(rows: DataFrame, layer: Column, ref: Column, confidence: float, width: Column, ends: Column) -> DataFrame:
        told = {"category": F.lit("wall_line"), "layer": layer, "points": ends, "bbox": geometry.box_of_points(ends), "source_ref": ref, "confidence": F.lit(confidence), "vendor_width": width.cast("double")}
        return rows.withColumns(told).select(*columns)

    ref = F.col("source_ref") if "source_ref" in walls.columns else F.lit(None).cast("string")
    drawn = entity(walls.where("start is not null and start <> end"), F.col("layer"), ref, 0.84, F.col("vendor_width"), F.array("start", "end"))
    name = F.format_string("tch-wall-vertical:%s:%d", F.col("x").cast("string"), "part")
    made = entity(vertical_walls(walls), F.lit("WALL"), name, 0.72, F.lit(None), F.array(geometry.point(F.col("x"), F.col("y1")), geometry.point(F.col("x"), F.col("y2"))))
    return drawn.unionByName(made)


def vendor_openings(raw: DataFrame) -> DataFrame:
    """Openings with up to two points, width, height and parents' handles."""
    x = F.col("xtags")
    at = lambda c: F.when(tag_number(x, c).isNotNull() & tag_number(x, c + 10).isNotNull(), geometry.point(tag_number(x, c), tag_number(x, c + 10)))
    rows = raw.where("dxftype = 'TCH_OPENING'").withColumn("points", F.array_compact(F.array(at(10), at(11)))).where(F.size("points") > 0)
    category = text.opening_category([tag(x, 1), tag(x, 2), tag(x, 7)], F.col("layer"), text.semantic_role(F.col("layer")))
    return rows.select(*ASSET, "entity_seq", "layer", category.alias("category"), "points", tag_number(x, 40).alias("vendor_width"), tag_number(x, 41).alias("vendor_height"), F.coalesce(F.try_element_at(x, F.lit(330)), F.array().cast("array<string>")).alias("parents"))


def vendor_columns(raw: DataFrame) -> DataFrame:
    """Column outlines of two points or more, as entities."""
    xs, ys = (F.coalesce(F.try_element_at("xtags", F.lit(c)), F.array().cast("array<string>")) for c in (10, 20))
    points = F.zip_with(xs, ys, lambda a, b: geometry.point(a.try_cast("double"), b.try_cast("double")))
    return raw.where("dxftype = 'TCH_COLUMN'").withColumn("points", F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())).where(F.size("points") >= 2).select(*ASSET, "entity_seq", "layer", F.lit("column_path").alias("category"), "points", geometry.box_of_points(F.col("points")).alias("bbox"), F.lit(0.8).alias("confidence"))


def vertical_walls(walls: DataFrame) -> DataFrame:
    """Walls between consecutive distinct heights of the nodes on one vertical: bundle_id, asset_name, x, y1, y2, part."""
    s, e = F.col("start"), F.col("end")
    upright, level = F.abs(s["x"] - e["x"]) <= LEAN, F.abs(s["y"] - e["y"]) <= LEAN
    node = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    nodes = F.when(s.isNull(), F.when(F.col("anchor").isNotNull(), F.array(node(F.col("anchor.x"), F.col("anchor.y")))).otherwise(none)).when(upright, F.array(node(s["x"], s["y"]), node(s["x"], e["y"]))).when(level, F.array(node(s["x"], s["y"]), node(e["x"], e["y"]))).otherwise(none)
    rows = walls.select(*ASSET, F.explode(nodes).alias("n")).select(*ASSET, "n.x", "n.y").distinct()
    line = Window.partitionBy(*ASSET, "x").orderBy("y")
    return rows.withColumns({"y2": F.lead("y").over(line), "part": F.row_number().over(line)}).where("y2 is not null").select(*ASSET, "x", F.col("y").alias("y1"), "y2", "part")


def proxy_counts(raw: DataFrame) -> DataFrame:
    """Proxies by role and layer, and how many have geometry."""
    role = text.semantic_role(F.col("layer"))
    rows = raw.where("dxftype = 'ACAD_PROXY_ENTITY'").withColumn("role", F.when(role.isin("room", "space"), F.lit("room")).otherwise(role))
    return rows.groupBy(*ASSET, "role", "layer").agg(F.count("*").alias("proxies"), F.count_if("with_geometry").alias("with_geometry"), F.min("entity_seq").alias("first_seen"))


def proxy_children(children: DataFrame) -> DataFrame:
    """Entities of the parts of proxies: own layer's role, else the parent's; a lower confidence than drawn ones."""
    own = text.semantic_role(F.col("layer"))
    role = F.when(own == "unknown", F.col("parent_role")).otherwise(own)
    category = F.when(role == "wall", F.when(F.size("points") == 2, F.lit("wall_line")).otherwise(F.lit("wall_path"))).when(role == "door", F.lit("door_block")).when(role == "window", F.lit("window_block")).when(role.isin("room", "space") & F.col("closed"), F.lit("room_boundary"))
    return children.withColumn("category", category).where("category is not null").withColumns({"confidence": F.lit(0.6), "bbox": geometry.box_of_points(F.col("points"))})


def fallback_entities(counts: DataFrame, segments: DataFrame) -> DataFrame:
    """Stand-ins along known lines: as many walls, doors and windows as there are proxies (within limits, four walls at
    least where there are openings), the i-th on the i-th line, round and round. Lines of wall proxies' layers come first,
    by count; any other lines serve only where there are none."""
    per = counts.groupBy(*ASSET).agg(*(F.sum(F.when(F.col("role") == r, F.col("proxies")).otherwise(0)).alias(r) for r in ("wall", "door", "window"))).where("wall + door + window > 0")
    ranked = counts.where("role = 'wall'").withColumn("place", F.row_number().over(Window.partitionBy(*ASSET).orderBy(F.desc("proxies"), "first_seen"))).select(*ASSET, "layer", "place")
    pool = segments.join(ranked, [*ASSET, "layer"], "left").withColumn("own", F.max(F.col("place").isNotNull()).over(Window.partitionBy(*ASSET))).where("place is not null or not own")
    pool = pool.withColumn("i", F.row_number().over(Window.partitionBy(*ASSET).orderBy(F.col("place").asc_nulls_last(), "seq")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*ASSET)))
    walls = F.least(F.greatest("wall", F.when(F.col("door") + F.col("window") > 0, F.lit(LEAST_WALLS)).otherwise(F.lit(0))), F.lit(MOST_WALLS))
    told = F.array(*(F.struct(F.lit(c).alias("category"), n.cast("int").alias("m")) for c, n in (("wall_line", walls), ("door_block", F.least("door", F.lit(MOST_OPENINGS))), ("window_block", F.least("window", F.lit(MOST_OPENINGS))))))
    wanted = per.select(*ASSET, F.explode(told).alias("t")).where("t.m > 0").select(*ASSET, F.col("t.category").alias("category"), F.explode(F.sequence(F.lit(0), F.col("t.m") - 1)).alias("number"))
    sizes = pool.select(*ASSET, "n").distinct()
    rows = wanted.join(sizes, ASSET).withColumn("i", F.pmod("number", "n").cast("int")).join(pool.select(*ASSET, "i", "x1", "y1", "x2", "y2"), [*ASSET, "i"])
    a, b = geometry.point(F.col("x1"), F.col("y1")), geometry.point(F.col("x2"), F.col("y2"))
    wall = F.col("category") == "wall_line"
    return rows.select(*ASSET, "category", "number", F.when(wall, F.array(a, b)).otherwise(F.array(geometry.middle(a, b))).alias("points"), F.when(wall, F.lit(0.45)).otherwise(F.lit(0.42)).alias("confidence"))


def proxy_footprint(entities: DataFrame, extents: DataFrame) -> DataFrame:
    """Box for stand-ins: the largest boundary of an asset, else its header's extents if they are finite and not empty."""
    area = geometry.box_area(F.col("bbox"))
    own = entities.where(F.col("category").isin("site_boundary", "boundary_candidate", "room_boundary")).groupBy(*ASSET).agg(F.max_by("bbox", F.struct(area.alias("a"), (-F.col("entity_seq")).alias("s"))).alias("own"))
    sound = F.col("extents").isNotNull() & (F.abs(F.col("extents.min_x")) < 1e19) & (F.abs(F.col("extents.max_x")) < 1e19) & (F.col("extents.max_x") > F.col("extents.min_x")) & (F.col("extents.max_y") > F.col("extents.min_y"))
    rows = extents.join(own, ASSET, "full_outer")
    return rows.select(*ASSET, F.coalesce("own", F.when(sound, F.col("extents"))).alias("bbox")).where("bbox is not null")


def footprint_entities(footprints: DataFrame, counts: DataFrame) -> DataFrame:
    """Last resort: walls at even spacing across the box, doors along its lower and windows along its upper edge."""
    per = counts.groupBy(*ASSET).agg(*(F.sum(F.when(F.col("role") == r, F.col("proxies")).otherwise(0)).alias(r) for r in ("wall", "door", "window")))
    b = F.col("bbox")
    told = F.array(*(F.struct(F.lit(c).alias("category"), n.cast("int").alias("m")) for c, n in (("wall_line", F.least(F.greatest("wall", F.lit(LEAST_WALLS)), F.lit(MOST_WALLS))), ("door_block", F.least("door", F.lit(MOST_OPENINGS))), ("window_block", F.least("window", F.lit(MOST_OPENINGS))))))
    rows = footprints.join(per, ASSET).select(*ASSET, "bbox", F.explode(told).alias("t")).where("t.m > 0").select(*ASSET, "bbox", "t.*", F.explode(F.sequence(F.lit(1), F.col("t.m"))).alias("number"))
    part = F.col("number") / (F.col("m") + 1)
    y = b["min_y"] + part * F.greatest(b["max_y"] - b["min_y"], F.lit(1.0))
    x = b["min_x"] + part * F.greatest(b["max_x"] - b["min_x"], F.lit(1.0))
    wall = F.col("category") == "wall_line"
    points = F.when(wall, F.array(geometry.point(b["min_x"], y), geometry.point(b["max_x"], y))).otherwise(F.array(geometry.point(x, F.when(F.col("category") == "door_block", b["min_y"]).otherwise(b["max_y"]))))
    return rows.select(*ASSET, "category", "number", points.alias("points"), F.when(wall, F.lit(0.35)).otherwise(F.lit(0.32)).alias("confidence"))
