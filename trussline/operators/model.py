"""Building models: storeys from layouts, elements from sources or templates, openings on walls, roofs and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, ids, storeys
from .components import modelable

# Template counts and sizes, parts of each roof, element types that are reconciled.
TEMPLATE_WALLS, DEFAULT_UNITS = 8, 4
ROOF_PARTS = (
    ("gable", "gable_roof_left"),
    ("gable", "gable_roof_right"),
    ("hip", "hip_roof_front"),
    ("hip", "hip_roof_back"),
    ("hip", "hip_roof_left"),
    ("hip", "hip_roof_right"),
    ("shed", "shed_roof"),
    ("flat", "flat_roof"),
)
ROOF_DEFAULT = (30.0, 12.0)
WALL_PLACES = ((12.0, 0.1, 0.0, 24.0), (12.0, 13.9, 0.0, 24.0), (0.1, 7.0, 90.0, 14.0), (23.9, 7.0, 90.0, 14.0), (8.0, 7.0, 90.0, 10.0), (16.0, 7.0, 90.0, 10.0), (12.0, 4.0, 0.0, 16.0), (12.0, 10.0, 0.0, 16.0))
OPENING_SIZES = {"door_block": (1.0, 0.15, 2.1), "window_block": (1.5, 0.12, 1.5)}
TYPES = {"wall_line": "IfcWall", "wall_path": "IfcWall", "door_block": "IfcDoor", "window_block": "IfcWindow"}
RECONCILED = (("IfcWall", "wall"), ("IfcDoor", "door"), ("IfcWindow", "window"))
SOURCE_NAMES = {"IfcSlab": "图纸楼板", "IfcWall": "图纸墙体", "IfcDoor": "图纸门", "IfcWindow": "图纸窗"}
SLAB_M, SILL_M, LEAST_STOREY_M = 0.12, 0.9, 2.8
WALLS, OPENINGS, ROOMS = ("wall_line", "wall_path"), ("door_block", "window_block"), ("room_boundary", "room_label")
#: Smallest cell of the wall search, in drawing units, how often cells double, and how wide those of the last level are.
CELL, CELL_LEVELS, WIDEST = 250.0, 15, 1e15


def source_entities(entities: DataFrame, roles: DataFrame) -> DataFrame:
    """Entities that a model takes: of a modelled category with the geometry it needs, in no section or facade; `roles` has
    the view role and storey of every asset, which an entity's own override."""
    rows = entities.join(roles.select("bundle_id", "asset_name", F.col("view_role").alias("_role"), F.col("storey_key").alias("_key")), ["bundle_id", "asset_name"], "left")
    rows = rows.withColumns({"role": F.coalesce(F.nullif("fragment_role", F.lit("unknown")), "_role", F.lit("unknown")), "storey_key": F.coalesce("storey_key", "_key", F.lit("1F"))})
    return rows.where(modelable(F.col("category"), F.col("points"), F.col("bbox"), F.col("label")) & ~F.col("role").isin("section", "facade")).drop("_role", "_key", "role")


def storey_layouts(entities: DataFrame, scale: float = 0.001) -> DataFrame:
    """One layout a storey with walls: counts, origin over all entities, footprint and middle over the walls. Numbered in
    storey order (layout_seq)."""
    own = geometry.entity_box(F.col("points"), F.col("bbox"))
    rows = entities.withColumn("own", own)
    wall, opening = F.col("category").isin(*WALLS), F.col("category").isin(*OPENINGS)
    sides = ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))
    per = rows.groupBy("bundle_id", "storey_key").agg(
        F.count_if(wall).alias("walls"), F.count_if(F.col("category") == "door_block").alias("doors"), F.count_if(F.col("category") == "window_block").alias("windows"), F.count_if(~wall & ~opening).alias("rooms"),
        *(f(f"own.{c}").alias(f"all_{c}") for f, c in sides), *(f(F.when(wall, F.col(f"own.{c}"))).alias(f"wall_{c}") for f, c in sides),
    ).where("walls > 0 and all_min_x is not null")
    extent = lambda a: F.greatest((F.coalesce(f"wall_max_{a}", f"all_max_{a}") - F.coalesce(f"wall_min_{a}", f"all_min_{a}")) * scale, F.lit(1.0))
    mid = lambda a: ((F.col(f"wall_min_{a}") + F.col(f"wall_max_{a}")) / 2)
    n = F.row_number().over(Window.partitionBy("bundle_id").orderBy(storeys.storey_order(F.col("storey_key")), "storey_key"))
    return per.select("bundle_id", n.alias("layout_seq"), "storey_key", "walls", "doors", "windows", "rooms", F.col("all_min_x").alias("origin_x"), F.col("all_min_y").alias("origin_y"), geometry.round3(extent("x")).alias("width_m"), geometry.round3(extent("y")).alias("depth_m"), mid("x").alias("wall_center_x"), mid("y").alias("wall_center_y"))


def replicated_storeys(layouts: DataFrame, intents: DataFrame) -> DataFrame:
    """Storeys of every bundle with layouts: the i-th layout, and beyond them the last again under new keys, as many as the
    intent (bundle_id, floors, standard, first) asks for. Elevations follow the keys."""
    # Every layout gives its own storeys, the last of a bundle the copies too, so layouts are read once.
    rows = layouts.select("bundle_id", "layout_seq", F.col("storey_key").alias("source_storey_key"), F.count("*").over(Window.partitionBy("bundle_id")).alias("n")).join(intents, "bundle_id")
    own = F.when(F.col("layout_seq") < F.col("n"), F.array("layout_seq")).otherwise(F.sequence("layout_seq", F.greatest(F.col("n"), F.col("floors")).cast("int")))
    rows = rows.withColumn("storey_no", F.explode(own))
    copy = F.col("storey_no") > F.col("n")
    rows = rows.withColumn("replicated", copy).withColumn("storey_key", F.when(copy, F.concat(F.col("storey_no").cast("string"), F.lit("F"))).otherwise(F.col("source_storey_key")))
    up = storeys.storey_elevation(F.col("storey_key"), F.col("storey_no") - 1, F.col("floors"), F.col("standard"), F.col("first"))
    return rows.select("bundle_id", F.format_string("storey_%02d", "storey_no").alias("storey_id"), "storey_no", "storey_key", "source_storey_key", "replicated", F.round(up, 2).alias("elevation_m"))


def wall_geometry(walls: DataFrame, height: Column, scale: float = 0.001) -> DataFrame:
    """Placement and size of walls (points, bbox, vendor_width, origin_x, origin_y): a line's length and direction, a box's
    sides, or one metre at the origin without geometry."""
    s = F.lit(scale)
    thick = geometry.vendor_length(F.col("vendor_width"), s, 0.08, F.lit(0.2))
    a, b, box = F.get("points", 0), F.element_at("points", -1), F.col("bbox")
    line = (F.col("category") == "wall_line") & (F.size("points") >= 2)
    here = lambda x, y, w, d, r: F.struct(geometry.round3(x).alias("local_x_m"), geometry.round3(y).alias("local_y_m"), geometry.round3(w).alias("width_m"), geometry.round3(d).alias("depth_m"), geometry.round3(r).alias("rotation_deg"))
    at = lambda x, o: geometry.local(x, F.col(o), s)
    m = geometry.middle(a, b)
    length = F.greatest(geometry.distance(a["x"], a["y"], b["x"], b["y"]) * s, F.lit(0.2))
    side = lambda k: F.greatest((box[f"max_{k}"] - box[f"min_{k}"]) * s, thick)
    centre = geometry.box_middle(box)
    zero = F.lit(0.0)
    placed = F.when(line, here(at(m["x"], "origin_x"), at(m["y"], "origin_y"), length, thick, F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])))).when(box.isNotNull(), here(at(centre["x"], "origin_x"), at(centre["y"], "origin_y"), side("x"), side("y"), zero)).otherwise(here(zero, zero, F.lit(1.0), thick, zero))
    return walls.withColumn("_g", placed).select(*walls.columns, "_g.*", F.round(height, 3).alias("height_m"))


def host_walls(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """Each opening's wall in its bundle and storey: the first wall whose handle is among the opening's parents, else the
    nearest axis, the first of equally near ones. Adds wall_seq, distance, foot_x, foot_y, rotation_deg.

    openings: bundle_id, storey_key, entity_seq, x, y, parents (array of handles); walls: bundle_id, storey_key, wall_seq,
    handle, axis. Parents are matched by an equality join; only openings without one are searched for through cells."""
    key = ["bundle_id", "storey_key"]
    by_parent = openings.withColumn("handle", F.explode("parents")).join(walls.select(*key, "handle", "wall_seq"), [*key, "handle"]).groupBy(*key, "entity_seq").agg(F.min("wall_seq").alias("wall_seq"))
    rest = openings.join(by_parent, [*key, "entity_seq"], "left_anti")
    chosen = by_parent.unionByName(nearest_walls(rest, walls).drop("distance"))
    foot = geometry.project(F.col("x"), F.col("y"), F.col("axis"))
    rows = openings.join(chosen, [*key, "entity_seq"], "left").join(walls.select(*key, "wall_seq", "axis"), [*key, "wall_seq"], "left").withColumn("_f", foot)
    return rows.select(*openings.columns, "wall_seq", "axis", F.col("_f.distance").alias("distance"), F.col("_f.x").alias("foot_x"), F.col("_f.y").alias("foot_y"), F.col("_f.rotation_deg").alias("rotation_deg"))


def nearest_walls(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """bundle_id, storey_key, entity_seq, wall_seq, distance: the wall of least distance in the opening's storey, the first
    of equally near ones; exact, however far.

    Openings at one place are one, and so are walls with one axis (their first wall stands for them). Cells come in levels,
    each twice as wide as the one below; the last level is one cell for all. An axis is listed at every level whose cells
    are at least as long as it, so it is in few cells of a level. First the lowest level at which a place's own cell holds
    an axis gives some distance d; then the at most four cells that d reaches, at the level of cells twice as wide as d,
    and those of the levels above where longer axes are listed, hold all that can be nearer."""
    key = ["bundle_id", "storey_key"]
    ends = ["ax", "ay", "bx", "by"]
    axes = walls.where("axis is not null").select(*key, "wall_seq", F.col("axis.start.x").alias("ax"), F.col("axis.start.y").alias("ay"), F.col("axis.end.x").alias("bx"), F.col("axis.end.y").alias("by"))
    level = lambda length: F.least(F.greatest(F.ceil(F.log2(length / CELL)), F.lit(0)), F.lit(CELL_LEVELS)).cast("int")
    own = level(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")), F.lit(CELL)))
    axes = axes.groupBy(*key, *ends).agg(F.min("wall_seq").alias("wall_seq")).withColumn("own", own)
    width = F.get(F.array(*(F.lit(CELL * 2.0**k) for k in range(CELL_LEVELS)), F.lit(WIDEST)), F.col("level"))
    cell = lambda c: F.floor(c / F.col("width"))
    upward = lambda rows, first: rows.withColumn("level", F.explode(F.sequence(first, F.lit(CELL_LEVELS)))).withColumn("width", width)
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b))))
    dealt = upward(axes, F.col("own")).withColumn("cx", span("ax", "bx")).withColumn("cy", span("ay", "by")).drop("width")
    owns = axes.groupBy(*key).agg(F.collect_set("own").alias("owns"))

    places = openings.where("x is not null and y is not null").select(*key, "x", "y").distinct()
    at = upward(places, F.lit(0)).withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y"))).drop("width")
    # Occupied cells only, so a cell of very many axes is one row here.
    occupied = dealt.select(*key, "level", "cx", "cy").distinct()
    lowest = at.join(occupied, [*key, "level", "cx", "cy"]).groupBy(*key, "x", "y").agg(F.min("level").alias("level"), F.min_by("cx", "level").alias("cx"), F.min_by("cy", "level").alias("cy"))
    point = lambda x, y: geometry.point(F.col(x), F.col(y))
    distance = geometry.project(F.col("x"), F.col("y"), F.struct(point("ax", "ay").alias("start"), point("bx", "by").alias("end")))["distance"]
    some = lowest.join(dealt, [*key, "level", "cx", "cy"]).groupBy(*key, "x", "y").agg(F.min(distance).alias("d"))
    # A little more than d, for what rounding may take away.
    wanted = some.withColumn("d", F.col("d") * 1.000001 + 0.001).withColumn("first", level(F.greatest(F.col("d") * 2, F.lit(CELL)))).join(owns, key)
    wanted = wanted.withColumn("level", F.explode(F.array_union(F.array("first"), F.filter("owns", lambda n: n > F.col("first"))))).withColumn("width", width).drop("owns")
    reach = lambda c: F.explode(F.sequence(cell(F.col(c) - F.col("d")), cell(F.col(c) + F.col("d"))))
    met = wanted.withColumn("cx", reach("x")).withColumn("cy", reach("y")).drop("width").join(dealt, [*key, "level", "cx", "cy"]).where("level = first or own = level")
    near = met.select(*key, "x", "y", "wall_seq", distance.alias("distance"))
    found = near.groupBy(*key, "x", "y").agg(F.min("distance").alias("distance"), F.min_by("wall_seq", F.struct("distance", "wall_seq")).alias("wall_seq"))
    return openings.select(*key, "entity_seq", "x", "y").join(found, [*key, "x", "y"]).select(*key, "entity_seq", "wall_seq", "distance")


def opening_geometry(hosted: DataFrame, scale: float = 0.001) -> DataFrame:
    """Placement and size of openings on their walls (from host_walls, with span, vendor_width, vendor_height and the
    origin): the foot on the wall and the wall's direction, a width of its span at least its kind's, vendor sizes first, and
    a depth of the wall's thickness and 0.02 m at least; without a wall where they are."""
    s = F.lit(scale)
    usual = lambda k: F.when(F.col("category") == "door_block", F.lit(OPENING_SIZES["door_block"][k])).otherwise(F.lit(OPENING_SIZES["window_block"][k]))
    width = geometry.vendor_length(F.col("vendor_width"), s, 0.3, F.greatest(F.coalesce(F.col("span") * s, F.lit(0.0)), usual(0)))
    height = geometry.vendor_length(F.col("vendor_height"), s, 0.5, usual(2))
    at = lambda f, p, o: geometry.round3(geometry.local(F.coalesce(f, p), F.col(o), s))
    return hosted.withColumns(
        {
            "local_x_m": at("foot_x", "x", "origin_x"),
            "local_y_m": at("foot_y", "y", "origin_y"),
            "rotation_deg": geometry.round3(F.coalesce("rotation_deg", F.lit(0.0))),
            "width_mm": F.round(width * 1000).cast("long"),
            "height_mm": F.round(height * 1000).cast("long"),
            "depth_m": geometry.round3(F.greatest(usual(1), F.coalesce(F.col("axis.thickness_m") + 0.02, F.lit(0.0)))),
        }
    )


def template_elements(storey_rows: DataFrame) -> DataFrame:
    """Elements of storeys without drawings (bundle_id, storey_id, storey_no, units, height_m): walls, a slab, and unit by
    unit a door and two windows; no units, or none told, are DEFAULT_UNITS."""
    units = F.coalesce(F.nullif("units", F.lit(0)), F.lit(DEFAULT_UNITS))
    one = lambda kind, name, family, i, w, h: F.struct(F.lit(kind).alias("ifc_type"), name.alias("name"), F.lit(family).alias("family_name"), i.cast("int").alias("slot"), w.cast("double").alias("width_mm"), h.cast("double").alias("height_mm"))
    num = lambda prefix, i, end="": F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit(end))
    upto = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    none = F.lit(None)
    walls = F.transform(upto(F.lit(TEMPLATE_WALLS)), lambda i: one("IfcWall", num("墙体 ", i), "generic_wall", i, (6 + i % 3) * 1000, F.col("height_m") * 1000))
    slab = F.array(one("IfcSlab", F.concat(F.lit("楼板 "), F.col("storey_no").cast("string")), "generic_slab", F.lit(0), none, none))
    unit = lambda i: F.array(one("IfcDoor", num("户门 ", i), "unit_entry_door", i, F.lit(1000), F.lit(2100)), one("IfcWindow", num("窗 ", i, "-A"), "standard_window", i, F.lit(800), F.lit(1200)), one("IfcWindow", num("窗 ", i, "-B"), "secondary_window", i, F.lit(1200), F.lit(1500)))
    none_at_all = F.array().cast("array<struct<ifc_type:string,name:string,family_name:string,slot:int,width_mm:double,height_mm:double>>")
    every = F.concat(walls, slab, F.when(units > 0, F.flatten(F.transform(upto(units), unit))).otherwise(none_at_all))
    return storey_rows.select("bundle_id", "storey_id", F.posexplode(every).alias("element_seq", "e")).select("bundle_id", "storey_id", "element_seq", "e.*")


def source_elements(placed: DataFrame) -> DataFrame:
    """Elements of source entities, numbered within storey and type, with names, ids and GUIDs; placed: bundle_id,
    storey_id, category, entity_seq, label, source_ref, storey_key, fragment_id."""
    kind = F.try_element_at(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p)), F.col("category"))
    n = F.row_number().over(Window.partitionBy("bundle_id", "storey_id", "ifc_type").orderBy("entity_seq"))
    rows = placed.withColumn("ifc_type", kind).where("ifc_type is not null").withColumn("number", n)
    rows = rows.withColumn("name", F.coalesce(F.nullif("label", F.lit("")), F.concat_ws(" ", F.substring("ifc_type", 4, 20), F.col("number").cast("string"))))
    seed = F.concat_ws(":", F.col("bundle_id").cast("string"), "storey_id", "ifc_type", "name", F.coalesce("storey_key", F.lit("")), F.coalesce("fragment_id", F.lit("")), F.coalesce("source_ref", F.lit("")))
    return rows.withColumns({"guid": ids.guid(seed), "element_id": ids.element_id(F.col("storey_id"), F.col("ifc_type"), seed)})


def placed_elements(storey_rows: DataFrame, layouts: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """The elements of all storeys that follow drawings: a slab, the walls, doors and windows of the layout that the storey
    follows, with size, local placement, name, family, ids, and for openings the ids of their wall's element in the same
    storey (null without a wall).

    storey_rows: bundle_id, storey_id, source_storey_key, height_m; layouts: as storey_layouts gives them; walls: as
    wall_geometry gives them, with entity_seq, category, label; openings: as opening_geometry gives them, with wall_seq and
    label. An id is the hash of a name made of bundle, storey, type and source, so a host's id needs no join: it is what the
    wall's element in that storey is called."""
    key, s = ["bundle_id", "storey_key"], F.lit(0.001)
    null = lambda kind: F.lit(None).cast(kind)
    number = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("double")

    def part(rows: DataFrame, kind: Column | str, seq: Column, label: Column, family: Column, x: Column, y: Column, z: Column | float, turn: Column | float, size: tuple, wall: Column) -> DataFrame:
        sizes = [number(c).alias(n) for c, n in zip((x, y, z, turn, *size), ("local_x_m", "local_y_m", "local_z_m", "rotation_deg", "width_m", "depth_m", "own_height_m"), strict=True)]
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return rows.select(*key, kind.alias("ifc_type"), seq.cast("long").alias("source_seq"), label.alias("label"), family.alias("family_name"), *sizes, wall.cast("long").alias("wall_seq"))

    middle = lambda a, side: geometry.round3(F.coalesce(geometry.local(F.col(f"wall_center_{a}"), F.col(f"origin_{a}"), s), F.col(side) / 2))
    col, family = F.col, F.concat(F.lit("cad_"), F.col("category"))
    slab = part(layouts, "IfcSlab", null("long"), null("string"), F.lit("cad_footprint_slab"), middle("x", "width_m"), middle("y", "depth_m"), 0.0, 0.0, (col("width_m"), col("depth_m"), SLAB_M), null("long"))
    wall = part(walls, "IfcWall", col("entity_seq"), col("label"), family, col("local_x_m"), col("local_y_m"), 0.0, col("rotation_deg"), (col("width_m"), col("depth_m"), null("double")), null("long"))
    is_door = col("category") == "door_block"
    kind, sill = F.when(is_door, "IfcDoor").otherwise("IfcWindow"), F.when(is_door, 0.0).otherwise(SILL_M)
    opening = part(openings, kind, col("entity_seq"), col("label"), family, col("local_x_m"), col("local_y_m"), sill, col("rotation_deg"), (col("width_mm") / 1000, col("depth_m"), col("height_mm") / 1000), col("wall_seq"))
    parts = slab.unionByName(wall).unionByName(opening).withColumn("number", F.row_number().over(Window.partitionBy(*key, "ifc_type").orderBy("source_seq")))

    rows = storey_rows.select("bundle_id", "storey_id", F.col("source_storey_key").alias("storey_key"), "height_m").join(parts, key)
    named = F.try_element_at(F.create_map(*(F.lit(x) for p in SOURCE_NAMES.items() for x in p)), F.col("ifc_type"))
    ordinal = F.when(F.col("ifc_type") == "IfcSlab", F.substring("storey_id", -2, 2)).otherwise(F.col("number").cast("string"))
    called = lambda kind, seq: F.concat_ws(":", F.col("bundle_id").cast("string"), "storey_id", kind, F.coalesce(seq.cast("string"), F.lit("slab")))
    own = called(F.col("ifc_type"), F.col("source_seq"))
    # Null without a wall, and so are the ids made of it: an id inside a condition would hash its name once for every part.
    host = F.concat(F.col("bundle_id").cast("string"), F.lit(":"), "storey_id", F.lit(":IfcWall:"), F.col("wall_seq").cast("string"))
    host_id = F.concat("storey_id", F.lit("_ifcwall_"), F.substring(ids.guid_hex(host, ids.DNS_SPACE), 1, 8))
    return rows.select(
        "bundle_id", "storey_id", F.col("storey_key").alias("source_storey_key"), "ifc_type", "source_seq", F.coalesce(F.nullif("label", F.lit("")), F.concat_ws(" ", named, ordinal)).alias("name"), "family_name",
        "local_x_m", "local_y_m", "local_z_m", "rotation_deg", "width_m", "depth_m", F.coalesce("own_height_m", F.greatest("height_m", F.lit(LEAST_STOREY_M))).alias("height_m"),
        ids.element_id(F.col("storey_id"), F.col("ifc_type"), own).alias("element_id"), ids.guid(own).alias("guid"), host_id.alias("host_element_id"), ids.guid(host).alias("host_guid"),
    )


def roof_elements(tops: DataFrame, layouts: DataFrame) -> DataFrame:
    """Roof parts of every top storey (bundle_id, storey_id, roof_type, slope_deg, overhang_m): sizes from the largest
    footprint of the bundle's layouts, or the default without any. The parts are a fixed dimension of eight rows."""
    size = layouts.groupBy("bundle_id").agg(F.max(F.when(F.col("width_m") > 0, F.col("width_m"))).alias("w"), F.max(F.when(F.col("depth_m") > 0, F.col("depth_m"))).alias("d"))
    rows = tops.join(size, "bundle_id", "left").withColumns({"w": F.coalesce("w", F.lit(ROOF_DEFAULT[0])), "d": F.coalesce("d", F.lit(ROOF_DEFAULT[1]))})
    parts = F.create_map(*(x for kind in dict.fromkeys(k for k, _ in ROOF_PARTS) for x in (F.lit(kind), F.array(*(F.lit(f) for k, f in ROOF_PARTS if k == kind)))))
    run = F.when(F.col("roof_type") == "shed", F.col("d")).otherwise(F.col("d") / 2)
    ridge = F.when(F.col("roof_type") == "flat", F.lit(0.0)).otherwise(F.round(run * F.tan(F.radians("slope_deg")), 2))
    depth = F.when(F.col("roof_type") == "gable", F.col("d") / 2 + F.col("overhang_m")).when(F.col("roof_type") == "shed", F.col("d") + F.col("overhang_m")).otherwise(F.col("d") + 2 * F.col("overhang_m"))
    rows = rows.withColumns({"ridge_height_m": ridge, "roof_width_m": geometry.round3(F.col("w") + 2 * F.col("overhang_m")), "roof_depth_m": geometry.round3(depth)})
    return rows.select("bundle_id", "storey_id", "roof_type", F.explode(F.try_element_at(parts, F.col("roof_type"))).alias("family_name"), "ridge_height_m", "roof_width_m", "roof_depth_m")


def apply_patch(elements: DataFrame, patches: DataFrame) -> DataFrame:
    """Windows of the patch's size take its family; patches: bundle_id, width_mm, height_mm, target_family. `replaced`
    tells which."""
    # A bundle has many elements and one patch at most: the patches of a partition are held, elements pass unsorted.
    p = patches.select("bundle_id", F.col("width_mm").alias("_w"), F.col("height_mm").alias("_h"), F.col("target_family").alias("_f")).hint("shuffle_hash")
    hit = F.coalesce((F.col("ifc_type") == "IfcWindow") & (F.col("width_mm") == F.col("_w")) & (F.col("height_mm") == F.col("_h")), F.lit(False))
    return elements.join(p, "bundle_id", "left").withColumn("replaced", hit).withColumn("family_name", F.when(F.col("replaced"), F.col("_f")).otherwise(F.col("family_name"))).drop("_w", "_h", "_f")


def template_layout(elements: DataFrame) -> DataFrame:
    """Places of template elements (slot within their type): walls by a table of eight, doors and windows along the plan."""
    walls = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(spec, ("x", "y", "rotation", "width"), strict=True))) for spec in WALL_PLACES))
    wall = F.get(walls, F.pmod(F.col("slot"), F.lit(len(WALL_PLACES))).cast("int"))
    kind, second = F.col("ifc_type"), F.contains("name", F.lit("B"))
    place = lambda x, y, z, r, w: F.struct(x.alias("layout_x"), y.alias("layout_y"), F.lit(z).alias("layout_z"), r.alias("layout_rotation"), w.alias("layout_width"))
    zero = F.lit(0.0)
    size = F.col("width_mm") / 1000
    spot = F.when(kind == "IfcWall", place(wall["x"], wall["y"], 0.0, wall["rotation"], F.greatest(wall["width"], size))).when(kind == "IfcDoor", place(4.0 + (F.col("slot") + 1) * 4.0, F.lit(0.35), 0.0, zero, size))
    spot = spot.when(kind == "IfcWindow", place(3.0 + (F.col("slot") + 1) * 5.0, F.when(second, F.lit(0.35)).otherwise(F.lit(13.7)), 0.9, zero, size)).otherwise(place(F.lit(12.0), F.lit(7.0), 0.0, zero, F.lit(24.0)))
    return elements.withColumn("_p", spot).select(*elements.columns, "_p.*")


def element_index(elements: DataFrame) -> DataFrame:
    """Elements of every type; `share` of the bundle's total."""
    per = elements.groupBy("bundle_id", "ifc_type").agg(F.count("*").alias("elements"))
    return per.withColumn("total", F.sum("elements").over(Window.partitionBy("bundle_id")))


def reconciliation(source: DataFrame, elements: DataFrame) -> DataFrame:
    """bundle_id, ifc_type, source, modeled, delta for the reconciled types; source: bundle_id, component_type."""
    kinds = F.create_map(*(F.lit(x) for t, c in RECONCILED for x in (c, t)))
    told = source.withColumn("ifc_type", F.try_element_at(kinds, F.col("component_type"))).where("ifc_type is not null").groupBy("bundle_id", "ifc_type").agg(F.count("*").alias("source"))
    made = elements.where(F.col("ifc_type").isin(*(t for t, _ in RECONCILED))).groupBy("bundle_id", "ifc_type").agg(F.count("*").alias("modeled"))
    rows = told.join(made, ["bundle_id", "ifc_type"], "full_outer").na.fill(0, ["source", "modeled"])
    return rows.withColumn("delta", F.col("modeled") - F.col("source"))


def model_metadata(layouts: DataFrame) -> DataFrame:
    """Per bundle: geometry source, totals, storey keys in order and bounds by storey."""
    bounds = F.map_from_entries(F.array_sort(F.collect_list(F.struct("storey_key", F.struct("width_m", "depth_m").alias("max")))))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("layout_seq", "storey_key"))), lambda s: s["storey_key"])
    return layouts.groupBy("bundle_id").agg(F.lit("parsed_drawing").alias("geometry_source"), F.sum("walls").alias("walls"), F.sum("doors").alias("doors"), F.sum("windows").alias("windows"), keys.alias("storey_keys"), bounds.alias("bounds"))
