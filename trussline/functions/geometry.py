"""Geometry and number expressions over points (struct x, y), boxes (struct min_x, min_y, max_x, max_y) and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round3(x: Column) -> Column:
    """Three decimals, without a negative zero."""
    return F.round(x, 3) + F.lit(0.0)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def box_of_points(points: Column) -> Column:
    """Box around the points; null for none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def box_of_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return box(round3(x0), round3(y0), round3(x1), round3(y1))


def orientation(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = F.abs(x2 - x1), F.abs(y2 - y1)
    return F.when((dx == 0) & (dy == 0), F.lit("unknown")).when(dx <= dy * 0.2, F.lit("vertical")).when(dy <= dx * 0.2, F.lit("horizontal")).otherwise(F.lit("angled"))


def axis_coordinate(way: Column, x: Column, y: Column, strict: bool = False) -> Column:
    """x of a vertical axis, else y; with `strict` null for axes that are neither vertical nor horizontal."""
    out = F.when(way == "vertical", x)
    return out.when(way == "horizontal", y) if strict else out.otherwise(y)


def anchor(points: Column, bbox: Column) -> Column:
    """Mean of the points, else the middle of the box, else null."""
    n = F.size(points)
    mean = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[f]) / n
    return F.when(n > 0, F.struct(mean("x").alias("x"), mean("y").alias("y"))).when(bbox.isNotNull(), box_middle(bbox))


def rounded_point(p: Column) -> Column:
    return F.when(p.isNotNull(), F.struct(round3(p["x"]).alias("x"), round3(p["y"]).alias("y")))


def box_middle(bbox: Column) -> Column:
    return F.struct(((bbox["min_x"] + bbox["max_x"]) / 2).alias("x"), ((bbox["min_y"] + bbox["max_y"]) / 2).alias("y"))


def entity_box(points: Column, bbox: Column) -> Column:
    return F.coalesce(bbox, box_of_points(points))


def box_area(bbox: Column) -> Column:
    return F.greatest(bbox["max_x"] - bbox["min_x"], F.lit(0.0)) * F.greatest(bbox["max_y"] - bbox["min_y"], F.lit(0.0))


def polygon_area(points: Column) -> Column:
    """Shoelace area, signed; 0 for fewer than three points."""
    n = F.size(points)
    cross = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.when(n >= 3, F.aggregate(cross, F.lit(0.0), lambda a, c: a + c) / 2).otherwise(F.lit(0.0))


def area_sqm(points: Column, bbox: Column, scale: Column) -> Column:
    """Area in square metres of a polygon, else of a box with extent; null without either."""
    w, d = (bbox["max_x"] - bbox["min_x"]) * scale, (bbox["max_y"] - bbox["min_y"]) * scale
    return F.when(F.size(points) >= 3, F.abs(polygon_area(points)) * scale * scale).when((w > 0) & (d > 0), w * d)


def length_to_metres(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u == "cm", value / 100).when(u == "mm", value / 1000).otherwise(value)


def unit_scale(units: Column, unknown: float) -> Column:
    """Metres of one drawing unit. Intents take unknown units as metres (1.0), models as millimetres (0.001)."""
    u = F.lower(F.coalesce(units, F.lit("")))
    known = F.when(u.isin("mm", "millimeter", "millimeters", "4"), F.lit(0.001)).when(u.isin("cm", "centimeter", "centimeters", "5"), F.lit(0.01)).when(u.isin("m", "meter", "meters", "6"), F.lit(1.0))
    return known.otherwise(F.lit(unknown))


def local(value: Column, origin: Column, scale: Column) -> Column:
    return (value - origin) * scale


def middle(a: Column, b: Column) -> Column:
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def vendor_length(value: Column, scale: Column, least: float, default: Column) -> Column:
    """A vendor's length in metres, at least `least`; the default where it is no number. (greatest() skips nulls, so the
    null has to be told apart first.)"""
    v = value.try_cast("double")
    return F.when(v.isNotNull(), F.greatest(v * scale, F.lit(least))).otherwise(default)


def wall_axis(category: Column, points: Column, bbox: Column, vendor_width: Column, scale: Column) -> Column:
    """start, end, thickness_m of a wall: the ends of a line, else the long axis of its box; null without either."""
    thick = vendor_length(vendor_width, scale, 0.08, F.lit(0.2))
    w, d = bbox["max_x"] - bbox["min_x"], bbox["max_y"] - bbox["min_y"]
    mx, my = (bbox["min_x"] + bbox["max_x"]) / 2, (bbox["min_y"] + bbox["max_y"]) / 2
    lying = w >= d
    pick = lambda a, b: F.when(lying, a).otherwise(b)
    out = lambda s, e, t: F.struct(s.alias("start"), e.alias("end"), t.alias("thickness_m"))
    line = (category == "wall_line") & (F.size(points) >= 2)
    boxed = out(point(pick(bbox["min_x"], mx), pick(my, bbox["min_y"])), point(pick(bbox["max_x"], mx), pick(my, bbox["max_y"])), F.greatest(thick, F.least(w, d) * scale))
    return F.when(line, out(F.get(points, 0), F.element_at(points, -1), thick)).when(bbox.isNotNull(), boxed)


def project(px: Column, py: Column, axis: Column) -> Column:
    """x, y, distance and rotation_deg of a point's foot on a wall axis; the foot stays on the axis."""
    s, e = axis["start"], axis["end"]
    dx, dy = e["x"] - s["x"], e["y"] - s["y"]
    square = dx * dx + dy * dy
    short = square <= 1e-9
    t = F.when(short, F.lit(0.0)).otherwise(F.least(F.greatest(((px - s["x"]) * dx + (py - s["y"]) * dy) / F.when(short, F.lit(1.0)).otherwise(square), F.lit(0.0)), F.lit(1.0)))
    x, y = s["x"] + dx * t, s["y"] + dy * t
    return F.struct(x.alias("x"), y.alias("y"), distance(px, py, x, y).alias("distance"), F.when(short, F.lit(0.0)).otherwise(F.degrees(F.atan2(dy, dx))).alias("rotation_deg"))
