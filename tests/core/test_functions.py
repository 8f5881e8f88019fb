"""Literal rows for the expressions."""

import base64
import uuid

import pytest
from pyspark.sql import functions as F

from trussline.functions import geometry, ids, storeys, text


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, t {kind}")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize_text(spark):
    assert values(spark, text.normalize_text, [" foo \0 bar\n\tbaz ", "", None]) == ["foo bar baz", "", None]


def test_tags(spark):
    rows = [("North Angle 30", "north_angle"), ("1F 标高 4.2", "elevation"), ("平面图", "view_marker"), ("卫生间", "room_label"), ("广联达专用宿舍楼", "generic"), ("详楼梯配筋图", "generic"), ("室内装修做法表", "generic"), ("3.5 m", "dimension")]
    assert values(spark, lambda t: text.text_tag(t, F.lit(None).cast("string")), [t for t, _ in rows]) == [v for _, v in rows]
    assert values(spark, lambda t: text.text_tag(t, F.lit("room")), ["无 关"]) == ["room_label"]


def test_elevations_and_dimensions(spark):
    assert values(spark, text.elevations, ["EL: +3.300 m", "level 450 mm 标高 12", "±0 +4.5000 x", "none", "层高 300cm"]) == [[3.3], [0.45, 12.0], [4.5], [], [3.0]]
    got = values(spark, text.dimensions, ["3.5 M and 800 x 1200 mm", "2×3", "none"])
    assert [[(d.kind, d.value, d.unit) for d in x] for x in got] == [[("text_dimension", 3.5, "m"), ("size_pair", None, "mm")], [("size_pair", None, None)], []]


def test_grid_labels_roles_units(spark):
    assert values(spark, text.grid_label, ["Axis a-1", "see ab-12", "12", "1234", "轴 B"]) == ["A-1", "SEE", "12", None, "B"]
    assert values(spark, text.semantic_role, ["A-WALL", "轴网", "wind", "Area plan", "", None, "xyz", "site-elev"]) == ["wall", "grid", "window", "room", "unknown", "unknown", "unknown", "elevation"]
    assert values(spark, text.unit_token, ["in MM only", "metre"]) == ["mm", None]
    assert values(spark, text.north_angle, ["north: -12.345", "北向=30", "south 3"]) == [-12.35, 30.0, None]


@pytest.mark.parametrize(
    "name, key",
    [("宿舍楼-1F-建施.dxf", "1F"), ("住宅-地下二层平面图.dxf", "B2"), ("办公楼-RF-屋面图.dxf", "RF"), ("surface", "RF"), ("job2", "B2"), ("负三层", "B3"), ("十二层平面", "12F"), ("二十一层", "21F"), ("12 f", "12F"), ("首层平面", "1F"), ("3floor", None), ("平面", None)],
)
def test_storey_keys(spark, name, key):
    assert values(spark, storeys.storey_key, [name]) == [key]


def test_numerals_order_and_elevation(spark):
    assert values(spark, storeys.chinese_floor, ["十", "十二", "二十", "二十一", "五", "一二", ""]) == [10, 12, 20, 21, 5, None, None]
    keys = ["RF", "x", "2F", "B1", "10F", "B3", "1F"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.k for r in df.orderBy(storeys.storey_order(F.col("k"))).collect()] == ["B3", "B1", "1F", "2F", "10F", "RF", "x"]
    up = lambda k: storeys.storey_elevation(k, F.lit(2), F.lit(5), F.lit(3.0), F.lit(4.5))
    assert values(spark, up, ["B2", "1F", "2F", "4F", "RF", "other"]) == [-6.0, 0.0, 4.5, 10.5, 16.5, 7.5]


def test_view_markers(spark):
    mark = lambda t: text.view_marker_candidates(t, storeys.storey_key(t), F.lit(0.7), F.lit("text"))
    got = values(spark, mark, ["-- 剖面", "1-1 剖面", "二层平面图", "南立面"])
    assert [[c.name for c in x] for x in got] == [[], ["section_reference"], ["standard_floor", "二层平面图"], ["facade_reference"]]
    assert got[2][1].confidence == pytest.approx(0.75)


def test_prompts(spark):
    assert values(spark, text.prompt_digits, ["十二层两户"]) == ["102层2户"]
    got = values(spark, text.roof_command, ["双坡屋顶 45° 悬挑 1.2 m", "shed it", "平屋顶", "一坡"])
    assert [(g.roof_type, g.slope_deg, g.overhang_m) if g else None for g in got] == [("gable", 45.0, 1.2), None, ("flat", 30.0, 0.6), None]
    got = values(spark, text.window_patch, ["将 900×2100 的窗更换为落地窗", "replace window", "替换门"])
    assert [(g.width_mm, g.height_mm, g.target_family) if g else None for g in got] == [(900, 2100, "floor_to_ceiling_window"), (800, 1200, "updated_window"), None]


def test_vendor_vector_and_names(spark):
    good = base64.b64encode("1.5,2,3,4".encode("utf-16-le")).decode()
    got = values(spark, text.wall_vector, [good, base64.b64encode("1,2".encode("utf-16-le")).decode(), "###", None])
    assert [tuple(g) if g else None for g in got] == [(1.5, 2.0, 3.0, 4.0), None, None, None]
    assert values(spark, text.safe_filename, ["a b/ü.dxf", "...", None, "_x_.pdf"]) == ["a_b_.dxf", "asset.bin", "asset.bin", "x_.pdf"]


def test_guids_equal_uuid5(spark):
    seeds = ["proj:ver:storey_01:IfcWall:墙体 1:::", "", "a" * 300]
    want = [uuid.uuid5(uuid.NAMESPACE_URL, s) for s in seeds]
    assert values(spark, ids.guid, seeds) == [str(u) for u in want]

    def short(u):
        n, out = u.int, ""
        for _ in range(22):
            n, d = divmod(n, 64)
            out = ids.GUID_DIGITS[d] + out
        return out

    assert values(spark, lambda s: ids.short_guid(ids.guid(s)), seeds) == [short(u) for u in want]
    assert values(spark, lambda s: ids.element_id(F.lit("st"), F.lit("IfcDoor"), s), seeds) == [f"st_ifcdoor_{uuid.uuid5(uuid.NAMESPACE_DNS, s).hex[:8]}" for s in seeds]


def test_geometry(spark):
    pts = "array<struct<x:double,y:double>>"
    square = [(0.0, 1.0), (2.0, 1.0), (2.0, 3.0), (0.0, 3.0)]
    assert values(spark, geometry.box_of_points, [[], square], pts) == [None, (0.0, 1.0, 2.0, 3.0)]
    assert values(spark, geometry.polygon_area, [square, square[:2]], pts) == [4.0, 0.0]
    assert values(spark, lambda p: geometry.anchor(p, F.lit(None).cast("struct<min_x:double,min_y:double,max_x:double,max_y:double>")), [square, []], pts) == [(1.0, 2.0), None]
    way = lambda p: geometry.orientation(p[0]["x"], p[0]["y"], p[1]["x"], p[1]["y"])
    lines = [[(0.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (0.1, 5.0)], [(0.0, 0.0), (5.0, 1.0)], [(0.0, 0.0), (3.0, 3.0)]]
    assert values(spark, way, lines, pts) == ["unknown", "vertical", "horizontal", "angled"]
    scale = lambda default: [r.v for r in spark.createDataFrame([("mm",), ("5",), ("M",), ("?",), (None,)], "t string").select(geometry.unit_scale(F.col("t"), default).alias("v")).collect()]
    assert scale(1.0) == [0.001, 0.01, 1.0, 1.0, 1.0] and scale(0.001) == [0.001, 0.01, 1.0, 0.001, 0.001]
