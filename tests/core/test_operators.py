"""Literal rows for the operators, after the reference's unit cases."""

import pytest
from pyspark.sql import functions as F

from trussline.functions import geometry, ids, text
from trussline.operators import assembly, components, fragments, intents, model, proxies, resolution, rules, validation

BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
PTS = "array<struct<x:double,y:double>>"
ENTITY = f"bundle_id long, asset_name string, asset_seq long, entity_seq long, category string, layer string, label string, source_ref string, confidence double, storey_key string, points {PTS}, bbox {BOX}"


def entity(seq, category="wall_line", at=((0.0, 0.0),), storey="1F", asset="a", bbox=None, label=None, ref=None, confidence=0.5):
    return (1, asset, 0, seq, category, "L", label, ref or f"r{seq}", confidence, storey, [tuple(p) for p in at], bbox)


def entities(spark, rows):
    return spark.createDataFrame(rows, ENTITY)


def frags(spark, rows):
    return spark.createDataFrame([(1, "a", i, f"f{i}", t, "plan", k, b) for i, (t, k, b) in enumerate(rows, 1)], f"bundle_id long, asset_name string, frag_seq int, fragment_id string, fragment_title string, fragment_role string, storey_key string, bbox {BOX}")


def test_manifests_duplicates_chains(spark):
    df = components.component_candidates(entities(spark, [entity(1), entity(2), entity(3, storey="2F"), entity(4, storey="2F", at=((7.0, 7.0),)), entity(5, category="text")]))
    m = {r.storey_key: r for r in assembly.manifests(df).collect()}
    assert (m["1F"].component_count, m["1F"].duplicates, m["2F"].component_count, m["2F"].duplicates, m["2F"].max_x) == (2, 1, 2, 0, 7.0)
    assert [r.copies for r in assembly.duplicates(df).collect()] == [2]
    assert [(r.signature, r.storeys, r.members) for r in assembly.chains(df).collect()] == [("wall:1F;2F", ["1F", "2F"], 3)]


def test_candidates_confidence_annotations(spark):
    rows = [entity(i, category=c, at=((float(i), 0.0),)) for i, c in enumerate(("wall_line", "door_block", "window_block", "room_boundary", "grid_marker"))]
    got = components.component_candidates(entities(spark, rows))
    assert sorted((r.component_type, r.confidence) for r in got.collect()) == [("door", 0.6), ("room", 0.55), ("wall", 0.72), ("window", 0.6)]
    assert components.filter_by_confidence(got, 0.7).count() == 1
    texts = spark.createDataFrame([(1, 1, "墙体编号A1"), (1, 2, "WALL b"), (1, 3, "unrelated")], "bundle_id long, text_seq long, text string")
    notes = {r.component_type: (r.annotation_notes, r.annotation_confidence) for r in components.bind_annotations(got, texts).collect()}
    assert notes["wall"] == (["墙体编号A1", "WALL b"], pytest.approx(0.2)) and notes["door"] == (None, None)
    merged = components.merge_components(entities(spark, rows), components.bind_annotations(got, texts))
    assert merged.count() == 5 and {r.category: r.confidence for r in merged.collect()}["grid_marker"] == 0.5


def test_fragments_contain_or_are_nearest(spark):
    f = frags(spark, [("1F", "1F", (0.0, 0.0, 10.0, 10.0)), ("2F", "2F", (5.0, 0.0, 30.0, 10.0)), ("3F", "3F", None)])
    rows = [entity(1, at=((7.0, 5.0),)), entity(2, at=((20.0, 5.0),)), entity(3, at=((-50.0, 5.0),)), entity(4, at=(), bbox=None), entity(5, asset="other")]
    got = {r.entity_seq: r.fragment_id for r in fragments.assign_fragments(entities(spark, rows), f).collect()}
    assert got == {1: "f1", 2: "f2", 3: "f1", 4: "f1", 5: None}
    kept = entities(spark, rows).withColumn("fragment_id", F.when(F.col("entity_seq") == 2, F.lit("own")))
    assert {r.entity_seq: r.fragment_id for r in fragments.assign_fragments(kept, f).collect()}[2] == "own"


def test_fragment_list_and_boxes(spark):
    e = entities(spark, [entity(1), entity(2, asset="楼-RF")])
    c = spark.createDataFrame([(1, "a", "二层平面图", "text", 2, None), (1, "a", "1F plan", "text", 1, None), (1, "a", "1F plan", "text", 3, None), (1, "a", "no storey", "text", 4, None)], f"bundle_id long, asset_name string, name string, source string, cand_seq long, bbox {BOX}")
    f = fragments.fragment_list(e, c)
    assert sorted(r.fragment_id for r in f.collect()) == ["a::fragment::1F::01", "a::fragment::2F::02", "楼-RF::fragment::RF::01"]
    t = spark.createDataFrame([(1, "a", 1, "1F  plan", "view_marker", (1.0, 1.0, 2.0, 2.0)), (1, "a", 2, "1F plan", "view_marker", (9.0, 9.0, 9.0, 9.0))], f"bundle_id long, asset_name string, text_seq long, text string, semantic_tag string, bbox {BOX}")
    boxes = {r.fragment_id: r.bbox for r in fragments.title_boxes(f, t).collect()}
    assert boxes["a::fragment::1F::01"].min_x == 1.0 and boxes["a::fragment::2F::02"] is None


def test_gap_clusters_split_at_the_largest_gaps(spark):
    rows = [entity(i, at=((x, 0.0),)) for i, x in enumerate([0.0, 300.0, 600.0, 900.0, 1200.0, 6000.0, 6300.0, 6600.0, 6900.0, 7200.0])]
    f = frags(spark, [("1F", "1F", (10000.0, 0.0, 10000.0, 0.0)), ("2F", "2F", (12000.0, 0.0, 12000.0, 0.0))])
    boxes = fragments.gap_clusters(f, entities(spark, rows))
    assert sorted((r.fragment_id, r.bbox.min_x, r.bbox.max_x) for r in boxes.collect()) == [("f1", -100.0, 1300.0), ("f2", 5900.0, 7300.0)]
    got = fragments.assign_fragments(entities(spark, rows), fragments.with_boxes(f, boxes))
    assert [r.fragment_storey_key for r in got.orderBy("entity_seq").collect()] == ["1F"] * 5 + ["2F"] * 5
    assert fragments.collapsed_storeys(f, got).count() == 0
    assert [r.category for r in fragments.collapsed_storeys(f, got.withColumn("fragment_storey_key", F.lit("1F"))).collect()] == ["multi_storey_asset_collapsed"]
    assert fragments.gap_clusters(frags(spark, [("1F", "1F", None), ("2F", "2F", (0.0, 0.0, 1.0, 1.0))]), entities(spark, rows)).count() == 0


def test_units_origin_north(spark):
    a = spark.createDataFrame([(1, "x", 1, "m", None, "default", 1.0, 1.0), (1, "y", 2, "mm", None, "pdf_page_origin", 2.0, 2.0), (1, "z", 3, None, None, "default", 3.0, 3.0)], "bundle_id long, asset_name string, asset_seq long, units string, form_units string, source string, x double, y double")
    chosen = resolution.unit_resolution(a)
    assert [(r.units, r.conflicts) for r in chosen.collect()] == [("m", 1)]
    assert [r.category for r in resolution.unit_conflicts(a, chosen).collect()] == ["unit_conflict"]
    assert [(r.units, r.conflicts) for r in resolution.unit_resolution(a.withColumn("form_units", F.lit("mm")), "form_units").collect()] == [("mm", 1)]
    assert [(r.x, r.source) for r in resolution.origin_resolution(a).collect()] == [(2.0, "pdf_page_origin")]
    assert [r.x for r in resolution.origin_resolution(a.where("asset_seq <> 2")).collect()] == [3.0]
    t = spark.createDataFrame([(1, "x", 1, 1, "North 10"), (1, "x", 1, 2, "North 20"), (1, "y", 2, 3, "North 50")], "bundle_id long, asset_name string, asset_seq long, text_seq long, text string")
    assert [(r.north_angle, r.conflicts) for r in resolution.north_resolution(t).collect()] == [(20.0, 1)]


def test_grid_signature_and_validation(spark):
    axes = spark.createDataFrame([(1, "A1", "L", "vertical", 0.0), (1, "", "L", "vertical", 2.0), (1, "A1", "L", "vertical", 0.0), (1, "B", "L", "unknown", None)], "bundle_id long, label string, layer string, orientation string, coordinate double")
    assert [r.grid_signature for r in assembly.grid_signature(axes).collect()] == ["A1@0.000|B|L@2.000"]
    assert [r.grid_signature for r in assembly.grid_signature(axes, "unknown").collect()] == ["A1@0.000|B@unknown|L@2.000"]
    e = components.component_candidates(entities(spark, [entity(1), entity(2)]))
    m, f = assembly.manifests(e), frags(spark, [("3F", "3F", None)])
    issues = assembly.parser_validation(f.select('bundle_id'), m, assembly.chains(e), assembly.missing_storeys(f, m), axes.limit(0))
    assert sorted(r.category for r in issues.collect()) == ["duplicate_component", "grid_missing", "storey_missing"]
    assert [r[0] for r in issues.groupBy().agg(assembly.ready(issues)).collect()] == [False]
    both = assembly.storeys_with_fragments(m, f)
    assert sorted((r.storey_key, r.component_count) for r in both.collect()) == [("1F", 2), ("3F", 0)]


def test_classified_and_largest_boundary(spark):
    raw = [(1, "a", i, k, "L", role, block, [(0.0, 0.0), (float(w), 0.0), (float(w), 1.0)], closed) for i, (k, role, block, w, closed) in enumerate([("LINE", "wall", None, 1, False), ("LINE", "room", None, 1, False), ("LWPOLYLINE", "unknown", None, 2, True), ("LWPOLYLINE", "unknown", None, 2, True), ("POLYLINE", "space", None, 1, True), ("INSERT", "text", "door", 1, False)])]
    df = spark.createDataFrame(raw, f"bundle_id long, asset_name string, entity_seq long, dxftype string, layer string, role string, block_role string, points {PTS}, closed boolean")
    got = components.classified(df)
    assert sorted((r.entity_seq, r.category, r.confidence) for r in got.collect()) == [(0, "wall_line", 0.75), (2, "boundary_candidate", 0.45), (3, "boundary_candidate", 0.45), (4, "room_boundary", 0.82), (5, "door_block", 0.85)]
    assert [r.entity_seq for r in components.largest_boundary(got).collect()] == [2]


def test_openings_sit_on_their_walls(spark):
    wall = entity(1, at=((0.0, 0.0), (4000.0, 0.0)), ref="w1")
    axis = geometry.wall_axis(F.col("category"), F.col("points"), F.col("bbox"), F.lit(None).cast("string"), F.lit(0.001))
    walls = entities(spark, [wall, entity(2, at=((0.0, 0.0), (0.0, 3000.0)), ref="w2")]).select("bundle_id", "storey_key", F.col("entity_seq").alias("wall_seq"), F.col("source_ref").alias("handle"), axis.alias("axis"))
    openings = spark.createDataFrame([(1, "1F", 10, "door_block", 100.0, 600.0, []), (1, "1F", 11, "window_block", 2500.0, 1750.0, ["zz", "w2"]), (1, "9F", 12, "door_block", 0.0, 0.0, [])], "bundle_id long, storey_key string, entity_seq long, category string, x double, y double, parents array<string>")
    hosted = model.host_walls(openings, walls)
    got = {r.entity_seq: r for r in hosted.collect()}
    assert (got[10].wall_seq, got[10].rotation_deg, got[10].distance) == (2, 90.0, 100.0) and got[11].wall_seq == 2 and got[12].wall_seq is None
    extra = {"span": F.lit(None).cast("double"), "vendor_width": F.when(F.col("entity_seq") == 10, F.lit("1200")), "vendor_height": F.lit(None).cast("string"), "origin_x": F.lit(0.0), "origin_y": F.lit(0.0)}
    sized = {r.entity_seq: r for r in model.opening_geometry(hosted.withColumns(extra)).collect()}
    assert (sized[10].width_mm, sized[10].local_y_m, sized[10].depth_m, sized[11].width_mm, sized[12].rotation_deg) == (1200, 0.6, 0.22, 1500, 0.0)
    by_cell = {r.entity_seq: r.wall_seq for r in model.nearest_walls(openings.where("entity_seq = 10"), walls).collect()}
    assert by_cell == {10: 2}
    placed = model.wall_geometry(entities(spark, [wall]).withColumns({"vendor_width": F.lit("300"), "origin_x": F.lit(0.0), "origin_y": F.lit(0.0)}), F.lit(3.0)).first()
    assert (placed.width_m, placed.local_x_m, placed.local_y_m, placed.depth_m, placed.rotation_deg) == (4.0, 2.0, 0.0, 0.3, 0.0)


def test_layouts_and_replication(spark):
    rows = [entity(1, at=((0.0, 0.0), (4000.0, 2000.0))), entity(2, category="door_block", at=((-1000.0, 0.0),)), entity(3, category="room_boundary", at=((0.0, 0.0),), storey="2F")]
    layouts = model.storey_layouts(entities(spark, rows))
    assert [(r.storey_key, r.walls, r.doors, r.origin_x, r.width_m) for r in layouts.collect()] == [("1F", 1, 1, -1000.0, 4.0)]
    wanted = spark.createDataFrame([(1, 2, 3.0, 4.5)], "bundle_id long, floors int, standard double, first double")
    got = model.replicated_storeys(layouts, wanted).orderBy("storey_no").collect()
    assert [(r.storey_id, r.storey_key, r.source_storey_key, r.replicated, r.elevation_m) for r in got] == [("storey_01", "1F", "1F", False, 0.0), ("storey_02", "2F", "1F", True, 4.5)]
    assert model.model_metadata(layouts).first().storey_keys == ["1F"]


def test_templates_roofs_patch_reconciliation(spark):
    s = spark.createDataFrame([(1, "storey_01", 1, 2, 3.0), (2, "storey_01", 1, 0, 3.0)], "bundle_id long, storey_id string, storey_no int, units long, height_m double")
    e = model.template_elements(s)
    assert {(r.bundle_id, r.ifc_type): r["count"] for r in e.groupBy("bundle_id", "ifc_type").count().collect()} == {(1, "IfcWall"): 8, (1, "IfcSlab"): 1, (1, "IfcDoor"): 2, (1, "IfcWindow"): 4, (2, "IfcWall"): 8, (2, "IfcSlab"): 1, (2, "IfcDoor"): 4, (2, "IfcWindow"): 8}
    patched = model.apply_patch(e, spark.createDataFrame([(1, 800, 1200, "new")], "bundle_id long, width_mm long, height_mm long, target_family string"))
    assert patched.where("replaced").count() == 2 and patched.where("family_name = 'new'").count() == 2
    tops = spark.createDataFrame([(9, "storey_02", "hip", 45.0, 0.5)], "bundle_id long, storey_id string, roof_type string, slope_deg double, overhang_m double")
    none = spark.createDataFrame([], "bundle_id long, width_m double, depth_m double")
    assert [(r.family_name, r.ridge_height_m, r.roof_width_m) for r in model.roof_elements(tops, none).collect()] == [(f"hip_roof_{p}", 6.0, 31.0) for p in ("front", "back", "left", "right")]
    source = spark.createDataFrame([(1, "wall")] * 9 + [(1, "space")], "bundle_id long, component_type string")
    rec = model.reconciliation(source, e.where("bundle_id = 1"))
    assert {r.ifc_type: (r.source, r.modeled, r.delta) for r in rec.collect()} == {"IfcWall": (9, 8, -1), "IfcDoor": (0, 2, 2), "IfcWindow": (0, 4, 4)}
    assert [r.target for r in validation.reconciliation_issues(rec).collect()] == ["reconciliation.IfcWall"]


REQUEST = "bundle_id long, prompt string, mode_hint string, form_building_type string, form_floors long, form_height double, form_area double, form_far double, assets long, drawn_floors long, drawn_area double, region string"


def test_intents_and_rules(spark):
    rows = [(1, "一栋办公楼 office", "auto", None, None, None, None, None, 0, None, None, None), (2, "residential", "cad_to_bim", None, 0, 2.0, None, 6.0, 0, None, None, "cn"), (3, "十二层 住宅 1500 平方米", "auto", None, None, None, None, None, 2, 4, 90.0, "cn")]
    got = intents.build_intents(spark.createDataFrame(rows, REQUEST), intents.profiles(spark))
    r = {x.bundle_id: x for x in got.collect()}
    assert (r[1].building_type, r[1].ruleset, r[1].units_per_floor.value, r[1].source_mode, r[1].floors.value) == ("office", "cn_office_v1", 8, "text_only", 1)
    assert (r[3].floors.value, r[3].floors.source, r[3].site_area_sqm.value, r[2].far.value) == (102, "text_prompt", 1500.0, 6.0)
    assert sorted((m.bundle_id, m.field) for m in intents.missing_fields(got).collect()) == [(1, "region"), (1, "site.area_sqm")]
    assert [q.field for q in intents.clarifications(got).where("bundle_id = 1").orderBy("question_seq").collect()] == ["constraints.floors", "constraints.standard_floor_height_m", "constraints.first_floor_height_m", "program.units_per_floor"]
    plain = got.select("bundle_id", "building_type", "ruleset", "source_mode", "assets", F.col("floors.value").alias("floors"), F.col("standard_floor_height_m.value").alias("standard"), F.col("first_floor_height_m.value").alias("first"), F.col("far.value").alias("far"), F.col("site_area_sqm.value").alias("site_area"))
    reviews = spark.createDataFrame([(2, i, "multi_storey_asset_collapsed" if i == 0 else "unit_conflict", "warning", None, "a") for i in range(7)], "bundle_id long, review_seq long, category string, severity string, source_ref string, asset_name string")
    issues = rules.rule_issues(rules.with_ruleset(plain, rules.rulesets(spark)), reviews, intents.missing_fields(got))
    two = issues.where("bundle_id = 2").collect()
    assert {i.code for i in two} == {"floors.invalid", "floor_height.low", "source.assets_missing", "far.high", "site.area_missing", "drawing.review.multi_storey_asset_collapsed", "drawing.review.unit_conflict"}
    assert sum(i.code.startswith("drawing.") for i in two) == 5 and {i.severity for i in two if "collapsed" in i.code} == {"error"}
    trace = rules.rule_trace(plain.where("bundle_id = 2"), issues.where("bundle_id = 2")).orderBy("rule_seq").collect()
    assert len(trace) == 8 and trace[0].rule_id == "constraints.floors.min" and trace[0].highest_severity == "fatal" and trace[7].highest_severity == "passed"
    assert {s.bundle_id: s.status for s in rules.rule_status(plain, issues).collect()} == {1: "warning", 2: "failed", 3: "passed"}
    lost = rules.with_ruleset(plain.limit(1).withColumns({"ruleset": F.lit("x"), "building_type": F.lit("y")}), rules.rulesets(spark)).first()
    assert not lost.ruleset_found


def test_site_area(spark):
    e = entities(spark, [entity(1, category="site_boundary", at=((0.0, 0.0), (50.0, 0.0), (50.0, 30.0), (0.0, 30.0))), entity(2, category="site_boundary", at=(), bbox=(0.0, 0.0, 10.0, 10.0))])
    assert [r.site_area for r in intents.site_areas(e, spark.createDataFrame([(1, "m")], "bundle_id long, units string")).collect()] == [1500.0]


def test_gate(spark):
    schema = "bundle_id long, stage string, code string, severity string, target string, issue_seq long"
    rows = [(1, "rules", "drawing.review.multi_storey_asset_collapsed", "warning", "a", 1), (2, "rules", "x", "warning", "b", 1), (2, "model", "y", "info", "c", 2)]
    own = spark.createDataFrame(rows, schema)
    promoted = validation.formal_blockers(own)
    assert [(r.bundle_id, r.severity, r.target) for r in promoted.collect()] == [(1, "error", "formal_gate.drawing.review.multi_storey_asset_collapsed")]
    every = validation.all_issues(own.drop("issue_seq"), promoted)
    gate = {r.bundle_id: r for r in validation.export_gate(spark.createDataFrame([(1,), (2,), (3,)], "bundle_id long"), every).collect()}
    assert [(gate[i].status, gate[i].export_allowed, len(gate[i].artifacts)) for i in (1, 2, 3)] == [("failed", False, 3), ("warning", True, 5), ("passed", True, 5)]
    assert {r.bundle_id: r.issue_seq for r in validation.highlighted_issue(own).collect()} == {1: 1, 2: 2}


def test_model_checks(spark):
    e = spark.createDataFrame([(1, "storey_01", 1, "g", "e1"), (1, "storey_01", 2, "g", "e2"), (1, "storey_09", 3, "h", "e3")], "bundle_id long, storey_id string, element_seq long, guid string, element_id string")
    s = spark.createDataFrame([(1, "storey_01")], "bundle_id long, storey_id string")
    assert [r.element_id for r in validation.repeated_guids(e).collect()] == ["e2"]
    assert [r.target for r in validation.misplaced_elements(e, s).collect()] == ["e3"]
    wanted = spark.createDataFrame([(1, "cad_to_bim", 1, 2), (2, "text_only", 0, None)], "bundle_id long, source_mode string, floors long, source_storeys long")
    assert [r.bundle_id for r in validation.storey_count_issues(s, wanted).collect()] == [1]
    index = spark.createDataFrame([(1, "IfcWall", 3), (1, "IfcSlab", 1)], "bundle_id long, ifc_type string, elements long")
    assert sorted(r.target for r in validation.missing_types(s.select("bundle_id"), index).collect()) == ["IfcDoor", "IfcWindow"]
    b = spark.createDataFrame([("in", 9.2, 1.0), ("out", 9.4, 1.0), ("nameless", 0.0, 0.0)], "element_id string, local_x_m double, local_y_m double").withColumns({"bundle_id": F.lit(1), "geometry_source": F.lit("parsed_drawing"), "fragment_id": F.when(F.col("element_id") == "nameless", F.lit("")).otherwise(F.lit("f")), "source_storey_key": F.lit("1F"), "shape_width_m": F.lit(1.0), "shape_depth_m": F.lit(1.0), "geometry_anchor": F.lit("center"), "category": F.lit("window_block")})
    layout = spark.createDataFrame([(1, "1F", 9.0, 8.0)], "bundle_id int, storey_key string, width_m double, depth_m double")
    assert sorted((r.code, r.target) for r in validation.bounds_issues(b, layout).collect()) == [("fragment_missing", "nameless"), ("position_bounds", "out")]


def test_quality_and_proxies(spark):
    assets = spark.createDataFrame([(1, "a", "cad", None), (1, "b", "pdf", "scanned"), (1, "c", "cad", None)], "bundle_id long, asset_name string, kind string, pdf_type string")
    layers = spark.createDataFrame([(1, "a", "A-WALL", ["ACAD_PROXY_ENTITY"], "wall")], "bundle_id long, asset_name string, layer string, entity_types array<string>, semantic_role string")
    axes = spark.createDataFrame([(1, "c")], "bundle_id long, asset_name string")
    got = validation.parse_quality(assets, entities(spark, [entity(1, asset="c")]), layers, axes)
    assert sorted((r.asset_name, r.category) for r in got.collect()) == [("a", "grid_not_detected"), ("a", "proxy_entities_unresolved"), ("a", "wall_detection_low_confidence"), ("b", "pdf_scan_review")]
    counts = spark.createDataFrame([(1, "a", "door", "D", 2, 0, 1)], "bundle_id long, asset_name string, role string, layer string, proxies long, with_geometry long, first_seen long")
    segments = spark.createDataFrame([(1, "a", "X", 1, 0.0, 0.0, 4.0, 0.0)], "bundle_id long, asset_name string, layer string, seq long, x1 double, y1 double, x2 double, y2 double")
    made = proxies.fallback_entities(counts, segments).groupBy("category").count().collect()
    assert {r.category: r["count"] for r in made} == {"wall_line": 4, "door_block": 2}
    extents = spark.createDataFrame([(1, "a", (0.0, 0.0, 10.0, 5.0))], f"bundle_id long, asset_name string, extents {BOX}")
    last = proxies.footprint_entities(proxies.proxy_footprint(entities(spark, []), extents), counts)
    assert sorted((r.category, r.number, round(r.points[0].y, 3)) for r in last.collect()) == [("door_block", 1, 0.0), ("door_block", 2, 0.0)] + [("wall_line", i, float(i)) for i in range(1, 5)]


def test_caps_and_modes(spark):
    rows = spark.createDataFrame([(1, i) for i in range(100)], "bundle_id long, seq long")
    assert resolution.capped(rows, ["bundle_id"], "seq", resolution.CAPS["grid_axes"]).agg(F.max("seq"), F.count("*")).first() == (79, 80)
    assert resolution.capped(rows, ["bundle_id"], "seq", 0).count() == 0
    pages = spark.createDataFrame([(1, "a", 1, 1, 0), (1, "a", 0, 0, 1), (1, "b", 0, 0, 2)], "bundle_id long, asset_name string, text_count long, drawing_count long, image_count long")
    assert {r.asset_name: (r.pdf_type, r.page_count) for r in resolution.pdf_modes(pages).collect()} == {"a": ("hybrid", 2), "b": ("scanned", 1)}
    none = resolution.bundles_without_assets(spark.createDataFrame([(1,), (2,)], "bundle_id long"), pages)
    assert [r.bundle_id for r in none.collect()] == [2]


def test_form_values_of_first_floor_and_units_win(spark):
    rows = [(1, "office 首层层高 5.0 8 units", "auto", None, 3, 3.9, None, None, 0, None, None, "cn", 4.8, 0)]
    got = intents.build_intents(spark.createDataFrame(rows, REQUEST + ", form_first_height double, form_units long"), intents.profiles(spark))
    r = got.first()
    assert (r.first_floor_height_m.value, r.first_floor_height_m.source, r.units_per_floor.value) == (4.8, "form_input", 0)
    told = intents.traces(got).orderBy("trace_seq").collect()
    assert [t.field for t in told][:3] == ["building_type", "source_mode", "constraints.floors"] and [t.trace_seq for t in told] == list(range(1, len(told) + 1))
    usual = spark.createDataFrame([(2, "office", "auto", None, None, None, None, None, 0, None, None, "")], REQUEST)
    source = {t.field: t.source for t in intents.traces(intents.build_intents(usual, intents.profiles(spark))).collect()}
    assert source["constraints.floors"] == "office_template_default" and source["region"] == "system_default"


def test_conflicts_name_every_form_area_beside_a_boundary(spark):
    form = spark.createDataFrame([(1, 3, 1000.0), (2, 3, 1000.0), (3, None, None)], "bundle_id long, form_floors long, form_area double")
    drawn = spark.createDataFrame([(1, 3, True), (2, 2, False), (3, 2, True)], "bundle_id long, candidate_names long, site_boundary_detected boolean")
    assert sorted((r.bundle_id, r.field, r.text_value, r.drawing_value) for r in intents.conflicts(form, drawn).collect()) == [(1, "site.area_sqm", 1000.0, "图纸推断面积"), (2, "constraints.floors", 3.0, "2")]


def test_template_goes_unit_by_unit(spark):
    rows = spark.createDataFrame([(1, "s", 1, 0, 3.0)], "bundle_id long, storey_id string, storey_no int, units long, height_m double")
    got = [r.name for r in model.template_elements(rows).orderBy("element_seq").collect()][9:]
    assert got == [f"{k} {i}{e}" for i in range(1, 5) for k, e in (("户门", ""), ("窗", "-A"), ("窗", "-B"))]


def test_bundle_of_fragments_alone_is_validated(spark):
    f = spark.createDataFrame([(9, "plan", "2F")], "bundle_id long, fragment_role string, storey_key string")
    m = spark.createDataFrame([], "bundle_id long, storey_key string, component_count long, duplicates long")
    none = spark.createDataFrame([], "bundle_id long")
    assert sorted(r.category for r in assembly.parser_validation(f, m, none, assembly.missing_storeys(f, m), none).collect()) == ["grid_missing", "storey_missing"]


def test_nearest_wall_equals_brute_force_at_every_distance(spark):
    import random

    rng = random.Random(1)
    at = lambda: rng.choice([1.0, 30.0, 5e4, 9e6, 1e12]) * rng.uniform(-1, 1)
    walls = [(1, "1F", i, (x, y), (x + rng.choice([0, 50, 9e3, 4e6]), y + rng.choice([0, 700.0]))) for i, (x, y) in enumerate((at(), at()) for _ in range(120))]
    openings = [(1, "1F", 1000 + i, at(), at()) for i in range(80)]
    df = spark.createDataFrame(walls, "bundle_id long, storey_key string, wall_seq long, a struct<x:double,y:double>, b struct<x:double,y:double>").select("bundle_id", "storey_key", "wall_seq", F.struct(F.col("a").alias("start"), F.col("b").alias("end")).alias("axis"))
    got = {r.entity_seq: r for r in model.nearest_walls(spark.createDataFrame(openings, "bundle_id long, storey_key string, entity_seq long, x double, y double"), df).collect()}

    def away(x, y, s, e):
        dx, dy = e[0] - s[0], e[1] - s[1]
        q = dx * dx + dy * dy
        f = 0 if q <= 1e-9 else max(0, min(1, ((x - s[0]) * dx + (y - s[1]) * dy) / q))
        return ((x - s[0] - dx * f) ** 2 + (y - s[1] - dy * f) ** 2) ** 0.5

    for _, _, i, x, y in openings:
        best = min((away(x, y, s, e), n) for _, _, n, s, e in walls)
        assert abs(got[i].distance - best[0]) <= 1e-6 * max(1, best[0])


def test_grid_layers(spark):
    names = ["A-AXIS", "axis", "S_GRID.1", "taxis", "gridded", "轴线", None, ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string")
    assert [r.g for r in df.select("i", text.is_grid_layer(F.col("n")).alias("g")).orderBy("i").collect()] == [True, True, True, False, False, True, False, False]


def test_placed_elements_keep_hosts_in_every_copy(spark):
    storeys = spark.createDataFrame([(1, "storey_01", "1F", 3.0), (1, "storey_02", "1F", 2.0), (2, "storey_01", "2F", 3.0)], "bundle_id long, storey_id string, source_storey_key string, height_m double")
    layouts = spark.createDataFrame([(1, "1F", 0.0, 1000.0, 9.0, 7.0, 4500.0, 4500.0), (2, "2F", 0.0, 0.0, 4.0, 2.0, None, None)], "bundle_id long, storey_key string, origin_x double, origin_y double, width_m double, depth_m double, wall_center_x double, wall_center_y double")
    walls = spark.createDataFrame([(1, "1F", 7, "wall_line", "", 1.5, 0.5, 9.0, 0.2, 90.0), (1, "1F", 9, "wall_path", "core", 1.0, 2.0, 3.0, 4.0, 0.0)], "bundle_id long, storey_key string, entity_seq long, category string, label string, local_x_m double, local_y_m double, width_m double, depth_m double, rotation_deg double")
    openings = spark.createDataFrame([(1, "1F", 11, "door_block", None, 1.5, 0.25, 90.0, 900, 2100, 0.22, 7), (1, "1F", 12, "window_block", None, 5.0, 5.0, 0.0, 1500, 1500, 0.12, None)], "bundle_id long, storey_key string, entity_seq long, category string, label string, local_x_m double, local_y_m double, rotation_deg double, width_mm long, height_mm long, depth_m double, wall_seq long")
    rows = model.placed_elements(storeys, layouts, walls, openings).collect()
    assert len(rows) == 2 * 5 + 1 and len({r.guid for r in rows}) == len({r.element_id for r in rows}) == len(rows)
    at = {(r.bundle_id, r.storey_id, r.ifc_type, r.source_seq): r for r in rows}
    for storey, height in (("storey_01", 3.0), ("storey_02", 2.8)):
        wall, door, window, slab = at[1, storey, "IfcWall", 7], at[1, storey, "IfcDoor", 11], at[1, storey, "IfcWindow", 12], at[1, storey, "IfcSlab", None]
        assert (wall.name, wall.height_m, wall.family_name, at[1, storey, "IfcWall", 9].name) == ("图纸墙体 1", height, "cad_wall_line", "core")
        assert (door.host_element_id, door.host_guid) == (wall.element_id, wall.guid) and (door.local_z_m, door.width_m, door.height_m, door.rotation_deg) == (0.0, 0.9, 2.1, 90.0)
        assert window.host_element_id is None and window.host_guid is None and window.local_z_m == 0.9
        assert (slab.name, slab.local_x_m, slab.local_y_m, slab.height_m) == (f"图纸楼板 {storey[-2:]}", 4.5, 3.5, 0.12)
    assert (at[2, "storey_01", "IfcSlab", None].local_x_m, at[2, "storey_01", "IfcSlab", None].local_y_m) == (2.0, 1.0)


def test_replicated_storeys_read_layouts_once_and_a_null_name_has_no_guid(spark, tmp_path):
    spark.createDataFrame([(1, 1, "1F"), (1, 2, "2F"), (2, 1, "1F"), (3, 1, "1F")], "bundle_id long, layout_seq int, storey_key string").write.parquet(f"{tmp_path}/layouts")
    wanted = spark.createDataFrame([(1, 4, 3.0, 4.5), (2, 0, 3.0, 4.5), (3, None, 3.0, 4.5)], "bundle_id long, floors int, standard double, first double")
    rows = model.replicated_storeys(spark.read.parquet(f"{tmp_path}/layouts"), wanted)
    got = sorted((r.bundle_id, r.storey_no, r.storey_key, r.source_storey_key, r.replicated) for r in rows.collect())
    assert got == [(1, 1, "1F", "1F", False), (1, 2, "2F", "2F", False), (1, 3, "3F", "2F", True), (1, 4, "4F", "2F", True), (2, 1, "1F", "1F", False), (3, 1, "1F", "1F", False)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert spark.range(1).select(ids.guid(F.lit(None).cast("string"))).first()[0] is None
