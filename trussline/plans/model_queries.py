"""Queries over requests, rules, models, gates, registry tables and feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry, ids
from ..operators import components, intents, model, rules, validation
from ..sources import dxf, registry
from ..sources.tables import table
from ..streaming import feeds
from .drawing_queries import _entities
from .views import view


def _intents(spark, sf_dir):
    return intents.build_intents(view(spark, sf_dir, "v_requests"), intents.profiles(spark))


def _plain(rows):
    """Intents with plain values, as the rules take them."""
    return rows.select("bundle_id", "building_type", "ruleset", "source_mode", "assets", "region", F.col("floors.value").alias("floors"), F.col("standard_floor_height_m.value").alias("standard"), F.col("first_floor_height_m.value").alias("first"), F.col("far.value").alias("far"), F.col("site_area_sqm.value").alias("site_area"), F.col("patch").isNotNull().alias("has_patch"))


def _reviews(spark, sf_dir):
    v = view(spark, sf_dir, "v_requests")
    kinds = F.array(F.lit("unit_conflict"), F.lit("multi_storey_asset_collapsed"), F.lit("grid_not_detected"))
    rows = v.select("bundle_id", F.explode(F.sequence(F.lit(0), (F.col("bundle_id") % 8).cast("int"))).alias("review_seq"))
    return rows.select("bundle_id", "review_seq", F.get(kinds, F.col("review_seq") % 3).alias("category"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("source_ref"), F.concat(F.lit("a"), F.col("review_seq").cast("string")).alias("asset_name"))


def _issues(spark, sf_dir):
    rows = _intents(spark, sf_dir)
    return rules.rule_issues(rules.with_ruleset(_plain(rows), rules.rulesets(spark)), _reviews(spark, sf_dir))


def intent_resolve(spark, sf_dir):
    rows = _intents(spark, sf_dir)
    return rows.select("bundle_id", F.col("floors.value").alias("floors"), F.col("floors.source").alias("floors_source"), F.col("standard_floor_height_m.value").alias("standard_height"), F.col("first_floor_height_m.value").alias("first_height"), F.col("site_area_sqm.value").alias("site_area"), F.col("site_area_sqm.source").alias("area_source"), F.col("far.value").alias("far"), F.col("units_per_floor.value").alias("units"), "ruleset")


def intent_traces(spark, sf_dir):
    return intents.traces(_intents(spark, sf_dir)).groupBy("field", "source").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("confidence"))


def missing_fields(spark, sf_dir):
    return intents.missing_fields(_intents(spark, sf_dir)).groupBy("field").agg(F.count("*").alias("n"), F.min("bundle_id").alias("first_bundle"))


def clarifications(spark, sf_dir):
    return intents.clarifications(_intents(spark, sf_dir)).groupBy("question_seq", "field").agg(F.count("*").alias("n"))


def conflicts(spark, sf_dir):
    v = view(spark, sf_dir, "v_requests")
    drawn = v.select("bundle_id", (F.col("bundle_id") % 4).alias("candidate_names"), (F.col("bundle_id") % 3 > 0).alias("site_boundary_detected"))
    return intents.conflicts(v.select("bundle_id", "form_floors", "form_area"), drawn)


def rule_issues(spark, sf_dir):
    return _issues(spark, sf_dir).groupBy("rule_seq", "code", "severity").agg(F.count("*").alias("n"), F.min("bundle_id").alias("first_bundle"))


def rule_trace(spark, sf_dir):
    rows = view(spark, sf_dir, "v_requests").select("bundle_id")
    return rules.rule_trace(rows, _issues(spark, sf_dir)).groupBy("rule_seq", "rule_id", "highest_severity").agg(F.count("*").alias("bundles"), F.sum("issue_count").alias("issues"))


def rule_status(spark, sf_dir):
    return rules.rule_status(view(spark, sf_dir, "v_requests").select("bundle_id"), _issues(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("bundles"), F.sum("total").alias("issues"), F.sum("fatal").alias("fatal"))


def solver_constraints(spark, sf_dir):
    return rules.solver_constraints(_plain(_intents(spark, sf_dir)))


def strategy_steps(spark, sf_dir):
    plain = _plain(_intents(spark, sf_dir))
    status = rules.rule_status(plain, _issues(spark, sf_dir))
    planned = rules.strategies(plain, status)
    return rules.strategy_steps(planned, ("can_continue",)).groupBy("strategy", "step_seq", "step").agg(F.count("*").alias("bundles"), F.count_if("can_continue").alias("continuing"))


def replay_tokens(spark, sf_dir):
    rows = view(spark, sf_dir, "v_requests")
    token = ids.stable_hash({"floors": F.col("form_floors"), "prompt": F.col("prompt"), "bundle": F.col("bundle_id")})
    return rows.select("bundle_id", token.alias("token"), ids.plan_id(token).alias("plan_id"))


def guids(spark, sf_dir):
    seed = F.concat(F.lit("p:"), F.col("entity_seq").cast("string"), F.lit(":"), "category")
    rows = view(spark, sf_dir, "v_entities").withColumn("guid", ids.guid(seed))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("guid").alias("guids"), F.count_distinct(ids.short_guid(F.col("guid"))).alias("short_guids"), F.count_if(F.col("guid").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("well_formed"))


def _layouts(spark, sf_dir):
    return model.storey_layouts(_entities(spark, sf_dir).where("category in ('wall_line', 'wall_path', 'door_block', 'window_block', 'room_boundary')"))


def storey_layout(spark, sf_dir):
    return _layouts(spark, sf_dir).drop("wall_center_x", "wall_center_y")


def storey_replication(spark, sf_dir):
    wanted = view(spark, sf_dir, "v_entities").select("bundle_id").distinct().select("bundle_id", (F.col("bundle_id") % 9 + 1).cast("int").alias("floors"), F.lit(3.0).alias("standard"), F.lit(4.5).alias("first"))
    return model.replicated_storeys(_layouts(spark, sf_dir), wanted)


def _walls(spark, sf_dir):
    e = _entities(spark, sf_dir).where("category in ('wall_line', 'wall_path')")
    axis = geometry.wall_axis(F.col("category"), F.col("points"), F.col("bbox"), F.lit(None).cast("string"), F.lit(0.001))
    return e.select("bundle_id", "storey_key", F.col("entity_seq").alias("wall_seq"), "handle", axis.alias("axis"))


def _openings(spark, sf_dir):
    e = _entities(spark, sf_dir).where("category in ('door_block', 'window_block')")
    parents = F.when(F.col("k") % 5 == 0, F.array(F.concat(F.lit("h"), (F.col("entity_seq") - 40).cast("string")), F.concat(F.lit("h"), (F.col("entity_seq") - 80).cast("string")))).otherwise(F.array().cast("array<string>"))
    return e.select("bundle_id", "storey_key", "entity_seq", "category", F.col("x1").alias("x"), F.col("y1").alias("y"), parents.alias("parents"))


def host_wall(spark, sf_dir):
    return model.host_walls(_openings(spark, sf_dir), _walls(spark, sf_dir)).select("entity_seq", "wall_seq", F.round("distance", 3).alias("distance"))


def host_wall_cells(spark, sf_dir):
    rows = model.nearest_walls(_openings(spark, sf_dir), _walls(spark, sf_dir))
    return rows.select("entity_seq", F.round("distance", 3).alias("distance"))


def wall_geometry(spark, sf_dir):
    e = _entities(spark, sf_dir).where("category in ('wall_line', 'wall_path')").withColumns({"vendor_width": F.lit(None).cast("string"), "origin_x": F.lit(500.0), "origin_y": F.lit(0.0)})
    return model.wall_geometry(e, F.lit(3.0)).select("entity_seq", "local_x_m", "local_y_m", "width_m", "depth_m", "rotation_deg")


def opening_geometry(spark, sf_dir):
    hosted = model.host_walls(_openings(spark, sf_dir), _walls(spark, sf_dir)).withColumns({"span": F.lit(None).cast("double"), "vendor_width": F.when(F.col("entity_seq") % 3 == 0, F.lit("900")), "vendor_height": F.lit(None).cast("string"), "origin_x": F.lit(0.0), "origin_y": F.lit(0.0)})
    return model.opening_geometry(hosted).groupBy("category").agg(F.count("*").alias("n"), F.sum("width_mm").alias("width_mm"), F.sum("height_mm").alias("height_mm"))


def placed_elements(spark, sf_dir):
    """Elements of all storeys that follow drawings, copies included: placement, size, and which wall's element, in which
    storey, an opening's host id names."""
    layouts = _layouts(spark, sf_dir)
    origin = layouts.select("bundle_id", "storey_key", "origin_x", "origin_y")
    none = F.lit(None).cast("string")
    e = _entities(spark, sf_dir).where("category in ('wall_line', 'wall_path')").withColumn("vendor_width", none).join(origin, ["bundle_id", "storey_key"])
    walls = model.wall_geometry(e, F.lit(3.0)).drop("height_m")
    hosted = model.host_walls(_openings(spark, sf_dir), _walls(spark, sf_dir)).join(origin, ["bundle_id", "storey_key"])
    openings = model.opening_geometry(hosted.withColumns({"span": none.cast("double"), "vendor_width": none, "vendor_height": none, "label": none}))
    rows = model.placed_elements(storey_replication(spark, sf_dir).withColumn("height_m", F.lit(3.0)), layouts, walls, openings)
    hosts = rows.where("ifc_type = 'IfcWall'").select(F.col("guid").alias("host_guid"), F.col("element_id").alias("_id"), F.col("storey_id").alias("host_storey"), F.col("source_seq").alias("host_seq"))
    # Elements without a host are dealt out by their own id: as nulls they would all meet in one task.
    rows = rows.withColumn("host_guid", F.coalesce("host_guid", F.concat(F.lit("none of "), "guid")))
    found = rows.join(hosts, "host_guid", "left").withColumn("id_agrees", F.col("_id").eqNullSafe(F.col("host_element_id")))
    columns = ("bundle_id", "storey_id", "ifc_type", "source_seq", "name", "family_name", "local_x_m", "local_y_m", "local_z_m", "rotation_deg", "width_m", "depth_m", "height_m", "host_storey", "host_seq", "id_agrees")
    return found.select(*columns)


def template_elements(spark, sf_dir):
    rows = view(spark, sf_dir, "v_requests").select("bundle_id", F.lit("storey_01").alias("storey_id"), F.lit(1).alias("storey_no"), F.when(F.col("bundle_id") % 2 == 0, (F.col("bundle_id") % 6)).alias("units"), F.lit(3.0).alias("height_m"))
    return model.template_layout(model.template_elements(rows)).groupBy("ifc_type", "family_name").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 2).alias(c) for c in ("layout_x", "layout_y", "layout_rotation")), F.sum("element_seq").alias("places"))


def roof_parts(spark, sf_dir):
    tops = view(spark, sf_dir, "v_entities").select("bundle_id").distinct().select("bundle_id", F.lit("storey_09").alias("storey_id"), F.get(F.array(*map(F.lit, ("gable", "hip", "shed", "flat"))), (F.col("bundle_id") % 4).cast("int")).alias("roof_type"), F.lit(30.0).alias("slope_deg"), F.lit(0.6).alias("overhang_m"))
    return model.roof_elements(tops, _layouts(spark, sf_dir))


def element_index(spark, sf_dir):
    return model.element_index(view(spark, sf_dir, "v_elements"))


def reconciliation(spark, sf_dir):
    e = view(spark, sf_dir, "v_elements")
    return model.reconciliation(e.select("bundle_id", "component_type"), e.select("bundle_id", "ifc_type"))


def patched_families(spark, sf_dir):
    rows = view(spark, sf_dir, "v_requests").select("bundle_id", F.lit("storey_01").alias("storey_id"), F.lit(1).alias("storey_no"), F.lit(2).alias("units"), F.lit(3.0).alias("height_m"))
    patches = _intents(spark, sf_dir).where("patch is not null").select("bundle_id", "patch.*")
    return model.apply_patch(model.template_elements(rows), patches).groupBy("family_name").agg(F.count("*").alias("n"), F.count_if("replaced").alias("replacements"))


def guid_uniqueness(spark, sf_dir):
    e = view(spark, sf_dir, "v_elements").withColumn("guid", F.concat("ifc_type", F.floor("l_extendedprice").cast("string")))
    return validation.repeated_guids(e).groupBy("bundle_id").agg(F.count("*").alias("repeats"))


def bounds_check(spark, sf_dir):
    e = model.wall_geometry(_entities(spark, sf_dir).where("category in ('wall_line', 'wall_path')").withColumns({"vendor_width": F.lit(None).cast("string"), "origin_x": F.lit(0.0), "origin_y": F.lit(0.0)}), F.lit(3.0))
    e = e.select("bundle_id", F.col("storey_key").alias("source_storey_key"), F.lit("parsed_drawing").alias("geometry_source"), F.when(F.col("k") % 10 > 0, F.lit("f")).otherwise(F.lit("")).alias("fragment_id"), "local_x_m", "local_y_m", F.col("width_m").alias("shape_width_m"), F.col("depth_m").alias("shape_depth_m"), F.lit("center").alias("geometry_anchor"), "category", F.col("handle").alias("element_id"))
    small = _layouts(spark, sf_dir).withColumns({"width_m": F.lit(9.0), "depth_m": F.lit(8.0)})
    return validation.bounds_issues(e, small).select("bundle_id", "code", "target")


def gate(spark, sf_dir):
    v = view(spark, sf_dir, "v_issues")
    rows = validation.export_gate(v.select("bundle_id").distinct(), v.withColumn("message", F.concat("code", F.lit(" "), (F.col("issue_seq") % 7).cast("string"))))
    return rows.select("bundle_id", "status", "export_allowed", "warning", "error", "fatal", "formal_blockers", F.size("artifacts").cast("long").alias("artifacts"), F.array_join("blocked_by", "|").alias("blocked_by"))


def formal_blockers(spark, sf_dir):
    return validation.formal_blockers(view(spark, sf_dir, "v_issues")).groupBy("bundle_id", "target").agg(F.count("*").alias("n"))


def highlighted_issue(spark, sf_dir):
    return validation.highlighted_issue(view(spark, sf_dir, "v_issues")).select("bundle_id", "issue_seq", "severity")


def issue_copy(spark, sf_dir):
    rows = validation.localized(view(spark, sf_dir, "v_issues"), "severity", validation.display_copy(spark), "label")
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def latest_version(spark, sf_dir):
    v = view(spark, sf_dir, "v_versions")
    return registry.latest_versions(registry.upsert_versions(v), "project_id")


def version_list(spark, sf_dir):
    v = registry.upsert_versions(view(spark, sf_dir, "v_versions"))
    return registry.latest_per(v, "project_id", 5).select("project_id", "version_id", "ingest_seq")


def asset_register(spark, sf_dir):
    p = view(spark, sf_dir, "v_pages").withColumn("content", F.col("content").cast("binary"))
    return registry.register_assets(p).select("page_id", "storage_name", "extension", "size_bytes", "content_hash")


def integrity(spark, sf_dir):
    p = view(spark, sf_dir, "v_pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), "page_id", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))
    stored = p.where("page_id % 7 <> 0").withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).withColumn("content_hash", F.when(F.col("page_id") % 3 == 0, F.lit("x")).otherwise(F.col("content_hash")))
    return registry.integrity_violations(p, stored).select("path", "violation")


def reference_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_custkey") + 7).alias("asset_ids")).distinct()
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return registry.unknown_references(orders, "asset_ids", known, "o_custkey", array=True).groupBy("unknown_id").agg(F.count("*").alias("n"))


def numbered_ids(spark, sf_dir):
    v = view(spark, sf_dir, "v_versions").select("ingest_seq", "created_at")
    return registry.numbered(v, "ver", ["ingest_seq"], after=100).select("ingest_seq", "id")


def snapshots(spark, sf_dir):
    v = view(spark, sf_dir, "v_versions").select("project_id", "version_id", "topic", "ingest_seq")
    back = registry.from_snapshot(registry.to_snapshot(v, ["project_id", "version_id", "topic"]).select("ingest_seq", "snapshot_json"), "project_id long, version_id string, topic string")
    return back.groupBy("project_id", "topic").agg(F.count("*").alias("n"), F.max("version_id").alias("last_id"))


def _drawn(e):
    """Entities (with kind, category, handle and two corners) as lists of tags: asset_name, q, tags (code, value), between
    the ends of a section. Blocks own an attribute, and doors also define one."""
    pair = lambda c, v: F.struct(F.lit(c).alias("code"), v.cast("string").alias("value"))
    at = lambda x, y: (pair(10, F.col(x)), pair(20, F.col(y)))
    layer, handle = pair(8, F.col("kind")), pair(5, F.col("handle"))
    poly = F.array(pair(0, F.lit("LWPOLYLINE")), layer, pair(70, F.lit(1)), *at("x1", "y1"), *at("x2", "y2"), *at("x1", "y2"))
    line = F.array(pair(0, F.lit("LINE")), handle, layer, *at("x1", "y1"), pair(11, F.col("x2")), pair(21, F.col("y2")))
    block = F.array(pair(0, F.lit("INSERT")), pair(2, F.concat("kind", F.lit("_block"))), *at("x1", "y1"))
    owned = F.concat(block, F.array(pair(0, F.lit("ATTRIB")), pair(1, F.lit("owned")), *at("x2", "y2"), pair(0, F.lit("SEQEND"))))
    defined = F.array(pair(0, F.lit("ATTDEF")), pair(1, F.col("label")), *at("x1", "y2"))
    kinds = F.when(F.col("category") == "wall_line", line).when(F.col("category") == "door_block", F.concat(owned, defined)).when(F.col("category") == "window_block", owned).otherwise(poly)
    body = e.select("asset_name", F.col("entity_seq").alias("q"), kinds.alias("tags"))
    frame = lambda q, *v: F.struct(F.lit(q).cast("long").alias("q"), F.array(*(pair(c, F.lit(w)) for c, w in v)).alias("tags"))
    ends = F.explode(F.array(frame(-2, (0, "SECTION"), (2, "ENTITIES")), frame(1 << 40, (0, "ENDSEC"), (0, "EOF")))).alias("f")
    return body.unionByName(e.select("asset_name").distinct().select("asset_name", ends).select("asset_name", "f.*"))


def _drawn_summary(tags):
    got = dxf.entities(tags).withColumns({"bundle_id": F.lit(0), "role": F.col("layer"), "block_role": F.regexp_extract("block_name", "^[a-z]+", 0)})
    got = components.classified(got.withColumn("role", F.when(F.col("dxftype") == "INSERT", F.lit("text")).otherwise(F.col("role"))))
    sums = (F.count("*").alias("entities"), F.sum(F.size("points").cast("long")).alias("points"), F.round(F.sum("bbox.max_x"), 3).alias("max_x"))
    return got.where("dxftype <> 'ATTDEF'").groupBy("asset_name", "dxftype", "category").agg(*sums)


def dxf_entities(spark, sf_dir):
    """Drawings of every asset as tags, and the entities that the tag job finds in them."""
    tags = _drawn(view(spark, sf_dir, "v_entities")).select("asset_name", "q", F.posexplode("tags").alias("i", "t"))
    return _drawn_summary(tags.select("asset_name", (F.col("q") * 100 + F.col("i")).alias("tag_seq"), "t.code", "t.value"))


def dxf_files(spark, sf_dir):
    """A drawing file for every bundle, written line by line and read back by byte ranges: entities and attribute texts."""
    e = view(spark, sf_dir, "v_entities").withColumn("asset_name", F.concat(F.lit("bundle_"), F.col("bundle_id").cast("string")))
    text = F.array_join(F.transform("tags", lambda t: F.concat(t["code"].cast("string"), F.lit("\n"), t["value"])), "\n")
    lines = _drawn(e).select("asset_name", "q", text.alias("line"))
    path = f"{_shared_dir(spark)}/drawings-{uuid.uuid4().hex}"
    # An entity is one row until it is written, and partitions are not put together, so that few drawings share a task.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(n, "asset_name").sortWithinPartitions("asset_name", "q").select("asset_name", "line").write.partitionBy("asset_name").text(path)
    tags = dxf.read_tags(spark, path, "*.txt", name=F.regexp_extract("path", "asset_name=([^/]+)/", 1))
    per = dxf.entities(tags).groupBy("asset_name", "dxftype")
    return per.agg(F.count("*").alias("entities"), F.count("text").alias("texts"), F.max("text").alias("last_text"), F.sum(F.size("points").cast("long")).alias("points"))


def feedback_counts(spark, sf_dir):
    """Feedback counted by a stream that reads the events until none is left."""
    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet*").parquet(f"{sf_dir}/events.parquet*")
    stream = source.select(F.concat(F.lit("ver_"), (F.col("event_id") % 97).cast("string")).alias("version_id"), F.col("event_type").alias("topic"))
    run = f"{_shared_dir(spark)}/feedback-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    feeds.feedback_counts(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(f"{run}/out")
    last = counts.agg(F.max("batch")).first()[0]
    return counts.where(F.col("batch") == last).select("version_id", "topic", "n")


def _shared_dir(spark):
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _local_dir(spark)).rstrip("/")


def _local_dir(spark):
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="trussline-stream-")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_I = """i AS (SELECT *, CASE WHEN form_building_type IS NOT NULL OR bundle_id % 5 IN (1, 4) THEN 'office' ELSE 'residential' END AS bt, CASE WHEN bundle_id % 5 = 0 THEN 1 + bundle_id % 30 END AS said,
  CASE WHEN mode_hint = 'cad_to_bim' OR assets > 0 THEN 'cad_to_bim' ELSE 'text_only' END AS mode FROM v_requests),
j AS (SELECT *, coalesce(form_floors, said, drawn_floors, 1) AS floors, CASE WHEN form_floors IS NOT NULL THEN 'form_input' WHEN said IS NOT NULL THEN 'text_prompt' WHEN drawn_floors IS NOT NULL THEN 'parsed_drawing' ELSE bt || '_template_default' END AS floors_source,
  CASE WHEN form_height IS NOT NULL THEN form_height WHEN bundle_id % 5 = 1 THEN 3.2 WHEN bundle_id % 5 = 0 THEN 4.5 WHEN bt = 'office' THEN 3.6 ELSE 3.0 END::DOUBLE AS standard_height,
  CASE WHEN form_first_height IS NOT NULL THEN form_first_height WHEN bundle_id % 5 = 0 THEN 4.5 WHEN bt = 'office' THEN 4.2 ELSE 3.3 END::DOUBLE AS first_height,
  coalesce(form_area, CASE WHEN bundle_id % 5 = 3 THEN 1200.0 END, drawn_area)::DOUBLE AS site_area,
  CASE WHEN form_area IS NOT NULL THEN 'form_input' WHEN bundle_id % 5 = 3 THEN 'text_prompt' WHEN drawn_area IS NOT NULL THEN 'parsed_drawing_inferred_boundary' END AS area_source,
  CASE WHEN bundle_id % 5 = 1 THEN 6.5 END::DOUBLE AS far, CASE WHEN form_units IS NOT NULL THEN form_units WHEN bundle_id % 5 = 4 THEN bundle_id % 12 WHEN bt = 'office' THEN 8 ELSE 4 END AS units, 'cn_' || bt || '_v1' AS ruleset FROM i)"""
_R = _I + """, u AS (
  SELECT bundle_id, 1 AS rule_seq, 'floors.invalid' AS code, 'fatal' AS severity FROM j WHERE floors < 1
  UNION ALL SELECT bundle_id, 2, 'floor_height.low', 'error' FROM j WHERE standard_height < CASE bt WHEN 'office' THEN 3.0 ELSE 2.8 END
  UNION ALL SELECT bundle_id, 3, 'first_floor_height.low', 'warning' FROM j WHERE first_height < CASE bt WHEN 'office' THEN 4.2 ELSE 3.0 END
  UNION ALL SELECT bundle_id, 4, 'source.assets_missing', 'fatal' FROM j WHERE mode = 'cad_to_bim' AND assets = 0
  UNION ALL SELECT bundle_id, 5, 'drawing.review.' || ['unit_conflict', 'multi_storey_asset_collapsed', 'grid_not_detected'][n % 3 + 1], CASE WHEN n % 3 = 1 THEN 'error' ELSE 'warning' END FROM (SELECT bundle_id, unnest(range(0, least(5, bundle_id % 8 + 1))) AS n FROM v_requests)
  UNION ALL SELECT bundle_id, 6, 'far.high', 'warning' FROM j WHERE far > 5
  UNION ALL SELECT bundle_id, 7, 'site.area_missing', 'warning' FROM j WHERE site_area IS NULL
  UNION ALL SELECT bundle_id, 8, 'missing.region', 'warning' FROM j WHERE region = ''
  UNION ALL SELECT bundle_id, 8, 'missing.site.area_sqm', 'warning' FROM j WHERE mode = 'text_only' AND site_area IS NULL)"""
_STATUS = "q AS (SELECT j.bundle_id, count(u.code) AS total, count(*) FILTER (WHERE severity = 'fatal') AS fatal, CASE WHEN bool_or(severity IN ('fatal', 'error')) THEN 'failed' WHEN count(u.code) > 0 THEN 'warning' ELSE 'passed' END AS status FROM j LEFT JOIN u ON u.bundle_id = j.bundle_id GROUP BY 1)"
_RULE_IDS = "('constraints.floors.min', 1), ('constraints.standard_floor_height.min', 2), ('constraints.first_floor_height.min', 3), ('source.assets.required_for_cad', 4), ('drawing.pending_review.forward', 5), ('constraints.far.warning_threshold', 6), ('site.area.required_for_delivery', 7), ('intent.missing_fields.forward', 8)"
_E = "e AS (SELECT *, CASE WHEN category IN ('door_block', 'window_block') THEN x1 ELSE x2 END AS bx, CASE WHEN category IN ('door_block', 'window_block') THEN y1 ELSE y2 END AS by_, kind = 'wall' AS w FROM v_entities)"
_LAYOUT = """l AS (SELECT bundle_id, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY storey_key) AS INTEGER) AS layout_seq, storey_key, count(*) FILTER (WHERE w) AS walls, count(*) FILTER (WHERE kind = 'door') AS doors, count(*) FILTER (WHERE kind = 'window') AS windows, count(*) FILTER (WHERE kind = 'room') AS rooms,
  min(x1) AS origin_x, min(y1) AS origin_y, round(greatest((max(bx) FILTER (WHERE w) - min(x1) FILTER (WHERE w)) * 0.001, 1.0), 3) AS width_m, round(greatest((max(by_) FILTER (WHERE w) - min(y1) FILTER (WHERE w)) * 0.001, 1.0), 3) AS depth_m FROM e GROUP BY bundle_id, storey_key HAVING bool_or(w))"""
_HOST = """w AS (SELECT bundle_id, storey_key, entity_seq AS wall_seq, handle, category,
  CASE WHEN category = 'wall_line' THEN x1 WHEN x2 - x1 >= y2 - y1 THEN x1 ELSE (x1 + x2) / 2 END AS sx, CASE WHEN category = 'wall_line' THEN y1 WHEN x2 - x1 >= y2 - y1 THEN (y1 + y2) / 2 ELSE y1 END AS sy,
  CASE WHEN category = 'wall_line' THEN x2 WHEN x2 - x1 >= y2 - y1 THEN x2 ELSE (x1 + x2) / 2 END AS ex, CASE WHEN category = 'wall_line' THEN y2 WHEN x2 - x1 >= y2 - y1 THEN (y1 + y2) / 2 ELSE y2 END AS ey FROM v_entities WHERE kind = 'wall'),
o AS (SELECT bundle_id, storey_key, entity_seq, category, x1 AS x, y1 AS y, k FROM v_entities WHERE kind IN ('door', 'window')),
t AS (SELECT o.*, w.wall_seq, sx, sy, ex, ey, CASE WHEN (ex - sx) ** 2 + (ey - sy) ** 2 <= 1e-9 THEN 0 ELSE least(greatest(((x - sx) * (ex - sx) + (y - sy) * (ey - sy)) / ((ex - sx) ** 2 + (ey - sy) ** 2), 0), 1) END AS f,
  o.k % 5 = 0 AND (handle = 'h' || CAST(o.entity_seq - 40 AS STRING) OR handle = 'h' || CAST(o.entity_seq - 80 AS STRING)) AS parent FROM o JOIN w ON o.bundle_id = w.bundle_id AND o.storey_key = w.storey_key),
d AS (SELECT *, sqrt((x - sx - (ex - sx) * f) ** 2 + (y - sy - (ey - sy) * f) ** 2) AS distance FROM t)"""
ORACLES = {
    "intent_resolve": f"WITH {_I} SELECT bundle_id, floors, floors_source, standard_height, first_height, site_area, area_source, far, units, ruleset FROM j",
    "intent_traces": f"""
WITH {_I}, k AS (SELECT *, assets > 0 AS drawn, CASE WHEN form_first_height IS NOT NULL THEN 'form_input' WHEN bundle_id % 5 = 0 THEN 'text_prompt' ELSE bt || '_template_default' END AS first_source,
  CASE WHEN form_units IS NOT NULL THEN 'form_input' WHEN bundle_id % 5 = 4 THEN 'text_prompt' ELSE bt || '_template_default' END AS units_source, CASE WHEN form_height IS NOT NULL THEN 'form_input' WHEN bundle_id % 5 < 2 THEN 'text_prompt' ELSE bt || '_template_default' END AS height_source,
  CASE WHEN form_building_type IS NOT NULL THEN 'form_input' WHEN bundle_id % 5 IN (2, 3) THEN 'template_default' ELSE 'text_prompt' END AS type_source, CASE WHEN assets > 0 THEN 'parsed_drawing' ELSE 'system_default' END AS told FROM j),
c AS (SELECT *, CASE floors_source WHEN 'form_input' THEN 1.0 WHEN 'text_prompt' THEN 0.85 WHEN 'parsed_drawing' THEN 0.72 ELSE 0.6 END AS floors_c FROM k),
t AS (
  SELECT 'building_type' AS field, type_source AS source, CASE type_source WHEN 'form_input' THEN 1.0 ELSE 0.8 END AS c FROM c
  UNION ALL SELECT 'source_mode', CASE WHEN drawn THEN 'parsed_assets' ELSE 'system_default' END, CASE WHEN drawn THEN 0.95 ELSE 0.6 END FROM c
  UNION ALL SELECT 'constraints.floors', floors_source, floors_c FROM c
  UNION ALL SELECT f, s, CASE s WHEN 'form_input' THEN 1.0 WHEN 'text_prompt' THEN 0.85 ELSE 0.6 END FROM (SELECT 'constraints.standard_floor_height_m' AS f, height_source AS s FROM c UNION ALL SELECT 'constraints.first_floor_height_m', first_source FROM c UNION ALL SELECT 'program.units_per_floor', units_source FROM c)
  UNION ALL SELECT 'site.area_sqm', area_source, CASE area_source WHEN 'form_input' THEN 1.0 WHEN 'text_prompt' THEN 0.85 ELSE 0.7 END FROM c WHERE area_source IS NOT NULL
  UNION ALL SELECT 'constraints.far', 'text_prompt', 0.85 FROM c WHERE far IS NOT NULL
  UNION ALL SELECT 'region', 'system_default', 0.5 FROM c WHERE region = ''
  UNION ALL SELECT 'constraints.ruleset', 'building_type_ruleset', 0.85 FROM c
  UNION ALL SELECT 'site.boundary_source', told, CASE WHEN drawn THEN 0.8 ELSE 0.6 END FROM c
  UNION ALL SELECT 'site.north_angle', told, CASE WHEN drawn THEN 0.75 ELSE 0.4 END FROM c
  UNION ALL SELECT 'program.spaces_from_drawings', told, CASE WHEN drawn THEN 0.75 ELSE 0.5 END FROM c
  UNION ALL SELECT 'model_patch', 'text_prompt', 0.9 FROM c WHERE bundle_id % 5 = 2
  UNION ALL SELECT 'element_selector', 'text_prompt', 0.85 FROM c WHERE bundle_id % 5 = 2
  UNION ALL SELECT 'deliverables', 'template_default', 0.8 FROM c
  UNION ALL SELECT 'final_use', 'system_default', 0.8 FROM c
  UNION ALL SELECT 'roof.roof_type', 'text_prompt', 0.85 FROM c WHERE bundle_id % 5 = 3)
SELECT field, source, count(*) AS n, CAST(round(sum(c), 3) AS DOUBLE) AS confidence FROM t GROUP BY 1, 2""",
    "missing_fields": f"WITH {_R} SELECT substr(code, 9) AS field, count(*) AS n, min(bundle_id) AS first_bundle FROM u WHERE rule_seq = 8 GROUP BY 1",
    "clarifications": f"""
WITH {_I}, a AS (SELECT bundle_id, 3 AS place, 'constraints.floors' AS field FROM j WHERE floors_source LIKE '%template_default' UNION ALL SELECT bundle_id, 4, 'constraints.standard_floor_height_m' FROM j WHERE form_height IS NULL AND bundle_id % 5 > 1
  UNION ALL SELECT bundle_id, 5, 'constraints.first_floor_height_m' FROM j WHERE form_first_height IS NULL AND bundle_id % 5 > 0 UNION ALL SELECT bundle_id, 9, 'program.units_per_floor' FROM j WHERE form_units IS NULL AND bundle_id % 5 <> 4),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY place) AS INTEGER) AS question_seq FROM a) SELECT question_seq, field, count(*) AS n FROM n WHERE question_seq <= 5 GROUP BY 1, 2""",
    "conflicts": """
SELECT bundle_id, 'constraints.floors' AS field, CAST(form_floors AS DOUBLE) AS text_value, CAST(bundle_id % 4 AS STRING) AS drawing_value, 'use_text' AS resolution, '用户明确指定层数，优先使用文本输入' AS reason FROM v_requests WHERE bundle_id % 4 > 0 AND form_floors <> bundle_id % 4
UNION ALL SELECT bundle_id, 'site.area_sqm', form_area, '图纸推断面积', 'use_text', '用户提供的用地面积优先于图纸推断' FROM v_requests WHERE form_area IS NOT NULL AND bundle_id % 3 > 0""",
    "rule_issues": f"WITH {_R} SELECT rule_seq, code, severity, count(*) AS n, min(bundle_id) AS first_bundle FROM u GROUP BY 1, 2, 3",
    "rule_trace": f"""WITH {_R}, r(rule_id, rule_seq) AS (VALUES {_RULE_IDS}), g AS (SELECT bundle_id, rule_seq, count(*) AS n, arg_max(severity, CASE severity WHEN 'fatal' THEN 3 WHEN 'error' THEN 2 ELSE 1 END) AS top FROM u GROUP BY 1, 2)
SELECT r.rule_seq, r.rule_id, coalesce(top, 'passed') AS highest_severity, count(*) AS bundles, CAST(sum(coalesce(n, 0)) AS BIGINT) AS issues FROM j CROSS JOIN r LEFT JOIN g ON g.bundle_id = j.bundle_id AND g.rule_seq = r.rule_seq GROUP BY 1, 2, 3""",
    "rule_status": f"WITH {_R}, {_STATUS} SELECT status, count(*) AS bundles, CAST(sum(total) AS BIGINT) AS issues, CAST(sum(fatal) AS BIGINT) AS fatal FROM q GROUP BY 1",
    "solver_constraints": f"WITH {_I} SELECT bundle_id, round(first_height + greatest(floors - 1, 0) * standard_height, 2) AS max_height_m, floors AS storey_count FROM j",
    "strategy_steps": f"""WITH {_R}, {_STATUS}, p AS (SELECT j.bundle_id, CASE WHEN j.bundle_id % 5 = 2 THEN 'element_batch_replace' WHEN mode = 'cad_to_bim' THEN 'cad_to_bim' ELSE 'text_to_massing' END AS strategy, status <> 'failed' AS ok FROM j JOIN q ON q.bundle_id = j.bundle_id),
s AS (SELECT strategy, ok, CASE strategy WHEN 'text_to_massing' THEN ['normalize_inputs', 'transform_intent', 'evaluate_rules', 'build_bim', 'validate_and_export'] ELSE ['normalize_inputs', 'parse_drawings', 'transform_intent', 'evaluate_rules', 'build_bim', 'validate_and_export'] END AS steps FROM p),
x AS (SELECT strategy, ok, CAST(unnest(range(0, len(steps))) AS INTEGER) AS step_seq, unnest(steps) AS step FROM s) SELECT strategy, step_seq, step, count(*) AS bundles, count(*) FILTER (WHERE ok) AS continuing FROM x GROUP BY 1, 2, 3""",
    "replay_tokens": """WITH t AS (SELECT bundle_id, sha256('{"bundle":' || bundle_id || ',"floors":' || coalesce(CAST(form_floors AS STRING), 'null') || ',"prompt":"' || prompt || '"}') AS token FROM v_requests) SELECT bundle_id, token, 'plan_' || token[1:12] AS plan_id FROM t""",
    "guids": "SELECT category, count(*) AS n, count(*) AS guids, count(*) AS short_guids, count(*) AS well_formed FROM v_entities GROUP BY 1",
    "storey_layout": f"WITH {_E}, {_LAYOUT} SELECT * FROM l",
    "storey_replication": f"""WITH {_E}, {_LAYOUT}, n AS (SELECT bundle_id, count(*) AS n FROM l GROUP BY 1), s AS (SELECT bundle_id, n, unnest(range(1, greatest(n, bundle_id % 9 + 1) + 1)) AS i FROM n),
r AS (SELECT s.bundle_id, s.i, s.n, l.storey_key AS source_storey_key, CASE WHEN s.i > s.n THEN CAST(s.i AS STRING) || 'F' ELSE l.storey_key END AS storey_key FROM s JOIN l ON l.bundle_id = s.bundle_id AND l.layout_seq = least(s.i, s.n))
SELECT bundle_id, 'storey_' || lpad(CAST(i AS STRING), 2, '0') AS storey_id, CAST(i AS INTEGER) AS storey_no, storey_key, source_storey_key, i > n AS replicated, round(CASE WHEN storey_key = '1F' THEN 0 ELSE 4.5 + (CAST(replace(storey_key, 'F', '') AS DOUBLE) - 2) * 3.0 END, 2)::DOUBLE AS elevation_m FROM r""",
    "host_wall": f"WITH {_HOST}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_seq ORDER BY NOT parent, CASE WHEN parent THEN 0 ELSE distance END, wall_seq) AS n FROM d) SELECT o.entity_seq, r.wall_seq, round(r.distance, 3) AS distance FROM o LEFT JOIN r ON r.entity_seq = o.entity_seq AND n = 1",
    "host_wall_cells": f"WITH {_HOST} SELECT entity_seq, round(min(distance), 3) AS distance FROM d GROUP BY 1",
    "wall_geometry": """
SELECT entity_seq, round(((x1 + x2) / 2 - 500) * 0.001, 3) + 0.0 AS local_x_m, round((y1 + y2) / 2 * 0.001, 3) AS local_y_m,
  round(CASE WHEN category = 'wall_line' THEN greatest(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * 0.001, 0.2) ELSE greatest((x2 - x1) * 0.001, 0.2) END, 3) AS width_m,
  round(CASE WHEN category = 'wall_line' THEN 0.2 ELSE greatest((y2 - y1) * 0.001, 0.2) END, 3)::DOUBLE AS depth_m, round(CASE WHEN category = 'wall_line' THEN degrees(atan2(y2 - y1, x2 - x1)) ELSE 0 END, 3) AS rotation_deg FROM v_entities WHERE kind = 'wall'""",
    "placed_elements": f"""
WITH {_E}, {_LAYOUT}, n AS (SELECT bundle_id, count(*) AS n FROM l GROUP BY 1), s AS (SELECT bundle_id, n, unnest(range(1, greatest(n, bundle_id % 9 + 1) + 1)) AS i FROM n),
st AS (SELECT s.bundle_id, 'storey_' || lpad(CAST(s.i AS STRING), 2, '0') AS storey_id, l.storey_key FROM s JOIN l ON l.bundle_id = s.bundle_id AND l.layout_seq = least(s.i, s.n)),
{_HOST}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_seq ORDER BY NOT parent, CASE WHEN parent THEN 0 ELSE distance END, wall_seq) AS rank FROM d),
c AS (SELECT bundle_id, storey_key, (min(x1) FILTER (WHERE w) + max(x2) FILTER (WHERE w)) / 2 AS cx, (min(y1) FILTER (WHERE w) + max(y2) FILTER (WHERE w)) / 2 AS cy FROM e GROUP BY 1, 2),
p AS (
  SELECT l.bundle_id, l.storey_key, 'IfcSlab' AS ifc_type, NULL::BIGINT AS source_seq, NULL AS name, 'cad_footprint_slab' AS family_name, (cx - origin_x) * 0.001 AS x, (cy - origin_y) * 0.001 AS y, 0.0 AS z, 0.0 AS turn, width_m, depth_m, 0.12 AS height_m, NULL::BIGINT AS host_seq
  FROM l JOIN c ON c.bundle_id = l.bundle_id AND c.storey_key = l.storey_key
  UNION ALL SELECT e.bundle_id, e.storey_key, 'IfcWall', entity_seq, label, 'cad_' || category, ((x1 + x2) / 2 - origin_x) * 0.001, ((y1 + y2) / 2 - origin_y) * 0.001, 0.0, CASE WHEN category = 'wall_line' THEN degrees(atan2(y2 - y1, x2 - x1)) ELSE 0 END,
    round(CASE WHEN category = 'wall_line' THEN greatest(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * 0.001, 0.2) ELSE greatest((x2 - x1) * 0.001, 0.2) END, 3), round(CASE WHEN category = 'wall_line' THEN 0.2 ELSE greatest((y2 - y1) * 0.001, 0.2) END, 3), 3.0, NULL
  FROM e JOIN l ON l.bundle_id = e.bundle_id AND l.storey_key = e.storey_key WHERE w
  UNION ALL SELECT o.bundle_id, o.storey_key, CASE o.category WHEN 'door_block' THEN 'IfcDoor' ELSE 'IfcWindow' END, o.entity_seq,
    CASE o.category WHEN 'door_block' THEN '图纸门 ' ELSE '图纸窗 ' END || CAST(row_number() OVER (PARTITION BY o.bundle_id, o.storey_key, o.category ORDER BY o.entity_seq) AS STRING), 'cad_' || o.category,
    (coalesce(sx + (ex - sx) * f, o.x) - origin_x) * 0.001, (coalesce(sy + (ey - sy) * f, o.y) - origin_y) * 0.001, CASE o.category WHEN 'door_block' THEN 0.0 ELSE 0.9 END,
    CASE WHEN (ex - sx) ** 2 + (ey - sy) ** 2 <= 1e-9 THEN 0 ELSE degrees(atan2(ey - sy, ex - sx)) END, CASE o.category WHEN 'door_block' THEN 1.0 ELSE 1.5 END,
    round(greatest(CASE o.category WHEN 'door_block' THEN 0.15 ELSE 0.12 END, CASE WHEN v.category = 'wall_line' THEN 0.2 ELSE greatest(0.2, least(v.x2 - v.x1, v.y2 - v.y1) * 0.001) END + 0.02), 3), CASE o.category WHEN 'door_block' THEN 2.1 ELSE 1.5 END, r.wall_seq
  FROM o JOIN l ON l.bundle_id = o.bundle_id AND l.storey_key = o.storey_key JOIN r ON r.entity_seq = o.entity_seq AND rank = 1 JOIN v_entities v ON v.entity_seq = r.wall_seq)
SELECT st.bundle_id, st.storey_id, ifc_type, source_seq, coalesce(name, '图纸楼板 ' || right(st.storey_id, 2)) AS name, family_name, round(x, 3)::DOUBLE + 0.0 AS local_x_m, round(y, 3)::DOUBLE + 0.0 AS local_y_m, z::DOUBLE AS local_z_m, round(turn, 3)::DOUBLE AS rotation_deg,
  width_m::DOUBLE AS width_m, depth_m::DOUBLE AS depth_m, height_m::DOUBLE AS height_m, CASE WHEN host_seq IS NOT NULL THEN st.storey_id END AS host_storey, host_seq, true AS id_agrees FROM st JOIN p ON p.bundle_id = st.bundle_id AND p.storey_key = st.storey_key""",
    "opening_geometry": "SELECT category, count(*) AS n, CAST(sum(CASE WHEN entity_seq % 3 = 0 THEN 900 WHEN kind = 'door' THEN 1000 ELSE 1500 END) AS BIGINT) AS width_mm, CAST(sum(CASE WHEN kind = 'door' THEN 2100 ELSE 1500 END) AS BIGINT) AS height_mm FROM v_entities WHERE kind IN ('door', 'window') GROUP BY 1",
    "template_elements": """
WITH b AS (SELECT bundle_id, CASE WHEN bundle_id % 2 = 0 THEN coalesce(nullif(bundle_id % 6, 0), 4) ELSE 4 END AS n FROM v_requests), s AS (SELECT unnest(range(0, n)) AS i FROM b)
SELECT 'IfcWall' AS ifc_type, 'generic_wall' AS family_name, 8 * count(*) AS n, round(96.0 * count(*), 2)::DOUBLE AS layout_x, round(56.0 * count(*), 2)::DOUBLE AS layout_y, round(360.0 * count(*), 2)::DOUBLE AS layout_rotation, CAST(28 * count(*) AS BIGINT) AS places FROM b
UNION ALL SELECT 'IfcSlab', 'generic_slab', count(*), round(12.0 * count(*), 2), round(7.0 * count(*), 2), 0, CAST(8 * count(*) AS BIGINT) FROM b
UNION ALL SELECT 'IfcDoor', 'unit_entry_door', count(*), round(sum(8.0 + i * 4), 2), round(0.35 * count(*), 2), 0, CAST(sum(9 + 3 * i) AS BIGINT) FROM s
UNION ALL SELECT 'IfcWindow', 'standard_window', count(*), round(sum(8.0 + i * 5), 2), round(13.7 * count(*), 2), 0, CAST(sum(10 + 3 * i) AS BIGINT) FROM s
UNION ALL SELECT 'IfcWindow', 'secondary_window', count(*), round(sum(8.0 + i * 5), 2), round(0.35 * count(*), 2), 0, CAST(sum(11 + 3 * i) AS BIGINT) FROM s""",
    "roof_parts": f"""WITH {_E}, {_LAYOUT}, z AS (SELECT bundle_id, max(width_m) AS w, max(depth_m) AS d, ['gable', 'hip', 'shed', 'flat'][bundle_id % 4 + 1] AS roof_type FROM l GROUP BY bundle_id),
p(roof_type, family_name) AS (VALUES ('gable', 'gable_roof_left'), ('gable', 'gable_roof_right'), ('hip', 'hip_roof_front'), ('hip', 'hip_roof_back'), ('hip', 'hip_roof_left'), ('hip', 'hip_roof_right'), ('shed', 'shed_roof'), ('flat', 'flat_roof'))
SELECT bundle_id, 'storey_09' AS storey_id, z.roof_type, family_name, CASE z.roof_type WHEN 'flat' THEN 0 WHEN 'shed' THEN round(d * tan(radians(30)), 2) ELSE round(d / 2 * tan(radians(30)), 2) END::DOUBLE AS ridge_height_m, round(w + 1.2, 3) AS roof_width_m,
  round(CASE z.roof_type WHEN 'gable' THEN d / 2 + 0.6 WHEN 'shed' THEN d + 0.6 ELSE d + 1.2 END, 3) AS roof_depth_m FROM z JOIN p ON p.roof_type = z.roof_type""",
    "element_index": "SELECT bundle_id, ifc_type, count(*) AS elements, CAST(sum(count(*)) OVER (PARTITION BY bundle_id) AS BIGINT) AS total FROM v_elements GROUP BY 1, 2",
    "reconciliation": """
WITH s AS (SELECT bundle_id, CASE component_type WHEN 'wall' THEN 'IfcWall' WHEN 'door' THEN 'IfcDoor' ELSE 'IfcWindow' END AS t, count(*) AS n FROM v_elements GROUP BY 1, 2), m AS (SELECT bundle_id, ifc_type AS t, count(*) AS n FROM v_elements WHERE ifc_type <> 'IfcSlab' GROUP BY 1, 2)
SELECT coalesce(s.bundle_id, m.bundle_id) AS bundle_id, coalesce(s.t, m.t) AS ifc_type, coalesce(s.n, 0) AS source, coalesce(m.n, 0) AS modeled, coalesce(m.n, 0) - coalesce(s.n, 0) AS delta FROM s FULL JOIN m ON s.bundle_id = m.bundle_id AND s.t = m.t""",
    "patched_families": """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE bundle_id % 5 = 2) AS p FROM v_requests)
SELECT 'generic_wall' AS family_name, 8 * n AS n, CAST(0 AS BIGINT) AS replacements FROM c UNION ALL SELECT 'generic_slab', n, 0 FROM c UNION ALL SELECT 'unit_entry_door', 2 * n, 0 FROM c UNION ALL SELECT 'secondary_window', 2 * n, 0 FROM c UNION ALL SELECT 'standard_window', 2 * (n - p), 0 FROM c UNION ALL SELECT 'floor_to_ceiling_window', 2 * p, 2 * p FROM c""",
    "guid_uniqueness": "WITH g AS (SELECT bundle_id, ifc_type, floor(l_extendedprice) AS f, count(*) AS n FROM v_elements GROUP BY 1, 2, 3) SELECT bundle_id, CAST(sum(n - 1) AS BIGINT) AS repeats FROM g GROUP BY 1 HAVING sum(n - 1) > 0",
    "bounds_check": """
SELECT bundle_id, 'fragment_missing' AS code, handle AS target FROM v_entities WHERE kind = 'wall' AND k % 10 = 0
UNION ALL SELECT bundle_id, 'position_bounds', handle FROM v_entities WHERE kind = 'wall' AND k % 10 > 0 AND (round((x1 + x2) / 2 * 0.001, 3) > 9.25 OR round((y1 + y2) / 2 * 0.001, 3) > 8.25)""",
    "gate": """
WITH m AS (SELECT *, code || ' ' || CAST(issue_seq % 7 AS STRING) AS message, severity IN ('error', 'fatal') AS sharp, severity IN ('error', 'fatal') AND target LIKE 'formal_gate.%' AS formal FROM v_issues),
g AS (SELECT bundle_id, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'fatal') AS fatal, count(*) FILTER (WHERE formal) AS formal_blockers, string_agg(message, '|' ORDER BY issue_seq) FILTER (WHERE sharp AND NOT formal) AS own FROM m GROUP BY 1),
f AS (SELECT bundle_id, message, min(issue_seq) AS s FROM m WHERE formal AND (bundle_id, message) NOT IN (SELECT bundle_id, message FROM m WHERE sharp AND NOT formal) GROUP BY 1, 2), x AS (SELECT bundle_id, string_agg(message, '|' ORDER BY s) AS more FROM f GROUP BY 1)
SELECT g.bundle_id, CASE WHEN error + fatal > 0 THEN 'failed' WHEN warning > 0 THEN 'warning' ELSE 'passed' END AS status, error + fatal = 0 AND formal_blockers = 0 AS export_allowed, warning, error, fatal, formal_blockers, CAST(CASE WHEN error + fatal = 0 AND formal_blockers = 0 THEN 5 ELSE 3 END AS BIGINT) AS artifacts, concat_ws('|', own, more) AS blocked_by FROM g LEFT JOIN x ON x.bundle_id = g.bundle_id""",
    "formal_blockers": "SELECT bundle_id, 'formal_gate.' || code AS target, count(*) AS n FROM v_issues WHERE code = 'drawing.review.multi_storey_asset_collapsed' AND severity NOT IN ('error', 'fatal') GROUP BY 1, 2",
    "highlighted_issue": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY CASE WHEN severity IN ('error', 'fatal') THEN 0 WHEN stage <> 'rules' THEN 1 ELSE 2 END, stage = 'rules', issue_seq) AS n FROM v_issues) SELECT bundle_id, issue_seq, severity FROM r WHERE n = 1",
    "issue_copy": "SELECT CASE severity WHEN 'info' THEN '提示' WHEN 'warning' THEN '警告' WHEN 'error' THEN '错误' ELSE '严重错误' END AS label, count(*) AS n FROM v_issues GROUP BY 1",
    "latest_version": "WITH u AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY ingest_seq DESC) AS n FROM v_versions) SELECT project_id, arg_max(version_id, ingest_seq) AS latest_version_id FROM u WHERE n = 1 GROUP BY 1",
    "version_list": "WITH u AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY ingest_seq DESC) AS n FROM v_versions), l AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, version_id DESC) AS m FROM u WHERE n = 1) SELECT project_id, version_id, ingest_seq FROM l WHERE m <= 5",
    "asset_register": """
WITH s AS (SELECT page_id, content, coalesce(nullif(trim(regexp_replace(regexp_extract(filename, '[^/\\\\]*$'), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'asset.bin') AS storage_name FROM v_pages)
SELECT page_id, storage_name, lower(regexp_extract(storage_name, '(\\.[^.]*)$', 1)) AS extension, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS content_hash FROM s""",
    "integrity": "SELECT 'p' || CAST(page_id AS STRING) AS path, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'size_mismatch' ELSE 'hash_mismatch' END AS violation FROM v_pages WHERE page_id % 7 = 0 OR page_id % 5 = 0 OR page_id % 3 = 0",
    "reference_check": "WITH o AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders), a AS (SELECT o_custkey AS id FROM o UNION ALL SELECT o_custkey + 7 FROM o) SELECT id AS unknown_id, count(*) AS n FROM a WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "numbered_ids": "SELECT ingest_seq, 'ver_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS STRING), 4, '0') ELSE CAST(n AS STRING) END AS id FROM (SELECT ingest_seq, 100 + row_number() OVER (ORDER BY ingest_seq) AS n FROM v_versions)",
    "snapshots": "SELECT project_id, topic, count(*) AS n, max(version_id) AS last_id FROM v_versions GROUP BY 1, 2",
    "dxf_entities": """
SELECT asset_name, CASE category WHEN 'wall_line' THEN 'LINE' WHEN 'door_block' THEN 'INSERT' WHEN 'window_block' THEN 'INSERT' ELSE 'LWPOLYLINE' END AS dxftype, category, count(*) AS entities,
  CAST(sum(CASE category WHEN 'wall_line' THEN 2 WHEN 'door_block' THEN 1 WHEN 'window_block' THEN 1 ELSE 3 END) AS BIGINT) AS points, round(sum(CASE WHEN kind IN ('door', 'window') THEN x1 ELSE x2 END), 3) AS max_x FROM v_entities GROUP BY 1, 2, 3""",
    "dxf_files": """
WITH d AS (SELECT 'bundle_' || CAST(bundle_id AS STRING) AS asset_name, category, label FROM v_entities),
 a AS (SELECT asset_name, CASE category WHEN 'wall_line' THEN 'LINE' WHEN 'door_block' THEN 'INSERT' WHEN 'window_block' THEN 'INSERT' ELSE 'LWPOLYLINE' END AS dxftype, NULL AS text,
   CASE category WHEN 'wall_line' THEN 2 WHEN 'door_block' THEN 1 WHEN 'window_block' THEN 1 ELSE 3 END AS n FROM d
  UNION ALL SELECT asset_name, 'ATTDEF', label, 1 FROM d WHERE category = 'door_block')
SELECT asset_name, dxftype, count(*) AS entities, count(text) AS texts, max(text) AS last_text, CAST(sum(n) AS BIGINT) AS points FROM a GROUP BY 1, 2""",
    "feedback_counts": "SELECT 'ver_' || CAST(event_id % 97 AS STRING) AS version_id, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2",
}
