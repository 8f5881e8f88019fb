"""Queries over what bundles say taken together: their lists, records and summaries, stored files, rules of a file, and
checks of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bundles, intents, proxies, rules, validation
from ..sources import registry
from ..sources.tables import table
from .drawing_queries import _C, _CHAINS, _MANIFEST, _SETS, CHAIN_TOLERANCE, _axes, _components, _entities, _fragments, _texts
from .model_queries import _I, _R, _RULE_IDS, _intents, _plain, _reviews
from .store_queries import _folder
from .views import view

#: Pages of one stored file.
PAGES = 20


def _list_items(spark, sf_dir):
    e, t, assets = _axes(spark, sf_dir), _texts(spark, sf_dir), view(spark, sf_dir, "v_assets")
    # Texts of one asset's floor plans repeat, those of others too: a value's first place counts.
    some = lambda c: F.when(c, F.col("text"))
    lists = [
        bundles.list_items(e, "grid_axes", F.concat_ws("@", "label", F.format_string("%.3f", "coordinate")), "entity_seq"),
        bundles.list_items(t, "dimensions", some(F.size(text.dimensions(F.col("text"))) > 0), "text_seq"),
        bundles.list_items(t, "texts", F.concat_ws(": ", "asset_name", "text"), "text_seq"),
        bundles.list_items(t, "storey_candidates", some(F.endswith("text", F.lit("plan"))), "text_seq"),
        bundles.list_items(e, "pending_review", F.when(F.col("orientation") == "angled", F.concat(F.lit("axis_angled "), F.col("handle"))), "entity_seq"),
        bundles.list_items(e, "unresolved", F.when(F.col("orientation") == "unknown", F.col("label")), "entity_seq"),
        bundles.list_items(assets, "pdf_modes", F.when(F.col("source") == "default", F.lit("vector")).otherwise(F.lit("hybrid")), "asset_seq"),
        bundles.list_items(assets, "asset_kinds", F.when(F.col("asset_seq") % 4 == 0, F.lit("pdf")).otherwise(F.lit("cad")), "asset_seq"),
    ]
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return rows


def bundle_lists(spark, sf_dir):
    """Eight lists of every bundle in asset order, under the limits that they have."""
    return bundles.bundle_lists(_list_items(spark, sf_dir))


def parse_analysis(spark, sf_dir):
    """The parse record of every bundle, all parts: counts, hashes of the longer ones."""
    told = _fragments(spark, sf_dir).withColumn("storey_key", F.concat((F.col("frag_seq") + F.col("bundle_id") % 3).cast("string"), F.lit("F")))
    axes = _axes(spark, sf_dir).where("label <> ''").withColumn("bundle_id", F.when(F.col("bundle_id") % 3 == 0, F.col("bundle_id")).otherwise(F.col("bundle_id") + 200))
    r = bundles.parse_analysis(_components(spark, sf_dir), told, axes, CHAIN_TOLERANCE)
    joined = lambda column, *parts: F.array_join(F.transform(column, lambda s: F.concat_ws(":", *(s[p].cast("string") for p in parts))), ",")
    total = lambda column, part: F.aggregate(column, F.lit(0).cast("long"), lambda n, s: n + s[part])
    columns = [
        joined("components", "component_type", "n").alias("components"),
        "component_count",
        joined("storeys", "storey_key", "component_count", "duplicates").alias("storeys"),
        F.array_join("storey_keys", ",").alias("storey_keys"),
        F.size("duplicates").cast("long").alias("duplicates"),
        total("duplicates", "copies").alias("copies"),
        F.sha2(joined("chains", "signature", "members"), 256).alias("chains_sha"),
        joined("need_review", "category", "n").alias("need_review"),
        joined("blocked", "category", "n").alias("blocked"),
        F.sha2(F.coalesce("grid_signature", F.lit("")), 256).alias("grid_sha"),
    ]
    return r.select("bundle_id", *columns, "ready", "cross_layer_ready")


def parsed_summary(spark, sf_dir):
    """The labelled summary of every request."""
    return intents.parsed_summary(_intents(spark, sf_dir))


def clarification_texts(spark, sf_dir):
    """Questions of every request with their answers; what is missing counts as critical where a request has drawings."""
    rows = _intents(spark, sf_dir)
    lacking = intents.missing_fields(rows, ("assets",)).withColumns({"critical": F.col("assets") > 0, "reason": F.concat(F.lit("no "), "field")})
    q = intents.clarifications(rows, lacking)
    return q.select("bundle_id", "question_seq", "question", F.array_join("suggested_answers", "|").alias("answers"), "confidence")


def stored_integrity(spark, sf_dir):
    """Files of PAGES pages each, written by the query and checked against what is declared of them: one in seven is not
    there, one in five has another size, one in three other content."""
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / PAGES).cast("long").alias("file"), "page_id", F.coalesce("html", F.lit("")).alias("html"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "html"))), lambda s: s["html"]), "\n")
    files = p.groupBy("file").agg(whole.alias("value"))
    run = _folder(spark, "stored")
    files.withColumn("part", F.col("file")).where("file % 7 <> 0").select("part", "value").write.partitionBy("part").text(f"{run}/files")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{run}/files")
    names = found.select(registry.relative_path(F.col("path"), f"{run}/files").alias("path")).withColumn("file", F.regexp_extract("path", r"^part=(\d+)/", 1).cast("long"))
    size, digest = F.octet_length("value").cast("long") + 1, F.sha2(F.concat("value", F.lit("\n")), 256)
    declared = files.join(names, "file", "left").select(
        "file",
        F.coalesce("path", F.concat(F.lit("part="), F.col("file").cast("string"))).alias("path"),
        (size + F.when(F.col("file") % 5 == 0, 1).otherwise(0)).alias("size_bytes"),
        F.when(F.col("file") % 3 == 0, F.sha2("value", 256)).otherwise(digest).alias("content_hash"),
    )
    return registry.stored_violations(spark, declared, f"{run}/files", relative=True).select("file", "violation", "size_bytes", "content_hash")


def configured_rules(spark, sf_dir):
    """All requests under the limits of a rule file: stricter first floors of offices, a higher floor area ratio."""
    sets = {r[0]: {"building_type": r[1], "min_floor_count": r[2], "min_standard_floor_height_m": r[3], "min_first_floor_height_m": 4.5 if r[1] == "office" else r[4]} for r in rules.RULESETS}
    entry = lambda values, kind: F.from_json(F.lit(_json(values)), kind)
    kind = "map<string,struct<building_type:string,min_floor_count:long,min_standard_floor_height_m:double,min_first_floor_height_m:double>>"
    config = F.struct(
        F.struct(F.lit(7.0).alias("max_far_warning")).alias("shared"),
        entry(sets, kind).alias("rulesets"),
        entry({r: f"rule {r}" for r, _, _ in rules.RULES}, "map<string,string>").alias("rule_descriptions"),
    )
    path = _folder(spark, "rules")
    spark.range(1).select(F.to_json(config).alias("value")).write.text(path)
    limits, told = rules.configured(spark, path)
    rows = _intents(spark, sf_dir)
    found = rules.rule_issues(rules.with_ruleset(_plain(rows), limits), _reviews(spark, sf_dir))
    trace = rules.rule_trace(rows.select("bundle_id"), found, told)
    return trace.groupBy("rule_seq", "rule_id", "description", "highest_severity").agg(F.count("*").alias("bundles"), F.sum("issue_count").alias("issues"))


def _json(value):
    import json

    return json.dumps(value)


def proxy_outcomes(spark, sf_dir):
    """All assets with their proxies: what could be modelled, what was made in their place, and the reviews that follow."""
    e = _entities(spark, sf_dir)
    near = F.col("asset_seq") % 3
    told = e.groupBy("bundle_id", "asset_name", "asset_seq").agg(
        F.count_if(F.col("k") >= 50).alias("proxies"),
        F.count_if((F.col("k") >= 98) & (near > 0)).alias("with_geometry"),
        F.count_if((F.col("k") < 2) & (near == 1)).alias("modeled"),
        F.count_if((F.col("category") == "wall_line") & (F.col("k") < 10)).alias("generated"),
    )
    return validation.proxy_reviews(told)


def vendor_wall_entities(spark, sf_dir):
    """Walls of vendor objects: segments read from their vectors, and those between the nodes of one vertical."""
    e = view(spark, sf_dir, "v_entities").where("kind = 'wall'")
    # Every fifth vector is upright, every seventh one place.
    x2 = F.when(F.col("k") % 5 == 0, F.col("x1")).when(F.col("k") % 7 == 0, F.col("x1")).otherwise(F.col("x2"))
    y2 = F.when(F.col("k") % 7 == 0, F.col("y1")).otherwise(F.col("y2"))
    packed = F.base64(F.encode(F.concat_ws(",", F.col("x1").cast("string"), x2.cast("string"), F.col("y1").cast("string"), y2.cast("string")), "UTF-16LE"))
    tags = F.map_from_arrays(F.array(F.lit(42), F.lit(300)), F.array(F.array((F.col("k") * 2).cast("string")), F.array(packed)))
    raw = e.select("bundle_id", "asset_name", "entity_seq", F.lit("TCH_WALL").alias("dxftype"), F.lit("W").alias("layer"), tags.alias("xtags"))
    rows = proxies.vendor_wall_entities(proxies.vendor_walls(raw))
    made = F.col("layer") == "WALL"
    return rows.groupBy("asset_name", made.alias("reconstructed"), "confidence").agg(F.count("*").alias("n"), F.sum("vendor_width").alias("width"), F.sum("bbox.min_x").alias("x"), F.sum("bbox.max_y").alias("y"), F.count_distinct("source_ref").alias("refs"))


def vendor_columns(spark, sf_dir):
    """Outlines of vendor columns: those with fewer than two points are none."""
    e = view(spark, sf_dir, "v_entities")
    n = (F.col("k") % 4).cast("int")
    line = lambda c, step: F.slice(F.array(*((F.col(c) + i * step).cast("string") for i in range(4))), F.lit(1), n)
    tags = F.map_from_arrays(F.array(F.lit(10), F.lit(20)), F.array(line("x1", 10), line("y1", 7)))
    raw = e.select("bundle_id", "asset_name", "entity_seq", F.lit("TCH_COLUMN").alias("dxftype"), F.lit("COL").alias("layer"), tags.alias("xtags"))
    c = proxies.vendor_columns(raw)
    return c.select("entity_seq", "category", F.size("points").cast("long").alias("points"), "bbox.max_x", "bbox.max_y", "confidence")


def model_checks(spark, sf_dir):
    """Checks of all models, as one table of issues: storeys that a model does not have, GUIDs that repeat, source geometry
    that was asked for and not read."""
    e = view(spark, sf_dir, "v_elements").withColumns({"storey_id": F.concat(F.lit("s"), (F.col("p_size") % 6).cast("string")), "element_id": F.concat(F.lit("e"), F.col("element_seq").cast("string"))})
    e = e.withColumn("guid", F.concat("ifc_type", F.floor("l_extendedprice").cast("string")))
    storeys = e.select("bundle_id").distinct().select("bundle_id", F.explode(F.sequence(F.lit(0), (F.lit(3) + F.col("bundle_id") % 3).cast("int"))).alias("n")).select("bundle_id", F.concat(F.lit("s"), F.col("n").cast("string")).alias("storey_id"))
    rows = _plain(_intents(spark, sf_dir))
    models = rows.select("bundle_id", "source_mode", F.when(F.col("bundle_id") % 2 == 0, F.lit("template_fallback")).otherwise(F.lit("parsed_drawing")).alias("geometry_source"), (F.col("bundle_id") % 3).alias("source_total"))
    reviews = _reviews(spark, sf_dir).withColumn("category", F.when(F.col("category") == "grid_not_detected", F.lit("proxy_entities_unresolved")).otherwise(F.col("category")))
    found = rules.rule_issues(rules.with_ruleset(rows, rules.rulesets(spark)), reviews, intents.missing_fields(_intents(spark, sf_dir)))
    repeats = validation.repeated_guids(e).select("bundle_id", *validation.issue_row("model", "guid", "error", "element_id"))
    every = validation.all_issues(validation.misplaced_elements(e, storeys), repeats, validation.source_geometry_issues(models, found))
    return every.groupBy("bundle_id", "stage", "code", "severity").agg(F.count("*").alias("n"), F.min("target").alias("first_target"))


QUERIES = {f.__name__: f for f in (bundle_lists, parse_analysis, parsed_summary, clarification_texts, stored_integrity, configured_rules, proxy_outcomes, vendor_wall_entities, vendor_columns, model_checks)}

_W = "CASE WHEN x1 = x2 AND y1 = y2 THEN 'unknown' WHEN abs(x2 - x1) <= abs(y2 - y1) * 0.2 THEN 'vertical' WHEN abs(y2 - y1) <= abs(x2 - x1) * 0.2 THEN 'horizontal' ELSE 'angled' END"
_GRID = f"CASE WHEN k % 2 = 0 THEN label ELSE '' END || '@' || printf('%.3f', CASE WHEN {_W} = 'vertical' THEN x1 ELSE y1 END)"
#: Which fields a template default fills, in the order in which they are settled.
_ASSUMED = """
  SELECT bundle_id, 3 AS place, 'constraints.floors' AS field, '1' AS value, bt FROM j WHERE floors_source LIKE '%template_default'
  UNION ALL SELECT bundle_id, 4, 'constraints.standard_floor_height_m', CASE bt WHEN 'office' THEN '3.6' ELSE '3.0' END, bt FROM j WHERE form_height IS NULL AND bundle_id % 5 > 1
  UNION ALL SELECT bundle_id, 5, 'constraints.first_floor_height_m', CASE bt WHEN 'office' THEN '4.2' ELSE '3.3' END, bt FROM j WHERE form_first_height IS NULL AND bundle_id % 5 > 0
  UNION ALL SELECT bundle_id, 9, 'program.units_per_floor', CASE bt WHEN 'office' THEN '8' ELSE '4' END, bt FROM j WHERE form_units IS NULL AND bundle_id % 5 <> 4"""
#: The request rules under the limits of `configured_rules`.
_CONFIGURED = _R.replace("WHEN 'office' THEN 4.2 ELSE 3.0", "WHEN 'office' THEN 4.5 ELSE 3.0").replace("WHERE far > 5", "WHERE far > 7")
ORACLES = {
    "bundle_lists": f"""
WITH i AS (
  SELECT bundle_id, 'grid_axes' AS list, asset_seq, entity_seq AS item_seq, {_GRID} AS value FROM v_entities
  UNION ALL SELECT bundle_id, 'dimensions', asset_seq, text_seq, text FROM v_texts WHERE text_kind IN (3, 5)
  UNION ALL SELECT bundle_id, 'texts', asset_seq, text_seq, asset_name || ': ' || text FROM v_texts
  UNION ALL SELECT bundle_id, 'storey_candidates', asset_seq, text_seq, text FROM v_texts WHERE text_kind = 1
  UNION ALL SELECT bundle_id, 'pending_review', asset_seq, entity_seq, 'axis_angled ' || handle FROM v_entities WHERE {_W} = 'angled'
  UNION ALL SELECT bundle_id, 'unresolved', asset_seq, entity_seq, CASE WHEN k % 2 = 0 THEN label ELSE '' END FROM v_entities WHERE {_W} = 'unknown'
  UNION ALL SELECT bundle_id, 'pdf_modes', asset_seq, asset_seq, CASE source WHEN 'default' THEN 'vector' ELSE 'hybrid' END FROM v_assets
  UNION ALL SELECT bundle_id, 'asset_kinds', asset_seq, asset_seq, CASE WHEN asset_seq % 4 = 0 THEN 'pdf' ELSE 'cad' END FROM v_assets),
d AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, list, value ORDER BY asset_seq, item_seq) AS again FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, list ORDER BY asset_seq, item_seq, value) AS place FROM d WHERE again = 1 OR list NOT IN ('texts', 'storey_candidates', 'unresolved', 'pdf_modes')),
l AS (SELECT *, CASE WHEN list IN ('dimensions', 'texts') THEN 120 WHEN list IN ('grid_axes', 'pending_review') THEN 80 END AS most FROM p)
SELECT bundle_id, list, asset_seq, CAST(item_seq AS BIGINT) AS item_seq, value, CAST(CASE WHEN most > 0 THEN place END AS INTEGER) AS place FROM l WHERE most IS NULL OR place <= most""",
    "parse_analysis": f"""
WITH {_C}, {_SETS}, {_MANIFEST}, {_CHAINS},
t AS (SELECT bundle_id, string_agg(kind || ':' || n, ',' ORDER BY kind) AS components, CAST(sum(n) AS BIGINT) AS component_count FROM (SELECT bundle_id, kind, count(*) AS n FROM v_entities GROUP BY 1, 2) GROUP BY 1),
st AS (SELECT bundle_id, string_agg(storey_key || ':' || component_count || ':' || duplicates, ',' ORDER BY storey_key) AS storeys, string_agg(storey_key, ',' ORDER BY storey_key) AS storey_keys, CAST(sum(duplicates) AS BIGINT) AS d, count(*) AS n FROM m GROUP BY 1),
dd AS (SELECT bundle_id, count(*) AS duplicates, CAST(sum(n) AS BIGINT) AS copies FROM s WHERE n > 1 GROUP BY 1),
hs AS (SELECT *, kind || ':' || array_to_string(keys, ';') AS sig FROM h),
hh AS (SELECT bundle_id, string_agg(sig || ':' || members, ',' ORDER BY sig, x, y, members) AS chains FROM hs GROUP BY 1),
a AS (SELECT DISTINCT CASE WHEN bundle_id % 3 = 0 THEN bundle_id ELSE bundle_id + 200 END AS bundle_id, {_GRID} AS v FROM v_entities WHERE k % 2 = 0),
g AS (SELECT bundle_id, string_agg(v, '|' ORDER BY v) AS grid FROM a GROUP BY 1),
o AS (SELECT DISTINCT bundle_id, CAST(frag_seq + bundle_id % 3 AS STRING) || 'F' AS storey_key FROM v_fragments),
x AS (SELECT o.bundle_id, count(*) AS n FROM o LEFT JOIN m ON m.bundle_id = o.bundle_id AND m.storey_key = o.storey_key WHERE m.bundle_id IS NULL GROUP BY 1),
b AS (SELECT bundle_id FROM v_entities UNION SELECT bundle_id FROM o UNION SELECT bundle_id FROM a)
SELECT b.bundle_id, coalesce(components, '') AS components, coalesce(component_count, 0) AS component_count, coalesce(storeys, '') AS storeys, coalesce(storey_keys, '') AS storey_keys, coalesce(duplicates, 0) AS duplicates, coalesce(copies, 0) AS copies,
  sha256(coalesce(chains, '')) AS chains_sha, concat_ws(',', CASE WHEN st.n >= 2 AND chains IS NULL THEN 'cross_layer_alignment:' || st.n END, CASE WHEN d > 0 THEN 'duplicate_component:' || d END, CASE WHEN grid IS NULL THEN 'grid_missing:0' END) AS need_review,
  CASE WHEN x.n > 0 THEN 'storey_missing:' || x.n ELSE '' END AS blocked, sha256(coalesce(grid, '')) AS grid_sha, x.n IS NULL AS ready, chains IS NOT NULL AS cross_layer_ready
FROM b LEFT JOIN t USING (bundle_id) LEFT JOIN st USING (bundle_id) LEFT JOIN dd USING (bundle_id) LEFT JOIN hh USING (bundle_id) LEFT JOIN g USING (bundle_id) LEFT JOIN x USING (bundle_id)""",
    "parsed_summary": f"""
WITH {_I}, a AS ({_ASSUMED}), n AS (SELECT j.*, 1 + CAST(j.bundle_id % 5 = 3 AS INTEGER) + (SELECT count(*) FROM a WHERE a.bundle_id = j.bundle_id) AS assumed, CAST(region = '' AS INTEGER) + CAST(mode = 'text_only' AND site_area IS NULL AS INTEGER) AS lacking FROM j)
SELECT bundle_id, concat_ws('；', '建筑类型：' || CASE bt WHEN 'office' THEN '办公' ELSE '住宅' END, '模式：' || CASE mode WHEN 'cad_to_bim' THEN 'CAD驱动建模' ELSE '文本描述建模' END, '层数：' || floors || ' 层', '标准层层高：' || standard_height || 'm',
  CASE WHEN site_area <> 0 THEN '用地面积：' || site_area || '㎡' END, CASE WHEN far <> 0 THEN '容积率：' || far END, CASE WHEN assets > 0 THEN '已解析图纸：' || assets || ' 份' END, '系统假设：' || assumed || ' 项', CASE WHEN lacking > 0 THEN '待确认项：' || lacking || ' 项' END,
  CASE WHEN bundle_id % 5 = 2 THEN '修改指令：replace_family → floor_to_ceiling_window' END) AS summary FROM n""",
    "clarification_texts": f"""
WITH {_I}, a AS ({_ASSUMED}), q AS (
  SELECT bundle_id, 0 AS kind, place, field, '系统假设 ' || field || ' 为 ' || value || '（来源：' || bt || '_template_default），是否正确？' AS question, '正确，继续|需要修改' AS answers, 0.6::DOUBLE AS confidence FROM a
  UNION ALL SELECT bundle_id, 1, 0, 'region', '缺少关键信息：no region', '稍后补充|使用默认值', 0.3::DOUBLE FROM j WHERE region = '' AND assets > 0
  UNION ALL SELECT bundle_id, 1, 0, 'site.area_sqm', '缺少关键信息：no site.area_sqm', '稍后补充|使用默认值', 0.3::DOUBLE FROM j WHERE mode = 'text_only' AND site_area IS NULL AND assets > 0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY bundle_id ORDER BY kind, place, field) AS INTEGER) AS question_seq FROM q)
SELECT bundle_id, question_seq, question, answers, confidence FROM n WHERE question_seq <= 5""",
    "stored_integrity": f"""
WITH f AS (SELECT CAST(page_id // {PAGES} AS BIGINT) AS file, string_agg(coalesce(html, ''), chr(10) ORDER BY page_id) AS v FROM pages GROUP BY 1)
SELECT file, CASE WHEN file % 7 = 0 THEN 'missing' WHEN file % 5 = 0 THEN 'size_mismatch' ELSE 'hash_mismatch' END AS violation, CAST(octet_length(encode(v)) + 1 + CAST(file % 5 = 0 AS INTEGER) AS BIGINT) AS size_bytes,
  CASE WHEN file % 3 = 0 THEN sha256(v) ELSE sha256(v || chr(10)) END AS content_hash FROM f WHERE file % 7 = 0 OR file % 5 = 0 OR file % 3 = 0""",
    "configured_rules": f"""
WITH {_CONFIGURED}, r AS (SELECT * FROM (VALUES {_RULE_IDS}) v(rule_id, rule_seq)),
c AS (SELECT bundle_id, rule_seq, count(*) AS n, max(list_position(['info', 'warning', 'error', 'fatal'], severity)) AS top FROM u GROUP BY 1, 2)
SELECT CAST(r.rule_seq AS INTEGER) AS rule_seq, rule_id, 'rule ' || rule_id AS description, coalesce(['info', 'warning', 'error', 'fatal'][top], 'passed') AS highest_severity, count(*) AS bundles, CAST(sum(coalesce(n, 0)) AS BIGINT) AS issues
FROM j CROSS JOIN r LEFT JOIN c ON c.bundle_id = j.bundle_id AND c.rule_seq = r.rule_seq GROUP BY 1, 2, 3, 4""",
    "proxy_outcomes": """
WITH a AS (SELECT bundle_id, asset_name, count(*) FILTER (WHERE k >= 50) AS proxies, count(*) FILTER (WHERE k >= 98 AND asset_seq % 3 > 0) AS shaped, count(*) FILTER (WHERE k < 2 AND asset_seq % 3 = 1) AS modeled, count(*) FILTER (WHERE category = 'wall_line' AND k < 10) AS made FROM v_entities GROUP BY 1, 2)
SELECT bundle_id, asset_name, CASE WHEN made > 0 THEN 'proxy_geometry_approximated' ELSE 'proxy_geometry_unresolved' END AS category, 'warning' AS severity FROM a WHERE proxies > 0 AND modeled = 0
UNION ALL SELECT bundle_id, asset_name, 'proxy_virtual_entities_empty', 'warning' FROM a WHERE proxies > 0 AND shaped = 0""",
    "vendor_wall_entities": """
WITH v AS (SELECT asset_name, k, x1, y1, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN x1 ELSE x2 END AS x2, CASE WHEN k % 7 = 0 THEN y1 ELSE y2 END AS y2 FROM v_entities WHERE kind = 'wall'),
n AS (SELECT asset_name, x1 AS x, y1 AS y FROM v WHERE x1 = x2 OR y1 = y2 UNION SELECT asset_name, x2, y2 FROM v WHERE x1 = x2 OR y1 = y2),
p AS (SELECT *, lead(y) OVER (PARTITION BY asset_name, x ORDER BY y) AS y2, row_number() OVER (PARTITION BY asset_name, x ORDER BY y) AS part FROM n)
SELECT asset_name, false AS reconstructed, 0.84::DOUBLE AS confidence, count(*) AS n, CAST(sum(k * 2) AS DOUBLE) AS width, sum(least(x1, x2)) AS x, sum(greatest(y1, y2)) AS y, CAST(0 AS BIGINT) AS refs FROM v WHERE x1 <> x2 OR y1 <> y2 GROUP BY 1
UNION ALL SELECT asset_name, true, 0.72::DOUBLE, count(*), NULL, sum(x), sum(y2), count(DISTINCT (x, part)) FROM p WHERE y2 IS NOT NULL GROUP BY 1""",
    "vendor_columns": "SELECT entity_seq, 'column_path' AS category, CAST(k % 4 AS BIGINT) AS points, x1 + (k % 4 - 1) * 10 AS max_x, y1 + (k % 4 - 1) * 7 AS max_y, 0.8::DOUBLE AS confidence FROM v_entities WHERE k % 4 >= 2",
    "model_checks": f"""
WITH {_I}, g AS (SELECT *, 'e' || element_seq AS element_id, row_number() OVER (PARTITION BY bundle_id, ifc_type || CAST(floor(l_extendedprice) AS BIGINT) ORDER BY element_seq) AS again FROM v_elements),
s AS (SELECT bundle_id FROM j WHERE mode = 'cad_to_bim' AND bundle_id % 6 = 0),
x AS (SELECT bundle_id, 'model' AS stage, 'storey_membership' AS code, 'error' AS severity, element_id AS target FROM g WHERE p_size % 6 > 3 + bundle_id % 3
  UNION ALL SELECT bundle_id, 'model', 'guid', 'error', element_id FROM g WHERE again > 1
  UNION ALL SELECT bundle_id, 'gate', 'source_geometry_missing', 'error', 'formal_gate.drawing.source_geometry_missing' FROM s
  UNION ALL SELECT bundle_id, 'gate', 'proxy_entities_unresolved', 'error', 'formal_gate.drawing.proxy_entities_unresolved' FROM s WHERE bundle_id % 8 >= 2)
SELECT bundle_id, stage, code, severity, count(*) AS n, min(target) AS first_target FROM x GROUP BY 1, 2, 3, 4""",
}
