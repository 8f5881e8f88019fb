"""Queries over texts, names and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import storeys, text
from ..operators import resolution
from ..sources.tables import table
from .views import view


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs.withColumn("line_no", F.col("line_no").cast("long"))


def normalize_text(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.sha2(text.normalize_text(F.col("line")), 256).alias("line_sha"))


def text_dedupe(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("key", text.normalize_text(F.col("line"))).where("key <> ''")
    kept = resolution.dedupe_first(rows.withColumn("doc_part", F.col("doc_id") % 50), ["doc_part", "key"], "line_no").groupBy("doc_part").agg(F.count("*").alias("lines"), F.sum(F.length("key").cast("long")).alias("chars"))
    return kept


def room_label(spark, sf_dir):
    rows = view(spark, sf_dir, "v_texts")
    return rows.groupBy("bundle_id").agg(F.count_if(text.is_room_label(F.col("text"))).alias("room_labels"), F.count_if(text.is_room_label(F.concat(F.lit("办"), F.col("text")))).alias("longer_labels"))


def layer_role(spark, sf_dir):
    return view(spark, sf_dir, "v_layers").select("layer_seq", text.semantic_role(F.col("layer")).alias("role"), text.semantic_role(F.col("block_name")).alias("block_role"))


def grid_label(spark, sf_dir):
    return view(spark, sf_dir, "v_texts").where("text_kind in (2, 3, 6, 7)").select("text_seq", text.grid_label(F.col("text")).alias("grid_label"))


def elevations(spark, sf_dir):
    return view(spark, sf_dir, "v_texts").where("text_kind in (0, 5, 6)").select("text_seq", F.explode_outer(text.elevations(F.col("text"))).alias("elevation_m"))


def dimensions(spark, sf_dir):
    return view(spark, sf_dir, "v_texts").select("text_seq", F.explode(text.dimensions(F.col("text"))).alias("d")).select("text_seq", "d.kind", F.col("d.text").alias("dim_text"), "d.value", "d.unit")


def text_tags(spark, sf_dir):
    return view(spark, sf_dir, "v_texts").select("text_seq", text.text_tag(F.col("text"), F.lit("generic")).alias("tag")).groupBy("tag").agg(F.count("*").alias("texts"), F.min("text_seq").alias("first_seq"))


def unit_token(spark, sf_dir):
    rows = view(spark, sf_dir, "v_texts").withColumn("unit", text.unit_token(F.col("text")))
    return rows.where("unit is not null").groupBy("bundle_id", "asset_name").agg(F.min_by("unit", "text_seq").alias("unit"), F.min("text_seq").alias("text_seq"))


def storey_key(spark, sf_dir):
    rows = view(spark, sf_dir, "v_texts")
    name = F.concat("text", F.when(F.col("k") % 3 == 0, F.lit(" 地下二层")).when(F.col("k") % 3 == 1, F.lit(" roof")).otherwise(F.lit(" 十二层")))
    return rows.where("text_kind in (6, 7)").select("text_seq", storeys.storey_key(F.col("text")).alias("plain_key"), storeys.storey_key(name).alias("named_key"))


def storey_sort(spark, sf_dir):
    keys = F.array(*map(F.lit, ("RF", "2F", "B1", "10F", "B3", "other")))
    rows = view(spark, sf_dir, "v_entities").select("entity_seq", F.get(keys, (F.col("k") % 6).cast("int")).alias("key"), "k")
    o = storeys.storey_order(F.col("key"))
    up = storeys.storey_elevation(F.col("key"), F.col("k") % 5, F.lit(8), F.lit(3.0), F.lit(4.5))
    return rows.select("entity_seq", "key", o["grp"].alias("grp"), o["n"].alias("n"), F.round(up, 2).alias("elevation_m"), storeys.storey_name(F.lower("key")).alias("display"))


def descriptor_candidates(spark, sf_dir):
    rows = view(spark, sf_dir, "v_texts").withColumn("descriptor", F.concat("text", F.when(F.col("k") % 2 == 0, F.lit(" 立面")).otherwise(F.lit(" section"))))
    return rows.select("text_seq", F.explode(text.descriptor_candidates(F.col("descriptor"))).alias("c")).groupBy("c.name").agg(F.count("*").alias("candidates"), F.min("c.confidence").alias("confidence"))


def view_markers(spark, sf_dir):
    shown = F.concat(F.when(F.col("k") % 3 == 0, F.lit("-- ")).otherwise(F.lit("A1 ")), F.when(F.col("k") % 2 == 0, F.lit("剖面")).otherwise(F.lit("elevation")), F.when(F.col("k") % 5 == 0, F.lit(" 3F")).otherwise(F.lit("")))
    rows = view(spark, sf_dir, "v_texts").withColumn("shown", shown)
    marks = text.view_marker_candidates(F.col("shown"), storeys.storey_key(F.col("shown")), F.lit(0.7), F.lit("text"))
    return rows.select("text_seq", F.explode(marks).alias("c")).select("text_seq", F.col("c.name").alias("name"), F.round("c.confidence", 2).alias("confidence"))


def prompts(spark, sf_dir):
    p = text.prompt_digits(F.col("prompt"))
    rows = view(spark, sf_dir, "v_requests")
    b, w, r = text.building_type(p, F.col("form_building_type")), text.window_patch(p), text.roof_command(p)
    return rows.select("bundle_id", text.prompt_int(p, r"(\d+)\s*层").alias("floors"), b["value"].alias("building_type"), b["source"].alias("building_source"), text.source_mode(p, F.col("mode_hint"), F.col("assets")).alias("source_mode"), w["width_mm"].alias("patch_width"), w["target_family"].alias("patch_family"), r["roof_type"].alias("roof_type"), r["slope_deg"].alias("slope_deg"))


QUERIES = {f.__name__: f for f in (normalize_text, text_dedupe, room_label, layer_role, grid_label, elevations, dimensions, text_tags, unit_token, storey_key, storey_sort, descriptor_candidates, view_markers, prompts)}

_LINES = "l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
_NORM = "trim(regexp_replace(replace(line, chr(0), ' '), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{3000}]+', ' ', 'g'))"
ORACLES = {
    "normalize_text": f"WITH {_LINES} SELECT doc_id, line_no, sha256({_NORM}) AS line_sha FROM l",
    "text_dedupe": f"WITH {_LINES}, n AS (SELECT DISTINCT doc_id % 50 AS doc_part, {_NORM} AS key FROM l) SELECT doc_part, count(*) AS lines, CAST(sum(length(key)) AS BIGINT) AS chars FROM n WHERE key <> '' GROUP BY 1",
    "room_label": "SELECT bundle_id, count(*) FILTER (WHERE text_kind = 7) AS room_labels, count(*) FILTER (WHERE text_kind = 7) AS longer_labels FROM v_texts GROUP BY 1",
    "layer_role": """
SELECT layer_seq, CASE WHEN layer ILIKE '%轴%' OR layer ILIKE '%grid%' THEN 'grid' WHEN layer ILIKE '%wall%' THEN 'wall' WHEN layer ILIKE '%door%' THEN 'door' WHEN layer ILIKE '%wind%' THEN 'window' WHEN layer ILIKE '%room%' THEN 'room' ELSE 'unknown' END AS role,
  'unknown' AS block_role FROM v_layers""",
    "grid_label": "SELECT text_seq, CASE text_kind WHEN 2 THEN 'AB' || CAST(k AS STRING) WHEN 3 THEN CASE WHEN k * 10 < 1000 THEN CAST(k * 10 AS STRING) END ELSE NULL END AS grid_label FROM v_texts WHERE text_kind IN (2, 3, 6, 7)",
    "elevations": "SELECT text_seq, CASE text_kind WHEN 0 THEN k + 0.5 WHEN 5 THEN round(CAST(k AS DOUBLE) / 1000, 3) END AS elevation_m FROM v_texts WHERE text_kind IN (0, 5, 6)",
    "dimensions": """
SELECT text_seq, 'size_pair' AS kind, text AS dim_text, CAST(NULL AS DOUBLE) AS value, 'mm' AS unit FROM v_texts WHERE text_kind = 3
UNION ALL SELECT text_seq, 'text_dimension', CAST(k AS STRING) || ' mm', CAST(k AS DOUBLE), 'mm' FROM v_texts WHERE text_kind = 5""",
    "text_tags": """
SELECT CASE text_kind WHEN 0 THEN 'elevation' WHEN 1 THEN 'view_marker' WHEN 2 THEN 'grid_label' WHEN 3 THEN 'dimension' WHEN 4 THEN 'north_angle' WHEN 5 THEN 'elevation' WHEN 6 THEN 'generic' ELSE 'room_label' END AS tag,
  count(*) AS texts, min(text_seq) AS first_seq FROM v_texts GROUP BY 1""",
    "unit_token": "SELECT bundle_id, asset_name, 'mm' AS unit, min(text_seq) AS text_seq FROM v_texts WHERE text_kind IN (3, 5) GROUP BY 1, 2",
    "storey_key": "SELECT text_seq, CAST(NULL AS STRING) AS plain_key, CASE k % 3 WHEN 0 THEN 'B2' WHEN 1 THEN 'RF' ELSE '12F' END AS named_key FROM v_texts WHERE text_kind IN (6, 7)",
    "storey_sort": """
SELECT entity_seq, key, CAST(CASE WHEN key = 'RF' THEN 2 WHEN key LIKE 'B%' THEN 0 WHEN key LIKE '%0F' OR key LIKE '2F' THEN 1 ELSE 3 END AS INTEGER) AS grp,
  CAST(CASE key WHEN '2F' THEN 2 WHEN 'B1' THEN -1 WHEN '10F' THEN 10 WHEN 'B3' THEN -3 ELSE 0 END AS BIGINT) AS n,
  CASE key WHEN 'RF' THEN 25.5 WHEN '2F' THEN 4.5 WHEN 'B1' THEN -3.0 WHEN '10F' THEN 28.5 WHEN 'B3' THEN -9.0 ELSE CASE WHEN k % 5 = 0 THEN 0.0 ELSE 4.5 + (k % 5 - 1) * 3.0 END END::DOUBLE AS elevation_m, upper(key) AS display
FROM (SELECT entity_seq, k, ['RF', '2F', 'B1', '10F', 'B3', 'other'][k % 6 + 1] AS key FROM v_entities)""",
    "descriptor_candidates": """
SELECT name, count(*) AS candidates, CAST(0.85 AS DOUBLE) AS confidence FROM (
  SELECT 'standard_floor' AS name FROM v_texts WHERE text_kind = 1 UNION ALL SELECT 'facade_reference' FROM v_texts WHERE k % 2 = 0 UNION ALL SELECT 'section_reference' FROM v_texts WHERE k % 2 = 1) GROUP BY 1""",
    "view_markers": """
SELECT text_seq, CASE WHEN k % 2 = 0 THEN 'section_reference' ELSE 'facade_reference' END AS name, CAST(0.7 AS DOUBLE) AS confidence FROM v_texts WHERE k % 3 <> 0
UNION ALL SELECT text_seq, CASE WHEN k % 3 = 0 THEN '-- ' ELSE 'A1 ' END || CASE WHEN k % 2 = 0 THEN '剖面' ELSE 'elevation' END || ' 3F', CAST(0.75 AS DOUBLE) FROM v_texts WHERE k % 5 = 0""",
    "prompts": """
SELECT bundle_id, CASE WHEN bundle_id % 5 = 0 THEN 1 + bundle_id % 30 END AS floors,
  CASE WHEN form_building_type IS NOT NULL THEN 'office' WHEN bundle_id % 5 IN (1, 4) THEN 'office' ELSE 'residential' END AS building_type,
  CASE WHEN form_building_type IS NOT NULL THEN 'form_input' WHEN bundle_id % 5 IN (0, 1, 4) THEN 'text_prompt' ELSE 'template_default' END AS building_source,
  CASE WHEN mode_hint = 'cad_to_bim' OR assets > 0 THEN 'cad_to_bim' ELSE 'text_only' END AS source_mode,
  CASE WHEN bundle_id % 5 = 2 THEN CAST(800 AS BIGINT) END AS patch_width, CASE WHEN bundle_id % 5 = 2 THEN 'floor_to_ceiling_window' END AS patch_family,
  CASE WHEN bundle_id % 5 = 3 THEN 'gable' END AS roof_type, CASE WHEN bundle_id % 5 = 3 THEN CAST(35 AS DOUBLE) END AS slope_deg
FROM v_requests""",
}
