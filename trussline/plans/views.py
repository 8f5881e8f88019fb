"""Adapter views: the drawing, text, request and version tables that the queries run on, derived from the supplied tables.

Each view is one SQL text for both engines: `{events}` and the like stand for the supplied tables. Spark reads them as
DataFrames; the query's SQL takes them in as common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

E = "(SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events}) e"
VIEWS = {
    # Drawing entities: anchors on a coarse grid, so duplicates and chains occur; a door or window names a parent wall at times.
    "v_entities": """
SELECT user_id % 20 AS bundle_id, 'asset_' || CAST(user_id AS STRING) AS asset_name, user_id AS asset_seq, event_id AS entity_seq,
  CASE event_type WHEN 'view' THEN 'wall_line' WHEN 'click' THEN 'wall_path' WHEN 'purchase' THEN 'door_block' WHEN 'signup' THEN 'window_block' ELSE 'room_boundary' END AS category,
  CASE event_type WHEN 'view' THEN 'wall' WHEN 'click' THEN 'wall' WHEN 'purchase' THEN 'door' WHEN 'signup' THEN 'window' ELSE 'room' END AS kind,
  CAST(FLOOR(value / 10) AS DOUBLE) * 1000 AS x1, CAST(k % 10 AS DOUBLE) * 1000 AS y1,
  CAST(FLOOR(value / 10) AS DOUBLE) * 1000 + k * 10 AS x2, CAST(k % 10 AS DOUBLE) * 1000 + (k % 3) * 500 AS y2,
  CAST(1 + k % 4 AS STRING) || 'F' AS storey_key, 'h' || CAST(event_id AS STRING) AS handle, 'L' || CAST(k % 7 AS STRING) AS label,
  CAST(k AS DOUBLE) / 200 + 0.5 AS confidence, k, value
FROM {event_rows}""",
    # Texts of drawings, eight kinds.
    "v_texts": """
SELECT user_id % 20 AS bundle_id, 'asset_' || CAST(user_id AS STRING) AS asset_name, user_id AS asset_seq, event_id AS text_seq,
  CASE event_id % 8 WHEN 0 THEN 'EL  +' || CAST(k AS STRING) || '.500' WHEN 1 THEN CAST(1 + k % 9 AS STRING) || 'F  plan' WHEN 2 THEN 'axis AB' || CAST(k AS STRING)
    WHEN 3 THEN CAST(k * 10 AS STRING) || ' x ' || CAST(k * 10 + 5 AS STRING) || ' mm' WHEN 4 THEN 'North ' || CAST(k % 4 AS STRING) || '.5' WHEN 5 THEN 'level ' || CAST(k AS STRING) || ' mm'
    WHEN 6 THEN 'wallnote ' || CAST(k % 11 AS STRING) || '_' ELSE '办公室' END AS text,
  event_id % 8 AS text_kind, k
FROM {event_rows}""",
    # Titled plan fragments of every asset: boxes side by side.
    "v_fragments": """
SELECT user_id % 20 AS bundle_id, 'asset_' || CAST(user_id AS STRING) AS asset_name, f AS frag_seq, CAST(f AS STRING) || 'F plan' AS fragment_title, CAST(f AS STRING) || 'F' AS storey_key,
  'asset_' || CAST(user_id AS STRING) || '::fragment::' || CAST(f AS STRING) || 'F::0' || CAST(f AS STRING) AS fragment_id,
  CAST((f - 1) * 5000 AS DOUBLE) AS min_x, CAST(0 AS DOUBLE) AS min_y, CAST((f - 1) * 5000 + 3500 AS DOUBLE) AS max_x, CAST(4000 AS DOUBLE) AS max_y
FROM (SELECT DISTINCT user_id, 1 AS f FROM {events} UNION ALL SELECT DISTINCT user_id, 2 FROM {events} UNION ALL SELECT DISTINCT user_id, 3 FROM {events}) u""",
    # Assets with units, origins and flags.
    "v_assets": """
SELECT user_id % 20 AS bundle_id, 'asset_' || CAST(user_id AS STRING) AS asset_name, user_id AS asset_seq,
  CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 'cm' ELSE 'mm' END AS units, CASE WHEN user_id % 6 = 0 THEN 'pdf_page_origin' ELSE 'default' END AS source,
  CAST(user_id % 3 AS DOUBLE) AS x, CAST(user_id % 4 AS DOUBLE) AS y, user_id % 11 = 0 AS site_boundary, CAST(COUNT(*) AS BIGINT) AS space_boundaries
FROM {events} GROUP BY user_id""",
    "v_layers": "SELECT p_partkey AS layer_seq, p_name || CASE p_partkey % 6 WHEN 0 THEN ' A-WALL' WHEN 1 THEN ' door_leaf' WHEN 2 THEN ' WIND' WHEN 3 THEN ' 轴网' WHEN 4 THEN ' ROOM-AREA' ELSE '' END AS layer, p_type AS block_name, p_size FROM {part}",
    # Requests: a prompt and form fields made of an order's columns.
    "v_requests": """
SELECT o_orderkey AS bundle_id, o_custkey AS project_id, o_orderdate AS created_at,
  CASE o_orderkey % 5 WHEN 0 THEN '住宅 ' || CAST(1 + o_orderkey % 30 AS STRING) || ' 层 首层层高 4.5' WHEN 1 THEN 'office tower 层高: 3.2 容积率 6.5' WHEN 2 THEN '将 800x1200 的窗替换为落地窗' WHEN 3 THEN '双坡屋顶 35度 用地 1200 平方米' ELSE 'office ' || CAST(o_orderkey % 12 AS STRING) || ' units' END AS prompt,
  CASE WHEN o_orderkey % 7 = 0 THEN 'office' ELSE NULL END AS form_building_type, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 9 AS BIGINT) ELSE NULL END AS form_floors,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(2.5 AS DOUBLE) ELSE NULL END AS form_height, CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey AS DOUBLE) ELSE NULL END AS form_area, CAST(NULL AS DOUBLE) AS form_far,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(5.5 AS DOUBLE) ELSE NULL END AS form_first_height, CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey % 3 AS BIGINT) ELSE NULL END AS form_units,
  CASE o_orderstatus WHEN 'F' THEN 'auto' WHEN 'O' THEN 'cad_to_bim' ELSE 'auto' END AS mode_hint, o_orderkey % 3 AS assets,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(1 + o_orderkey % 5 AS BIGINT) ELSE NULL END AS drawn_floors, CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderkey % 500 + 100 AS DOUBLE) ELSE NULL END AS drawn_area,
  CASE WHEN o_orderkey % 2 = 0 THEN 'cn' ELSE '' END AS region
FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM {orders}) o""",
    "v_versions": "SELECT user_id AS project_id, event_id AS ingest_seq, 'ver_' || CAST(event_id % 997 AS STRING) AS version_id, user_id % 40 AS request_id, ts AS created_at, event_type AS topic FROM {events}",
    "v_issues": """
SELECT user_id AS bundle_id, event_id AS issue_seq, CASE WHEN event_id % 3 = 0 THEN 'rules' ELSE 'model' END AS stage,
  CASE WHEN event_id % 11 = 0 THEN 'drawing.review.multi_storey_asset_collapsed' ELSE 'code_' || event_type END AS code,
  CASE WHEN event_id % 97 = 0 THEN 'fatal' WHEN event_id % 41 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN event_id % 41 = 0 THEN 'formal_gate.x' ELSE 't' || CAST(event_id % 5 AS STRING) END AS target
FROM {events}""",
    # Bulk text: the lines of the documents.
    "v_pages": "SELECT page_id, url AS filename, html AS content FROM {pages}",
    "v_elements": """
SELECT l_orderkey % 200 AS bundle_id, CASE p_size % 5 WHEN 0 THEN 'IfcDoor' WHEN 1 THEN 'IfcWindow' WHEN 2 THEN 'IfcSlab' ELSE 'IfcWall' END AS ifc_type, CASE l_partkey % 4 WHEN 0 THEN 'wall' WHEN 1 THEN 'door' WHEN 2 THEN 'window' ELSE 'wall' END AS component_type,
  l_orderkey * 8 + l_linenumber AS element_seq, l_quantity, l_extendedprice, p_name, p_size
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
}
VIEWS = {k: v.replace("{event_rows}", E) for k, v in VIEWS.items()}
TABLES = ("events", "part", "orders", "lineitem", "pages", "documents", "embeddings", "conversations")


#: Views whose rows all have one key, and the column that tells it: dealt out by it once, so that nothing that is grouped or
#: joined by the key later is exchanged again, into partitions that are not put together, since each row costs much work.
DEALT = {"v_requests": ("orders", "o_orderkey")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the supplied tables."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
    if name in DEALT:
        t, key = DEALT[name]
        used[t] = used[t].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    return spark.sql(VIEWS[name], **used)


def with_views(sql: str) -> str:
    """The query's SQL with the views it names as common table expressions."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in named)
    if not ctes:
        return sql
    own = re.match(r"\s*WITH\s+", sql)
    return f"WITH {ctes}" + (",\n" + sql[own.end() :] if own else "\n" + sql)
