"""Queries over inputs: headers and broken drawings, routed assets, logs and artifacts, PDF texts, vendor walls, boxes of
titles, and what belongs to bundles without assets or components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, storeys, text
from ..operators import assembly, fragments, proxies, resolution, validation
from ..sources import dxf, pdf, registry
from ..sources.tables import table
from .drawing_queries import _components, _entities, _fragments
from .views import view


def _tags(rows, asset, pairs):
    """Tags of one header an asset: pairs of code and value in order."""
    every = F.array(*(F.struct(F.lit(c).alias("code"), v.cast("string").alias("value")) for c, v in pairs))
    return rows.select(asset.alias("asset_name"), F.posexplode(every).alias("tag_seq", "t")).select("asset_name", F.col("tag_seq").cast("long").alias("tag_seq"), "t.code", "t.value")


def header_values(spark, sf_dir):
    """Units, base point and extents of a header for every order."""
    o = table(spark, sf_dir, "orders")
    lit, key = F.lit, F.col("o_orderkey")
    pairs = [(0, lit("SECTION")), (2, lit("HEADER")), (9, lit("$INSUNITS")), (70, key % 8), (9, lit("$INSBASE")), (10, key * 0.5), (20, key % 100), (9, lit("$EXTMIN")), (10, lit(0)), (20, lit(-5))]
    pairs += [(9, F.when(key % 3 > 0, lit("$EXTMAX")).otherwise(lit("$OTHER"))), (10, key + 1), (20, lit(7)), (0, lit("ENDSEC")), (0, lit("EOF"))]
    got = dxf.header_values(_tags(o, key.cast("string"), pairs))
    return got.select("asset_name", "units", "base_x", "base_y", F.col("extents.min_y").alias("min_y"), F.col("extents.max_x").alias("max_x"))


def broken_drawings(spark, sf_dir):
    """Review rows of drawings with a code that is no number, or without an end."""
    o = table(spark, sf_dir, "orders")
    key, lit = F.col("o_orderkey"), F.lit
    end = F.when(key % 5 > 0, lit("EOF")).otherwise(lit("ENDSEC"))
    rows = _tags(o, key.cast("string"), [(0, lit("SECTION")), (8, lit("0")), (0, end)])
    rows = rows.withColumn("code", F.when((F.col("tag_seq") == 1) & (F.col("asset_name").cast("long") % 7 == 0), lit(None)).otherwise(F.col("code")))
    return dxf.broken_files(rows)


def dwg_versions(spark, sf_dir):
    """Releases told by the first bytes, for a part's name as the file's content."""
    p = table(spark, sf_dir, "part")
    mark = F.get(F.array(*map(F.lit, ("AC1015", "AC1032", "AC1099", "%PDF-1"))), (F.col("p_partkey") % 4).cast("int"))
    return p.select(dxf.dwg_version(F.concat(mark, "p_name").cast("binary")).alias("release")).groupBy("release").agg(F.count("*").alias("n"))


def _routed(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("s", F.col("p_partkey").cast("string"))
    end = F.get(F.array(*map(F.lit, (".DXF", ".pdf", ".dwg", ".txt"))), (F.col("p_partkey") % 4).cast("int"))
    assets = p.select(F.col("s").alias("asset_id"), F.array(F.concat(F.lit("in/"), "s", end), F.concat(F.lit("old/"), "s", end)).alias("candidates"))
    there = p.where("p_size % 3 > 0").select(F.concat(F.when(F.col("p_size") % 3 == 1, F.lit("in/")).otherwise(F.lit("old/")), "s", end).alias("path"))
    return registry.routed_assets(assets, there)


def routed_assets(spark, sf_dir):
    return _routed(spark, sf_dir)[0].select("asset_id", "path", "kind")


def missing_assets(spark, sf_dir):
    return _routed(spark, sf_dir)[1]


def request_assets(spark, sf_dir):
    """The assets of every order's request (its lines' parts), in the request's order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("asset_id"))
    requests = lines.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "asset_id"))), lambda s: s["asset_id"]).alias("asset_ids"))
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("filename"))
    return registry.request_assets(requests, assets).groupBy("request_id").agg(F.count("*").alias("assets"), F.max_by("filename", F.struct("asset_seq", "asset_id")).alias("last"), F.sum("asset_seq").alias("places"))


def pdf_texts(spark, sf_dir):
    """Annotations of PDF text blocks: the texts of drawings as blocks of pages."""
    t = view(spark, sf_dir, "v_texts").select("text_seq", (F.col("k") % 5).cast("int").alias("page_index"), F.when(F.col("text_kind") == 2, F.lit("  ")).otherwise(F.col("text")).alias("text"))
    return pdf.text_annotations(t).select("text_seq", "text")


def safe_numbers(spark, sf_dir):
    """Numbers read with a default where a text is none."""
    t = view(spark, sf_dir, "v_texts").select("text_seq", F.when(F.col("k") % 3 == 0, F.concat(F.col("k").cast("string"), F.lit(".5"))).when(F.col("k") % 3 == 1, F.col("text")).alias("text"))
    return t.select("text_seq", text.safe_float(F.col("text"), -1.0).alias("value"))


def chinese_floors(spark, sf_dir):
    """Floor numerals up to 99 of every event, read back as numbers."""
    digits = F.array(*map(F.lit, "零一二三四五六七八九"))
    n = (F.col("event_id") % 99 + 1).cast("int")
    ten, one = F.floor(n / 10).cast("int"), n % 10
    said = F.concat(F.when(ten == 0, F.lit("")).when(ten == 1, F.lit("十")).otherwise(F.concat(F.get(digits, ten), F.lit("十"))), F.when((one > 0), F.get(digits, one)).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select(storeys.chinese_floor(said).cast("long").alias("floor")).groupBy("floor").agg(F.count("*").alias("n"))


def vendor_walls(spark, sf_dir):
    """Ends of vendor walls, packed as the vendor packs them, for every wall; one in five is cut short."""
    e = view(spark, sf_dir, "v_entities").where("kind = 'wall'")
    numbers = F.concat_ws(",", *(F.col(c).cast("string") for c in ("x1", "x2", "y1", "y2")))
    packed = F.base64(F.encode(F.when(F.col("k") % 5 == 0, F.lit("1,2,3")).otherwise(numbers), "UTF-16LE"))
    v = e.select("entity_seq", text.wall_vector(packed).alias("v"))
    return v.select("entity_seq", "v.x1", "v.x2", "v.y1", "v.y2")


def proxy_children(spark, sf_dir):
    """Parts of proxies by their own layer's role or their parent's."""
    e = _entities(spark, sf_dir).withColumns({"parent_role": F.col("kind"), "layer": F.when(F.col("k") % 2 == 0, F.col("layer")).otherwise(F.lit("0")), "closed": F.col("k") % 4 < 2})
    return proxies.proxy_children(e.drop("category")).groupBy("asset_name", "category").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min("bbox.min_x").alias("min_x"))


def title_boxes(spark, sf_dir):
    """Boxes of fragments told by the first view marker with their title; two fragments in three come without one."""
    f = _fragments(spark, sf_dir).withColumn("bbox", F.when(F.col("frag_seq") % 3 == 0, F.col("bbox")))
    t = view(spark, sf_dir, "v_texts").select("bundle_id", "asset_name", "text_seq", "text", text.text_tag(F.col("text"), F.lit("x")).alias("_tag"), F.when(F.col("text_kind") == 1, F.lit("view_marker")).otherwise(F.lit("other")).alias("semantic_tag"), geometry.box(*(F.col("k").cast("double") + i for i in range(4))).alias("bbox"))
    return fragments.title_boxes(f, t.drop("_tag")).select("fragment_id", F.col("bbox.min_x").alias("min_x"), F.col("bbox.max_y").alias("max_y"))


def storeys_with_fragments(spark, sf_dir):
    """Storeys of components or of fragments alone."""
    told = _fragments(spark, sf_dir).withColumn("storey_key", F.concat((F.col("frag_seq") + 3).cast("string"), F.lit("F")))
    return assembly.storeys_with_fragments(assembly.manifests(_components(spark, sf_dir)), told)


def issue_union(spark, sf_dir):
    """The issues of all producers with those of the formal gate."""
    v = view(spark, sf_dir, "v_issues").drop("issue_seq")
    every = validation.all_issues(v.where("stage = 'rules'"), v.where("stage = 'model'"), validation.formal_blockers(v).select(v.columns))
    return every.groupBy("producer", "stage", "code", "severity").agg(F.count("*").alias("n"))


def bundles_without_assets(spark, sf_dir):
    """Requests whose customer's number no asset has."""
    bundles = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id")).distinct()
    return resolution.bundles_without_assets(bundles, view(spark, sf_dir, "v_assets").select(F.col("asset_seq").alias("bundle_id")))


def grid_layers(spark, sf_dir):
    """Layers that carry axes."""
    v = view(spark, sf_dir, "v_layers").withColumn("layer", F.when(F.col("layer_seq") % 4 == 0, F.concat(F.lit("S-GRID-"), "layer")).when(F.col("layer_seq") % 4 == 1, F.concat("layer", F.lit(" axis"))).when(F.col("layer_seq") % 4 == 2, F.concat("layer", F.lit("taxis"))).otherwise(F.col("layer")))
    return v.select("layer_seq", text.is_grid_layer(F.col("layer")).alias("grid"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_PART = "CASE p_partkey % 4 WHEN 0 THEN '.DXF' WHEN 1 THEN '.pdf' WHEN 2 THEN '.dwg' ELSE '.txt' END"
ORACLES = {
    "header_values": """
SELECT CAST(o_orderkey AS STRING) AS asset_name, CASE o_orderkey % 8 WHEN 1 THEN 'inch' WHEN 4 THEN 'mm' WHEN 5 THEN 'cm' WHEN 6 THEN 'm' ELSE 'unknown' END AS units, o_orderkey * 0.5::DOUBLE AS base_x, CAST(o_orderkey % 100 AS DOUBLE) AS base_y,
  CASE WHEN o_orderkey % 3 > 0 THEN -5.0::DOUBLE END AS min_y, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey + 1 AS DOUBLE) END AS max_x FROM (SELECT DISTINCT o_orderkey FROM orders)""",
    "broken_drawings": "SELECT DISTINCT CAST(o_orderkey AS STRING) AS asset_name, 'parse_failed' AS category, 'error' AS severity FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0",
    "dwg_versions": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'R2000' WHEN 1 THEN 'R2018' WHEN 2 THEN 'AC1099' END AS release, count(*) AS n FROM part GROUP BY 1",
    "routed_assets": f"SELECT CAST(p_partkey AS STRING) AS asset_id, CASE p_size % 3 WHEN 1 THEN 'in/' ELSE 'old/' END || CAST(p_partkey AS STRING) || {_PART} AS path, CASE p_partkey % 4 WHEN 1 THEN 'pdf' WHEN 3 THEN 'unknown' ELSE 'cad' END AS kind FROM part WHERE p_size % 3 > 0",
    "missing_assets": "SELECT CAST(p_partkey AS STRING) AS asset_id, 'asset_missing' AS category, 'error' AS severity FROM part WHERE p_size % 3 = 0",
    "request_assets": """
WITH l AS (SELECT l_orderkey AS request_id, p_name, p_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS n FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT request_id, count(*) AS assets, arg_max(p_name, n) AS last, CAST(sum(n) AS BIGINT) AS places FROM l GROUP BY 1""",
    "pdf_texts": "SELECT text_seq, 'page ' || CAST(k % 5 + 1 AS STRING) || ': ' || regexp_replace(text, '[ ]+', ' ', 'g') AS text FROM v_texts WHERE text_kind <> 2",
    "safe_numbers": "SELECT text_seq, coalesce(CASE k % 3 WHEN 0 THEN k + 0.5 WHEN 1 THEN TRY_CAST(text AS DOUBLE) END, -1)::DOUBLE AS value FROM v_texts",
    "chinese_floors": "SELECT event_id % 99 + 1 AS floor, count(*) AS n FROM events GROUP BY 1",
    "vendor_walls": "SELECT entity_seq, CASE WHEN k % 5 > 0 THEN x1 END AS x1, CASE WHEN k % 5 > 0 THEN x2 END AS x2, CASE WHEN k % 5 > 0 THEN y1 END AS y1, CASE WHEN k % 5 > 0 THEN y2 END AS y2 FROM v_entities WHERE kind = 'wall'",
    "proxy_children": """
SELECT asset_name, CASE kind WHEN 'wall' THEN 'wall_line' WHEN 'door' THEN 'door_block' WHEN 'window' THEN 'window_block' ELSE 'room_boundary' END AS category, count(*) AS n, 0.6::DOUBLE AS confidence, min(x1) AS min_x FROM v_entities WHERE kind <> 'room' OR k % 4 < 2 GROUP BY 1, 2""",
    "title_boxes": """
WITH m AS (SELECT asset_name, regexp_replace(text, '[ ]+', ' ', 'g') AS title, arg_min(k, text_seq) AS k FROM v_texts WHERE text_kind = 1 GROUP BY 1, 2)
SELECT fragment_id, CASE WHEN frag_seq % 3 = 0 THEN min_x ELSE CAST(k AS DOUBLE) END AS min_x, CASE WHEN frag_seq % 3 = 0 THEN max_y ELSE CAST(k + 3 AS DOUBLE) END AS max_y FROM v_fragments f LEFT JOIN m ON m.asset_name = f.asset_name AND m.title = f.fragment_title""",
    "storeys_with_fragments": """
WITH c AS (SELECT bundle_id, storey_key, count(*) AS n FROM v_entities GROUP BY 1, 2), f AS (SELECT DISTINCT bundle_id, CAST(frag_seq + 3 AS STRING) || 'F' AS storey_key FROM v_fragments)
SELECT coalesce(c.bundle_id, f.bundle_id) AS bundle_id, coalesce(c.storey_key, f.storey_key) AS storey_key, coalesce(n, 0) AS component_count FROM c FULL JOIN f ON c.bundle_id = f.bundle_id AND c.storey_key = f.storey_key""",
    "issue_union": """
SELECT CASE stage WHEN 'rules' THEN 0 ELSE 1 END AS producer, stage, code, severity, count(*) AS n FROM v_issues GROUP BY 1, 2, 3, 4 UNION ALL SELECT 2, 'gate', 'formal_gate', 'error', count(*) FROM v_issues WHERE code = 'drawing.review.multi_storey_asset_collapsed' AND severity NOT IN ('error', 'fatal') HAVING count(*) > 0""",
    "bundles_without_assets": "SELECT DISTINCT o_custkey AS bundle_id, 'assets_missing' AS category FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)",
    "grid_layers": r"SELECT layer_seq, layer_seq % 4 < 2 OR contains(layer, '轴') OR regexp_matches(layer, '(^|[-_.\s])(axis|grid)($|[-_.\s])', 'i') AS grid FROM v_layers",
}
