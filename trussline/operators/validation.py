"""Checks of drawings and models, the formal gate and the export decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import BLOCKING_REVIEWS, SEVERITIES, severity_rank

# Element types a model should have, tolerance of the bounds, roles whose proxies need a review, artifacts.
REQUIRED = ("IfcDoor", "IfcSlab", "IfcWall", "IfcWindow")
TOLERANCE = 0.25
PROXY_ROLES = ("wall", "door", "window", "room", "space")
ARTIFACTS, FORMAL_ARTIFACTS = ("intent.json", "validation.json", "model.semantic.json"), ("model.ifc", "export-log.json")
DISPLAY = {"passed": "通过", "warning": "警告", "failed": "失败", "blocked": "阻断", "pending": "等待中", "running": "执行中", "info": "提示", "error": "错误", "fatal": "严重错误"}


def parse_quality(assets: DataFrame, entities: DataFrame, layers: DataFrame, axes: DataFrame) -> DataFrame:
    """Review rows of assets (bundle_id, asset_name, kind, pdf_type): CAD files without walls, without any modelled entity
    but proxies on layers that mean something, or without axes; scanned documents."""
    key = ["bundle_id", "asset_name"]
    has = entities.groupBy(*key).agg(F.bool_or(F.col("category").isin("wall_line", "wall_path")).alias("walls"), F.bool_or(F.col("category").rlike("wall|door|wind|room|space")).alias("modeled"))
    proxy = layers.where(F.array_contains("entity_types", "ACAD_PROXY_ENTITY") & F.col("semantic_role").isin(*PROXY_ROLES)).groupBy(*key).agg(F.array_join(F.slice(F.array_sort(F.collect_set("layer")), 1, 5), ", ").alias("proxies"))
    grid = axes.groupBy(*key).agg(F.count("*").alias("axes"))
    rows = assets.join(has, key, "left").join(proxy, key, "left").join(grid, key, "left")
    cad = F.col("kind") == "cad"
    no = lambda c: ~F.coalesce(c, F.lit(False))
    issue = lambda when, category: F.when(when, F.lit(category))
    found = [issue(cad & no("walls"), "wall_detection_low_confidence"), issue(cad & no("modeled") & F.col("proxies").isNotNull(), "proxy_entities_unresolved"), issue(cad & F.col("axes").isNull(), "grid_not_detected"), issue((F.col("kind") == "pdf") & (F.col("pdf_type") == "scanned"), "pdf_scan_review")]
    return rows.select(*key, F.explode(F.array_compact(F.array(*found))).alias("category"), "proxies").withColumn("severity", F.lit("warning"))


def proxy_reviews(assets: DataFrame) -> DataFrame:
    """Outcome rows of assets with proxies (proxies, with_geometry, modeled, generated): approximated, unresolved, empty."""
    told = [
        F.when((F.col("modeled") == 0) & (F.col("generated") > 0), F.lit("proxy_geometry_approximated")).when(F.col("modeled") == 0, F.lit("proxy_geometry_unresolved")),
        F.when(F.col("with_geometry") == 0, F.lit("proxy_virtual_entities_empty")),
    ]
    return assets.where("proxies > 0").select("bundle_id", F.explode(F.array_compact(F.array(*told))).alias("_c"), "asset_name").select("bundle_id", "asset_name", F.col("_c").alias("category"), F.lit("warning").alias("severity"))


def issue_row(stage: str, code: str, severity: str, target: Column | str) -> list[Column]:
    return [F.lit(stage).alias("stage"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.col(target) if isinstance(target, str) else target).alias("target")]


def storey_count_issues(storeys: DataFrame, intents: DataFrame) -> DataFrame:
    """Models whose storeys are not as many as the intent, or its drawings, ask for."""
    made = storeys.groupBy("bundle_id").agg(F.count("*").alias("made"))
    wanted = F.when(F.col("source_mode") == "cad_to_bim", F.greatest("floors", F.coalesce("source_storeys", F.lit(0)))).otherwise(F.col("floors"))
    rows = intents.join(made, "bundle_id", "left").where(F.coalesce("made", F.lit(0)) != wanted)
    return rows.select("bundle_id", *issue_row("model", "storey_count", "error", F.lit("storeys")))


def repeated_guids(elements: DataFrame) -> DataFrame:
    """Every element after the first of its GUID."""
    n = F.row_number().over(Window.partitionBy("bundle_id", "guid").orderBy("element_seq"))
    return elements.withColumn("_n", n).where("_n > 1").drop("_n")


def misplaced_elements(elements: DataFrame, storeys: DataFrame) -> DataFrame:
    """Elements of storeys that their model does not have."""
    rows = elements.join(storeys.select("bundle_id", "storey_id").distinct(), ["bundle_id", "storey_id"], "left_anti")
    return rows.select("bundle_id", *issue_row("model", "storey_membership", "error", "element_id"))


def missing_types(models: DataFrame, index: DataFrame) -> DataFrame:
    """Required element types that a model lacks."""
    wanted = models.select("bundle_id", F.explode(F.array(*map(F.lit, REQUIRED))).alias("ifc_type"))
    return wanted.join(index.where("elements > 0").select("bundle_id", "ifc_type"), ["bundle_id", "ifc_type"], "left_anti").select("bundle_id", *issue_row("model", "required_type", "warning", "ifc_type"))


def reconciliation_issues(reconciled: DataFrame) -> DataFrame:
    """Types of which fewer were modelled than read."""
    rows = reconciled.where("source > 0 and delta < 0")
    return rows.select("bundle_id", *issue_row("model", "reconciliation", "error", F.concat(F.lit("reconciliation."), "ifc_type")))


def outside(x: Column, y: Column, width: Column, depth: Column, centred: Column, opening: Column, bounds: tuple[Column, Column, Column, Column], tolerance: float = TOLERANCE) -> Column:
    """Whether an element's anchor lies beyond the bounds: its own place if it is centred or no opening, else its middle."""
    shift = opening & ~centred
    ax, ay = x + F.when(shift, width / 2).otherwise(F.lit(0.0)), y + F.when(shift, depth / 2).otherwise(F.lit(0.0))
    x0, y0, x1, y1 = bounds
    return (ax < x0 - tolerance) | (ay < y0 - tolerance) | (ax > x1 + tolerance) | (ay > y1 + tolerance)


def bounds_issues(elements: DataFrame, layouts: DataFrame) -> DataFrame:
    """Elements from drawings that lie outside the footprint of their source storey, or have no fragment to be traced to;
    storeys without bounds are not checked."""
    drawn = elements.where("geometry_source = 'parsed_drawing'")
    nameless = drawn.where(F.coalesce(F.col("fragment_id") == "", F.lit(True))).select("bundle_id", *issue_row("model", "fragment_missing", "error", "element_id"))
    rows = drawn.where(F.col("fragment_id") != "").join(layouts.select("bundle_id", F.col("storey_key").alias("source_storey_key"), F.col("width_m").alias("_w"), F.col("depth_m").alias("_d")), ["bundle_id", "source_storey_key"])
    zero = F.lit(0.0)
    bad = outside(F.coalesce("local_x_m", zero), F.coalesce("local_y_m", zero), F.greatest("shape_width_m", zero), F.greatest("shape_depth_m", zero), F.lower("geometry_anchor") == "center", F.col("category").isin("door_block", "window_block"), (zero, zero, F.col("_w"), F.col("_d")))
    return nameless.unionByName(rows.where(bad).select("bundle_id", *issue_row("model", "position_bounds", "error", "element_id")))


def formal_blockers(rule_issues: DataFrame) -> DataFrame:
    """Blocking review codes below error, promoted."""
    codes = [f"drawing.review.{c}" for c in BLOCKING_REVIEWS]
    rows = rule_issues.where(F.col("code").isin(*codes) & ~F.col("severity").isin("error", "fatal"))
    return rows.select("bundle_id", *issue_row("gate", "formal_gate", "error", F.concat(F.lit("formal_gate."), "code")))


def source_geometry_issues(models: DataFrame, rule_issues: DataFrame) -> DataFrame:
    """Models of drawings that fell back to the template because nothing was read, and the proxies that explain it."""
    rows = models.where("source_mode = 'cad_to_bim' and geometry_source = 'template_fallback' and source_total = 0").select("bundle_id")
    proxies = rows.join(rule_issues.where("code = 'drawing.review.proxy_entities_unresolved'").select("bundle_id").distinct(), "bundle_id")
    lost = rows.select("bundle_id", *issue_row("gate", "source_geometry_missing", "error", F.lit("formal_gate.drawing.source_geometry_missing")))
    return lost.unionByName(proxies.select("bundle_id", *issue_row("gate", "proxy_entities_unresolved", "error", F.lit("formal_gate.drawing.proxy_entities_unresolved"))))


def all_issues(*producers: DataFrame) -> DataFrame:
    """The issues of all producers, with the producer's number as issue_seq's first part."""
    out = None
    for i, p in enumerate(producers):
        rows = p.withColumn("producer", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def export_gate(models: DataFrame, issues: DataFrame) -> DataFrame:
    """Per model: severity counts, status, blocking messages, the decision and the artifacts that follow.

    `issues` has bundle_id, severity, target, and perhaps issue_seq and message (else the target). Messages are those of errors in their order, repeats
    included, then those of formal blockers that are not among them."""
    issues = issues.withColumns({c: v for c, v in (("message", F.col("target")), ("issue_seq", F.lit(0).cast("long"))) if c not in issues.columns})
    sharp = F.col("severity").isin("error", "fatal")
    formal = sharp & F.startswith("target", F.lit("formal_gate."))
    per = issues.groupBy("bundle_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count_if(formal).alias("formal_blockers"), F.array_sort(F.collect_list(F.when(sharp & ~formal, F.struct("issue_seq", "message")))).alias("_own"), F.array_sort(F.collect_list(F.when(formal, F.struct("issue_seq", "message")))).alias("_formal"))
    said = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<issue_seq:bigint,message:string>>")), lambda m: m["message"])
    per = per.withColumn("blocked_by", F.concat(said(F.col("_own")), F.array_distinct(F.array_except(said(F.col("_formal")), said(F.col("_own")))))).drop("_own", "_formal")
    rows = models.select("bundle_id").join(per, "bundle_id", "left").na.fill(0)
    status = F.when(F.col("fatal") + F.col("error") > 0, F.lit("failed")).when(F.col("warning") > 0, F.lit("warning")).otherwise(F.lit("passed"))
    allowed = (F.col("status") != "failed") & (F.col("formal_blockers") == 0)
    some = lambda names: F.array(*map(F.lit, names))
    rows = rows.withColumn("status", status).withColumn("export_allowed", allowed)
    return rows.withColumns({"blocked_by": F.coalesce("blocked_by", F.array().cast("array<string>")), "artifacts": F.when(F.col("export_allowed"), some(ARTIFACTS + FORMAL_ARTIFACTS)).otherwise(some(ARTIFACTS))})


def highlighted_issue(issues: DataFrame) -> DataFrame:
    """One issue a version: the first error or fatal, else the first of validation, else the first of the rules."""
    order = F.when(severity_rank(F.col("severity")) >= 3, F.lit(0)).when(F.col("stage") != "rules", F.lit(1)).otherwise(F.lit(2))
    n = F.row_number().over(Window.partitionBy("bundle_id").orderBy(order, F.when(F.col("stage") == "rules", F.lit(1)).otherwise(F.lit(0)), "issue_seq"))
    return issues.withColumn("_n", n).where("_n = 1").drop("_n")


def localized(rows: DataFrame, column: str, copy: DataFrame, into: str) -> DataFrame:
    """The column's text in the display language, as it is where there is none; copy: key, label, a small dimension."""
    return rows.join(copy.select(F.col("key").alias(column), F.col("label").alias("_label")), column, "left").withColumn(into, F.coalesce("_label", F.col(column))).drop("_label")


def display_copy(spark) -> DataFrame:
    return spark.createDataFrame(list(DISPLAY.items()), "key string, label string")


