"""Rules on intents, their traces and summaries, and the plan that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.registry import config_entries, config_tree
from .intents import lacking_fields

# Rule sets, severities in order, codes that block a formal delivery, steps of each strategy.
RULESETS = (("cn_residential_v1", "residential", 1, 2.8, 3.0), ("cn_office_v1", "office", 1, 3.0, 4.2))
RULESET_SCHEMA = "ruleset string, building_type string, min_floors long, min_standard double, min_first double"
SEVERITIES = ("info", "warning", "error", "fatal")
BLOCKING_REVIEWS = ("entity_detection_truncated", "multi_storey_asset_collapsed")
MAX_FAR, FORWARDED = 5.0, 5
RULES = (
    ("constraints.floors.min", "floors.invalid", "fatal"),
    ("constraints.standard_floor_height.min", "floor_height.low", "error"),
    ("constraints.first_floor_height.min", "first_floor_height.low", "warning"),
    ("source.assets.required_for_cad", "source.assets_missing", "fatal"),
    ("drawing.pending_review.forward", None, None),
    ("constraints.far.warning_threshold", "far.high", "warning"),
    ("site.area.required_for_delivery", "site.area_missing", "warning"),
    ("intent.missing_fields.forward", None, "warning"),
)
DRAWN_STEPS = ("normalize_inputs", "parse_drawings", "transform_intent", "evaluate_rules", "build_bim", "validate_and_export")
STEPS = {
    "text_to_massing": ("normalize_inputs", "transform_intent", "evaluate_rules", "build_bim", "validate_and_export"),
    "cad_to_bim": DRAWN_STEPS,
    "element_batch_replace": DRAWN_STEPS,
}


def rulesets(spark) -> DataFrame:
    return spark.createDataFrame(RULESETS, RULESET_SCHEMA)


def configured(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(rule sets, rule descriptions) of a configuration file: the rule sets carry the shared limit `max_far` too. Both are as
    large as the file."""
    tree = config_tree(spark, path)
    shared = tree.select(F.try_variant_get("config", "$.shared.max_far_warning", "double").alias("max_far"))
    get = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind)
    sets = config_entries(tree, "$.rulesets").select(
        F.col("key").alias("ruleset"),
        get("building_type", "string").alias("building_type"),
        get("min_floor_count", "long").alias("min_floors"),
        get("min_standard_floor_height_m", "double").alias("min_standard"),
        get("min_first_floor_height_m", "double").alias("min_first"),
    )
    told = config_entries(tree, "$.rule_descriptions").select(F.col("key").alias("rule_id"), F.try_variant_get("value", "$", "string").alias("description"))
    # One row a file: the shared limits are a single row.
    return sets.join(F.broadcast(shared.withColumn("max_far", F.coalesce("max_far", F.lit(MAX_FAR)))), how="cross"), told


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def with_ruleset(intents: DataFrame, rules: DataFrame) -> DataFrame:
    """Intents with their rule set's limits: by id, else by building type; `ruleset_found` tells those with neither. The
    dimension has a few fixed rows, so it is broadcast."""
    by_id = rules.drop("building_type").withColumn("_id", F.lit(1))
    limits = [c for c in rules.columns if c not in ("ruleset", "building_type")]
    by_type = rules.select("building_type", *(F.col(c).alias(f"_{c}") for c in limits))
    rows = intents.join(F.broadcast(by_id), "ruleset", "left").join(F.broadcast(by_type), "building_type", "left")
    return rows.withColumns({c: F.coalesce(c, f"_{c}") for c in limits}).withColumn("ruleset_found", F.col("min_floors").isNotNull()).drop("_id", *(f"_{c}" for c in limits))


def rule_issues(intents: DataFrame, reviews: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """bundle_id, rule_seq, rule_id, code, severity, target of every issue. Intents carry the rule set's limits and plain
    values (floors, standard, first, far, site_area, source_mode, assets). Without a table of missing fields, those of the
    intents' own rows (region too) are told in the same pass."""
    code = {r: (c, s) for r, c, s in RULES}
    seq = {r: i for i, (r, _, _) in enumerate(RULES, 1)}

    def issue(rule: str, when: Column, target: str, c: str | None = None) -> Column:
        c, s = c or code[rule][0], code[rule][1]
        return F.when(when, F.struct(F.lit(seq[rule]).alias("rule_seq"), F.lit(rule).alias("rule_id"), F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(target).alias("target")))

    own = [
        issue("constraints.floors.min", F.col("floors") < F.col("min_floors"), "constraints.floors"),
        issue("constraints.standard_floor_height.min", F.col("standard") < F.col("min_standard"), "constraints.standard_floor_height_m"),
        issue("constraints.first_floor_height.min", F.col("first") < F.col("min_first"), "constraints.first_floor_height_m"),
        issue("source.assets.required_for_cad", (F.col("source_mode") == "cad_to_bim") & (F.col("assets") == 0), "assets"),
        issue("constraints.far.warning_threshold", F.col("far") > (F.col("max_far") if "max_far" in intents.columns else MAX_FAR), "constraints.far"),
        issue("site.area.required_for_delivery", F.col("site_area").isNull(), "site.area_sqm"),
    ]
    forward, fields = "drawing.pending_review.forward", "intent.missing_fields.forward"
    if missing is None:
        own += [issue(fields, when, field, f"missing.{field}") for field, when in lacking_fields(F.col("site_area").isNull()).items()]
    # No lambda, so that the rows are made by generated code.
    direct = intents.select("bundle_id", F.explode(F.array(*own)).alias("i")).where("i is not null").select("bundle_id", "i.*")
    first = F.row_number().over(Window.partitionBy("bundle_id").orderBy("review_seq"))
    sharp = F.when(F.col("category").isin(*BLOCKING_REVIEWS), F.lit("error")).otherwise(F.col("severity"))
    passed = reviews.withColumn("n", first).where(F.col("n") <= FORWARDED).select("bundle_id", F.lit(seq[forward]).alias("rule_seq"), F.lit(forward).alias("rule_id"), F.concat(F.lit("drawing.review."), "category").alias("code"), sharp.alias("severity"), F.coalesce("source_ref", "asset_name").alias("target"))
    if missing is None:
        return direct.unionByName(passed)
    lacking = missing.select("bundle_id", F.lit(seq[fields]).alias("rule_seq"), F.lit(fields).alias("rule_id"), F.concat(F.lit("missing."), "field").alias("code"), F.lit("warning").alias("severity"), F.col("field").alias("target"))
    return direct.unionByName(passed).unionByName(lacking)


def rule_trace(bundles: DataFrame, issues: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """All eight rules of every bundle with the number of issues and the highest severity (passed without any)."""
    # One row of numbers a bundle is exchanged and held; the rules' names come after the join.
    of = lambda i, c: F.when(F.col("rule_seq") == i, c)
    numbers = range(1, len(RULES) + 1)
    found = issues.select("bundle_id", "rule_seq", severity_rank(F.col("severity")).cast("int").alias("rank")).groupBy("bundle_id").agg(*(c for i in numbers for c in (F.count(of(i, F.lit(1))).alias(f"n{i}"), F.max(of(i, F.col("rank"))).alias(f"top{i}"))))
    severity = F.array(*map(F.lit, SEVERITIES))
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("rule_seq"), F.lit(r).alias("rule_id"), F.coalesce(f"n{i}", F.lit(0).cast("long")).alias("issue_count"), F.coalesce(F.get(severity, F.col(f"top{i}") - 1), F.lit("passed")).alias("highest_severity")) for i, (r, _, _) in enumerate(RULES, 1)))).alias("r")
    rows = bundles.select("bundle_id").join(found, "bundle_id", "left").select("bundle_id", every).select("bundle_id", "r.*")
    return rows if descriptions is None else rows.join(descriptions, "rule_id", "left")


def rule_status(bundles: DataFrame, issues: DataFrame) -> DataFrame:
    """Severity counts with zeros, total, and status of every bundle."""
    counts = issues.groupBy("bundle_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count("*").alias("total"))
    rows = bundles.select("bundle_id").join(counts, "bundle_id", "left").na.fill(0)
    status = F.when((F.col("fatal") + F.col("error")) > 0, F.lit("failed")).when(F.col("warning") > 0, F.lit("warning")).otherwise(F.lit("passed"))
    return rows.withColumn("status", status)


def solver_constraints(intents: DataFrame) -> DataFrame:
    """Largest height and storey count of every intent."""
    height = F.col("first") + F.greatest(F.col("floors") - 1, F.lit(0)) * F.col("standard")
    return intents.select("bundle_id", F.round(height, 2).alias("max_height_m"), F.col("floors").alias("storey_count"))


def strategies(intents: DataFrame, status: DataFrame) -> DataFrame:
    """Strategy of every bundle (patch before drawings before text) and whether it can continue."""
    s = F.when(F.col("has_patch"), F.lit("element_batch_replace")).when(F.col("source_mode") == "cad_to_bim", F.lit("cad_to_bim")).otherwise(F.lit("text_to_massing"))
    return intents.join(status.select("bundle_id", "status"), "bundle_id").select("bundle_id", s.alias("strategy"), (F.col("status") != "failed").alias("can_continue"))


def strategy_steps(planned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The steps of every bundle's strategy, numbered, with the columns `keep` of `planned`."""
    steps = F.try_element_at(F.create_map(*(x for k, v in STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("strategy"))
    return planned.select("bundle_id", "strategy", *keep, F.posexplode(steps).alias("step_seq", "step"))
