"""Design intents: the fields of a request settled from its form, its prompt and its drawings, with traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..functions.text import prompt_float, prompt_int

# Building profiles and the patterns of numbers in prompts.
PROFILES = (("residential", 3.0, 3.3, 4, "cn_residential_v1"), ("office", 3.6, 4.2, 8, "cn_office_v1"))
PROFILE_SCHEMA = "building_type string, default_standard double, default_first double, default_units long, ruleset string"
FLOORS = r"(\d+)\s*层"
STANDARD_HEIGHT = r"(?:标准层层高|层高)[:：]?\s*([0-9.]+)"
FIRST_HEIGHT = r"首层层高[:：]?\s*([0-9.]+)"
SITE_AREA = r"([0-9.]+)\s*(?:平方米|平方|㎡|m2)"
FAR = r"容积率[:：]?\s*([0-9.]+)"
UNITS = r"(\d+)\s*(?:户|units?)"
QUESTIONS, LEAST_CONFIDENCE = 5, 0.65


def profiles(spark) -> DataFrame:
    """The building profiles, a dimension of two rows."""
    return spark.createDataFrame(PROFILES, PROFILE_SCHEMA)


def resolved(form: Column, inferred: Column, default: Column | None = None, inferred_source: Column | str = "text_prompt", inferred_confidence: Column | float = 0.85, default_source: Column | None = None) -> Column:
    """Struct value, source, confidence of a field: the form's, else what was inferred, else the default if it has one."""
    source = F.lit(inferred_source) if isinstance(inferred_source, str) else inferred_source
    sure = F.lit(inferred_confidence) if isinstance(inferred_confidence, float) else inferred_confidence
    as_ = lambda v, s, c: F.struct(v.alias("value"), s.alias("source"), c.alias("confidence"))
    out = F.when(form.isNotNull(), as_(form, F.lit("form_input"), F.lit(1.0))).when(inferred.isNotNull(), as_(inferred, source, sure))
    return out if default is None else out.otherwise(as_(default, F.lit("template_default") if default_source is None else default_source, F.lit(0.6)))


def site_areas(entities: DataFrame, assets: DataFrame) -> DataFrame:
    """Largest boundary of every bundle in square metres; unknown units count as metres."""
    scale = geometry.unit_scale(F.col("units"), 1.0)
    rows = entities.where(F.col("category").isin("site_boundary", "site_boundary_candidate")).join(assets.select("bundle_id", "units"), "bundle_id")
    area = geometry.area_sqm(F.col("points"), F.col("bbox"), scale)
    return rows.withColumn("area", area).where("area > 0").groupBy("bundle_id").agg(F.round(F.max("area"), 3).alias("site_area"))


def fill_requests(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests with their project's defaults, and form fields overlaid by the request's metadata (the later one wins)."""
    rows = requests.join(projects, "project_id", "left")
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    form = F.coalesce("form_fields", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(form, lambda k, _: ~F.map_contains_key(meta, k)), meta)
    return rows.withColumns({"form_fields": merged, "building_type_hint": F.coalesce("building_type_hint", "default_building_type"), "region": F.coalesce("region", "default_region")}).drop("default_building_type", "default_region", "metadata")


#: Columns of a request that may be left out, and what then holds.
OPTIONAL = (("form_first_height", "double", None), ("form_units", "bigint", None), ("site_boundary_detected", "boolean", False), ("north_angle", "double", 0.0), ("space_candidates", "bigint", 0), ("output_formats", "array<string>", None))


def build_intents(requests: DataFrame, profile: DataFrame, compat: bool = True) -> DataFrame:
    """One intent a request (bundle_id, prompt, mode_hint, form_* fields, assets, drawn_floors, drawn_area, region, and
    perhaps those of OPTIONAL), every resolved field as a struct of value, source and confidence. With `compat` the prompt's
    numerals are replaced digit by digit, as the reference does."""
    rows = requests.withColumns({c: F.lit(v).cast(t) for c, t, v in OPTIONAL if c not in requests.columns})
    rows = rows.withColumn("prompt", text.prompt_digits(F.col("prompt")) if compat else F.col("prompt"))
    rows = rows.withColumn("building", text.building_type(F.col("prompt"), F.col("form_building_type"))).withColumn("building_type", F.col("building.value"))
    rows = rows.withColumn("profile", F.when(F.col("building_type") == "office", F.lit("office")).otherwise(F.lit("residential")))
    # Two rows: the dimension is fixed, so broadcasting it is bounded.
    rows = rows.join(F.broadcast(profile.withColumnRenamed("building_type", "profile")), "profile")
    p, usual = F.col("prompt"), F.concat("building_type", F.lit("_template_default"))
    # Each pattern is looked for once a row; what follows refers to what it found.
    told = {"_floors": prompt_int(p, FLOORS), "_units": prompt_int(p, UNITS), "_standard": prompt_float(p, STANDARD_HEIGHT), "_first": prompt_float(p, FIRST_HEIGHT), "_area": prompt_float(p, SITE_AREA), "_far": prompt_float(p, FAR)}
    rows = rows.withColumns(told)
    said = F.col("_floors")
    from_text = said.isNotNull()
    floors = resolved(
        F.col("form_floors"),
        F.coalesce(said, F.col("drawn_floors")),
        F.lit(1).cast("long"),
        F.when(from_text, F.lit("text_prompt")).otherwise(F.lit("parsed_drawing")),
        F.when(from_text, F.lit(0.85)).otherwise(F.lit(0.72)),
        usual,
    )
    drawn = resolved(F.lit(None).cast("double"), F.col("drawn_area"), None, "parsed_drawing_inferred_boundary", 0.7)
    rows = rows.withColumns(
        {
            "source_mode": text.source_mode(p, F.col("mode_hint"), F.col("assets")),
            "floors": floors,
            "standard_floor_height_m": resolved(F.col("form_height"), F.col("_standard"), F.col("default_standard"), default_source=usual),
            "first_floor_height_m": resolved(F.col("form_first_height"), F.col("_first"), F.col("default_first"), default_source=usual),
            "site_area_sqm": F.coalesce(resolved(F.col("form_area"), F.col("_area")), drawn),
            "far": resolved(F.col("form_far"), F.col("_far")),
            "units_per_floor": resolved(F.col("form_units"), F.col("_units"), F.col("default_units"), default_source=usual),
            "roof": text.roof_command(p),
            "patch": text.window_patch(p),
        }
    )
    return rows.drop("profile", "default_standard", "default_first", "default_units", *told)


FIELDS = (("constraints.floors", "floors"), ("constraints.standard_floor_height_m", "standard_floor_height_m"), ("constraints.first_floor_height_m", "first_floor_height_m"), ("site.area_sqm", "site_area_sqm"), ("constraints.far", "far"), ("program.units_per_floor", "units_per_floor"))


def traces(intents: DataFrame) -> DataFrame:
    """bundle_id, trace_seq, field, value, source, confidence: where every field of an intent came from, in the order in
    which they are settled."""

    def row(field: str, value: Column, source: Column | str, confidence: Column | float, when: Column | None = None) -> Column:
        told = F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), (F.lit(source) if isinstance(source, str) else source).alias("source"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))
        return told if when is None else F.when(when, told)

    drawn = F.col("assets") > 0
    either = lambda yes, no: F.when(drawn, F.lit(yes)).otherwise(F.lit(no))
    told = either("parsed_drawing", "system_default")
    asked, formats = F.col("patch").isNotNull(), F.coalesce(F.size("output_formats"), F.lit(0)) > 0
    boundary = F.when(F.col("site_boundary_detected") | drawn, F.lit("drawing_or_uploaded_polygon")).otherwise(F.lit("unspecified"))
    rows = [
        row("building_type", F.col("building_type"), F.col("building.source"), F.when(F.col("building.source") == "form_input", F.lit(1.0)).otherwise(F.lit(0.8))),
        row("source_mode", F.col("source_mode"), either("parsed_assets", "system_default"), either(0.95, 0.6)),
        *(row(name, F.col(f"{c}.value"), F.col(f"{c}.source"), F.col(f"{c}.confidence"), F.col(c).isNotNull()) for name, c in FIELDS),
        row("region", F.lit("building_type_default_ruleset"), "system_default", 0.5, F.nullif("region", F.lit("")).isNull()),
        row("constraints.ruleset", F.col("ruleset"), "building_type_ruleset", 0.85),
        row("site.boundary_source", boundary, told, either(0.8, 0.6)),
        row("site.north_angle", F.col("north_angle"), told, either(0.75, 0.4)),
        row("program.spaces_from_drawings", (F.col("space_candidates") > 0) | (F.col("source_mode") == "cad_to_bim"), told, either(0.75, 0.5)),
        row("model_patch", F.col("patch.target_family"), "text_prompt", 0.9, asked),
        row("element_selector", F.lit("IfcWindow"), "text_prompt", 0.85, asked),
        row("deliverables", F.when(formats, F.array_join("output_formats", ",")).otherwise(F.lit("ifc")), F.when(formats, F.lit("form_input")).otherwise(F.lit("template_default")), F.when(formats, F.lit(1.0)).otherwise(F.lit(0.8))),
        row("final_use", F.lit("revit_view"), "system_default", 0.8),
        row("roof.roof_type", F.col("roof.roof_type"), "text_prompt", 0.85, F.col("roof").isNotNull()),
    ]
    return intents.select("bundle_id", F.posexplode(F.array_compact(F.array(*rows))).alias("n", "t")).select("bundle_id", (F.col("n") + 1).alias("trace_seq"), "t.*")


def lacking_fields(no_area: Column) -> dict[str, Column]:
    """Fields that may be missing, and when they are: the region, and in text mode the site's area."""
    return {"region": F.nullif("region", F.lit("")).isNull(), "site.area_sqm": (F.col("source_mode") == "text_only") & no_area}


def missing_fields(intents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """bundle_id, field, critical: the region, and in text mode the site's area; neither is critical. `keep` names columns of
    the intents that stay."""
    row = lambda when, field: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(False).alias("critical")))
    rules = [row(when, field) for field, when in lacking_fields(F.col("site_area_sqm").isNull()).items()]
    return intents.select("bundle_id", *keep, F.explode(F.array(*rules)).alias("m")).where("m is not null").select("bundle_id", *keep, "m.*")


# The answers that a question suggests, and labels of the summary.
ASSUMED_ANSWERS, MISSING_ANSWERS = ("正确，继续", "需要修改"), ("稍后补充", "使用默认值")
TYPE_LABELS, MODE_LABELS = {"residential": "住宅", "office": "办公"}, {"cad_to_bim": "CAD驱动建模"}


def parsed_summary(intents: DataFrame, action: str = "replace_family") -> DataFrame:
    """bundle_id, summary: up to ten labelled parts, those that are there: type, mode, floors, storey height, site area, far,
    drawings, assumptions (template defaults, the rule set, a roof), missing fields and the change that is asked for. The counts
    come out of each intent's own row."""
    assumed = sum((F.coalesce(F.endswith(F.col(c)["source"], F.lit("_template_default")), F.lit(False)).cast("int") for _, c in FIELDS), F.lit(1) + F.col("roof").isNotNull().cast("int"))
    no_region = F.nullif("region", F.lit("")).isNull()
    no_area = (F.col("source_mode") == "text_only") & F.col("site_area_sqm").isNull()
    lacking = no_region.cast("int") + no_area.cast("int")
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TYPE_LABELS.items() for x in pair)), F.col("building_type")), F.col("building_type"))
    mode = F.when(F.col("source_mode") == "cad_to_bim", F.lit(MODE_LABELS["cad_to_bim"])).otherwise(F.lit("文本描述建模"))
    part = lambda label, value, after="": F.concat(F.lit(label), value.cast("string"), F.lit(after))
    some = lambda value, out: F.when(F.coalesce(value, F.lit(0)) != 0, out)
    area, far = F.col("site_area_sqm.value"), F.col("far.value")
    parts = [
        part("建筑类型：", kind),
        part("模式：", mode),
        part("层数：", F.col("floors.value"), " 层"),
        part("标准层层高：", F.col("standard_floor_height_m.value"), "m"),
        some(area, part("用地面积：", area, "㎡")),
        some(far, part("容积率：", far)),
        some(F.col("assets"), part("已解析图纸：", F.col("assets"), " 份")),
        some(assumed, part("系统假设：", assumed, " 项")),
        some(lacking, part("待确认项：", lacking, " 项")),
        F.when(F.col("patch").isNotNull(), F.concat(F.lit("修改指令："), F.lit(action), F.lit(" → "), F.col("patch.target_family"))),
    ]
    return intents.select("bundle_id", text.request_summary(parts).alias("summary"))


def clarifications(intents: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """The first QUESTIONS questions of every bundle, with their text, suggested answers and confidence: assumed values of low
    confidence in the order of FIELDS, as they are settled, then critical missing fields (`missing`: field, critical and
    perhaps reason). Of an intent's own missing fields none is critical, so without a table they ask nothing."""

    def row(seq: int, name: str, c: str) -> Column:
        f = F.col(c)
        when = F.endswith(f["source"], F.lit("_template_default")) & (f["confidence"] < LEAST_CONFIDENCE)
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("field"), f["value"].cast("string").alias("value"), f["source"].alias("source"), f["confidence"].alias("confidence")))

    assumed = F.explode(F.array(*(row(i, name, c) for i, (name, c) in enumerate(FIELDS)))).alias("q")
    rows = intents.select("bundle_id", assumed).where("q is not null").select("bundle_id", F.lit(0).alias("kind"), "q.*", F.lit(None).cast("string").alias("reason"))
    if missing is not None:
        missing = missing if "reason" in missing.columns else missing.withColumn("reason", F.lit(None).cast("string"))
        none = F.lit(None).cast("string")
        rows = rows.unionByName(missing.where("critical").select("bundle_id", F.lit(1).alias("kind"), F.lit(0).alias("seq"), "field", none.alias("value"), none.alias("source"), F.lit(0.3).alias("confidence"), "reason"))
    n = F.row_number().over(Window.partitionBy("bundle_id").orderBy("kind", "seq", "field"))
    # Texts are made of the questions that are asked, past the window.
    first, is_assumed = rows.withColumn("question_seq", n).where(F.col("question_seq") <= QUESTIONS), F.col("kind") == 0
    asked = F.format_string("系统假设 %s 为 %s（来源：%s），是否正确？", "field", "value", "source")
    lacking = F.concat(F.lit("缺少关键信息："), F.coalesce("reason", "field"))
    answers = lambda v: F.array(*map(F.lit, v))
    return first.select("bundle_id", "field", F.when(is_assumed, asked).otherwise(lacking).alias("question"), F.when(is_assumed, answers(ASSUMED_ANSWERS)).otherwise(answers(MISSING_ANSWERS)).alias("suggested_answers"), "confidence", "question_seq")


# What a conflict says.
DRAWN_AREA, FLOORS_REASON, AREA_REASON = "图纸推断面积", "用户明确指定层数，优先使用文本输入", "用户提供的用地面积优先于图纸推断"


def conflicts(intents: DataFrame, drawn: DataFrame) -> DataFrame:
    """bundle_id, field, text_value, drawing_value, resolution, reason of form values that the drawings contradict: floors
    other than the number of storey candidates, and any area where a site boundary was detected. `drawn` has bundle_id,
    candidate_names, site_boundary_detected."""
    rows = intents.join(drawn, "bundle_id")
    floors = F.col("form_floors").isNotNull() & (F.col("candidate_names") > 0) & (F.col("form_floors") != F.col("candidate_names"))
    area = F.col("form_area").isNotNull() & F.col("site_boundary_detected")
    row = lambda when, field, a, b, why: F.when(when, F.struct(F.lit(field).alias("field"), F.col(a).cast("double").alias("text_value"), b.cast("string").alias("drawing_value"), F.lit("use_text").alias("resolution"), F.lit(why).alias("reason")))
    rules = [row(floors, "constraints.floors", "form_floors", F.col("candidate_names"), FLOORS_REASON), row(area, "site.area_sqm", "form_area", F.lit(DRAWN_AREA), AREA_REASON)]
    return rows.select("bundle_id", F.explode(F.array_compact(F.array(*rules))).alias("c")).select("bundle_id", "c.*")
