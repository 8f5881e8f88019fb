"""Text expressions: normalisation, labels, measures and tags found in drawing texts, file names and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import length_to_metres

# Patterns and word lists that decide which text means what.
GRID_LABEL = r"(?i)(?:\b(?:axis|grid)\b\s*([A-Z0-9-]+)|\b([A-Z]{1,3}-\d{1,3})\b|\b([A-Z]{1,3})\b|\b(\d{1,3})\b)"
NORTH_ANGLE = r"(?i)(?:north(?:\s*angle)?|true\s*north|北向)\s*[:=]?\s*([+-]?\d+(?:\.\d+)?)"
ELEVATION = r"(?i)(?:\b(?:el|elev|level)\b|[标层]高|[标楼]层)\s*[:=]?\s*([+-]?\d+(?:\.\d+)?)\s*(mm|cm|m)?"
SIGNED_ELEVATION = r"(?<!\d)([+-]\d+(?:\.\d{3,4})?)(?!\d)"
DIMENSION = r"(?i)(\d+(?:\.\d+)?)\s*(mm|cm|m)\b|(\d+)\s*[x×]\s*(\d+)(?:\s*(mm|cm|m))?"
UNIT = r"(?i)\b(mm|cm|m)\b"
ROLE_TOKENS = (
    ("grid", ("grid", "axis", "轴")),
    ("wall", ("wall", "墙")),
    ("door", ("door", "门")),
    ("window", ("window", "wind", "窗")),
    ("room", ("room", "space", "area", "房间", "空间")),
    ("dimension", ("dim", "尺寸", "标注")),
    ("text", ("text", "note", "文字", "说明")),
    ("elevation", ("elev", "level", "标高")),
    ("site_boundary", ("site", "plot", "boundary", "地块", "红线", "边界")),
    ("facade", ("facade", "elevation", "立面")),
)
ROOM_WORDS = ("室", "厅", "卫", "厨", "门厅", "走道", "楼梯", "宿舍", "办公室", "值班", "管理", "盥洗")
NO_ROOM_MARKS = ("，", ",", "。", "；", "：", "(", ")", "（", "）", "、")
NO_ROOM_WORDS = ("平面", "剖面", "立面", "详图", "节点", "雨水", "排水", "做法", "配筋", "宿舍楼", "广联达", "室外", "屋面", "屋顶", "地坪", "散水", "台阶", "现浇", "隔墙", "梁", "板", "屋顶层")
ROOF_WORDS = (
    ("双坡", "gable"),
    ("人字", "gable"),
    ("单坡", "shed"),
    ("四坡", "hip"),
    ("平顶", "flat"),
    ("平屋顶", "flat"),
    ("坡屋顶", "gable"),
    ("屋顶", "gable"),
    ("roof", "gable"),
    ("gable", "gable"),
    ("hip", "hip"),
    ("flat", "flat"),
)
PROMPT_DIGITS = (("一", "1"), ("二", "2"), ("三", "3"), ("四", "4"), ("五", "5"), ("六", "6"), ("七", "7"), ("八", "8"), ("九", "9"), ("十", "10"), ("两", "2"))
TCH_OPENING = (("door_block", ("door", "门")), ("window_block", ("window", "wind", "窗")))
GRID_LAYER = r"(?i)(?:^|[-_.\s])(axis|grid)(?:$|[-_.\s])|轴"


def holds(text: Column, words: Sequence[str]) -> Column:
    """Whether the text contains any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def first_case(branches: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match or if the group took no part."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalize_text(text: Column) -> Column:
    """NUL as a blank, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit(" ")), r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{3000}]+", " "))


def is_grid_layer(name: Column) -> Column:
    """Whether a layer's name has axis or grid as a part of its own, or 轴; false for null."""
    return F.coalesce(F.rlike(name, F.lit(GRID_LAYER)), F.lit(False))


def safe_float(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def semantic_role(name: Column) -> Column:
    """Role of a layer or block name; the first group with a token in the name decides."""
    low = F.lower(name)
    return F.when(name.isNull() | (name == ""), F.lit("unknown")).otherwise(first_case([(holds(low, tokens), F.lit(role)) for role, tokens in ROLE_TOKENS], F.lit("unknown")))


def grid_label(text: Column) -> Column:
    t = normalize_text(text)
    return F.upper(F.coalesce(*(found(t, GRID_LABEL, g) for g in range(1, 5))))


def north_angle(text: Column) -> Column:
    return F.round(found(normalize_text(text), NORTH_ANGLE).try_cast("double"), 2)


def elevations(text: Column) -> Column:
    """Elevations in metres: values after a keyword, with their units; only without any, signed numbers."""
    t = normalize_text(text)
    value, unit = (F.regexp_extract_all(t, F.lit(ELEVATION), F.lit(g)) for g in (1, 2))
    named = F.zip_with(value, unit, lambda v, u: F.round(length_to_metres(v.cast("double"), F.nullif(u, F.lit(""))), 3) + F.lit(0.0))
    signed = F.transform(F.regexp_extract_all(t, F.lit(SIGNED_ELEVATION), F.lit(1)), lambda v: F.round(v.cast("double"), 3) + F.lit(0.0))
    return F.when(F.size(value) > 0, named).otherwise(signed)


def dimensions(text: Column) -> Column:
    """Array of kind, text, value, unit: `3.5 m` is a text_dimension, `800 x 1200` a size_pair without a value."""
    t = normalize_text(text)
    parts = [F.regexp_extract_all(t, F.lit(DIMENSION), F.lit(g)) for g in (0, 1, 2, 5)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("whole", "value", "unit", "pair_unit"), strict=True)))
    return F.transform(
        zipped,
        lambda m: F.struct(
            F.when(m["value"] != "", F.lit("text_dimension")).otherwise(F.lit("size_pair")).alias("kind"),
            m["whole"].alias("text"),
            F.round(F.nullif(m["value"], F.lit("")).cast("double"), 3).alias("value"),
            F.lower(F.nullif(F.when(m["value"] != "", m["unit"]).otherwise(m["pair_unit"]), F.lit(""))).alias("unit"),
        ),
    )


def unit_token(text: Column) -> Column:
    return F.lower(found(text, UNIT))


def is_room_label(text: Column) -> Column:
    """A short text without digits or punctuation that holds a room word and no word of a drawing title."""
    short = text.isNotNull() & (text != "") & (F.char_length(text) <= 8) & ~text.rlike(r"\p{Nd}")
    storey = F.endswith(text, F.lit("层")) & ~F.contains(text, F.lit("楼梯间"))
    return short & ~holds(text, NO_ROOM_MARKS) & ~holds(text, NO_ROOM_WORDS) & ~storey & holds(text, ROOM_WORDS)


def text_tag(text: Column, layer_role: Column) -> Column:
    """What a text is; the first rule that fits decides."""
    t = normalize_text(text)
    low = F.lower(t)
    return first_case(
        [
            (north_angle(t).isNotNull(), F.lit("north_angle")),
            (F.size(elevations(t)) > 0, F.lit("elevation")),
            (holds(low, ("plan", "section", "elevation", "floor")) | holds(t, ("平面", "剖面", "立面", "标准层")), F.lit("view_marker")),
            (t.rlike(DIMENSION), F.lit("dimension")),
            (grid_label(t).isNotNull(), F.lit("grid_label")),
            (is_room_label(t), F.lit("room_label")),
            (layer_role.isin("room", "space"), F.lit("room_label")),
        ],
        F.lit("generic"),
    )


def _candidate(when: Column, name: Column, source: Column, confidence: Column) -> Column:
    return F.when(when, F.struct(name.alias("name"), source.alias("source"), confidence.alias("confidence")))


def descriptor_candidates(descriptor: Column) -> Column:
    """Storey candidates that an asset's description names."""
    low, source, confidence = F.lower(descriptor), F.lit("asset_descriptor"), F.lit(0.85)
    return F.array_compact(
        F.array(
            _candidate(holds(descriptor, ("标准层", "平面图")) | holds(low, ("plan", "floor")), F.lit("standard_floor"), source, confidence),
            _candidate(holds(descriptor, ("立面",)) | holds(low, ("elevation",)), F.lit("facade_reference"), source, confidence),
            _candidate(holds(descriptor, ("剖面",)) | holds(low, ("section",)), F.lit("section_reference"), source, confidence),
        )
    )


def view_marker_candidates(text: Column, storey: Column, confidence: Column, source: Column) -> Column:
    """Storey candidates of a text. A prefix without a letter or digit before the view's name marks a callout, which names
    no section or facade; `storey` is the storey the text names, if any, and makes the text itself a candidate."""
    t = normalize_text(text)
    low = F.lower(t)
    places = [F.instr(t, w) for w in ("平面", "剖面", "立面")] + [F.instr(low, w) for w in ("plan", "section", "elevation")]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    prefix = F.trim(F.substring(t, F.lit(1), F.coalesce(first - 1, F.lit(0))))
    callout = (prefix != "") & ~prefix.rlike(r"[\p{L}\p{N}]")
    return F.array_compact(
        F.array(
            _candidate(holds(t, ("平面", "标准层")) | holds(low, ("plan", "floor")), F.lit("standard_floor"), source, confidence),
            _candidate(~callout & (holds(t, ("剖面",)) | holds(low, ("section",))), F.lit("section_reference"), source, confidence),
            _candidate(~callout & (holds(t, ("立面",)) | holds(low, ("elevation",))), F.lit("facade_reference"), source, confidence),
            _candidate(storey.isNotNull(), t, source, F.least(confidence + 0.05, F.lit(0.95))),
        )
    )


def prompt_digits(prompt: Column) -> Column:
    """Each Chinese digit as ASCII digits, one by one (so 十二 becomes 102)."""
    out = prompt
    for word, digit in PROMPT_DIGITS:
        out = F.replace(out, F.lit(word), F.lit(digit))
    return out


def prompt_int(prompt: Column, pattern: str) -> Column:
    return found(prompt, pattern).try_cast("long")


def prompt_float(prompt: Column, pattern: str) -> Column:
    return found(prompt, pattern).try_cast("double")


def building_type(prompt: Column, form: Column) -> Column:
    """Struct of value and source: the form's, else what the prompt names, else residential."""
    low = F.lower(prompt)
    value = lambda v, s: F.struct(v.alias("value"), F.lit(s).alias("source"))
    return first_case(
        [
            (F.nullif(form, F.lit("")).isNotNull(), value(form, "form_input")),
            (holds(low, ("住宅", "宿舍", "公寓", "residential")), value(F.lit("residential"), "text_prompt")),
            (holds(low, ("办公", "office")), value(F.lit("office"), "text_prompt")),
        ],
        value(F.lit("residential"), "template_default"),
    )


def source_mode(prompt: Column, hint: Column, assets: Column) -> Column:
    by_assets = F.when(assets > 0, F.lit("cad_to_bim")).otherwise(F.lit("text_only"))
    return first_case([(hint != "auto", F.when(hint == "cad_to_bim", hint).otherwise(F.lit("text_only"))), (F.contains(prompt, F.lit("无图纸")) | F.contains(F.lower(prompt), F.lit("text_only")), F.lit("text_only"))], by_assets)


def window_patch(prompt: Column) -> Column:
    """Struct of width_mm, height_mm, target_family if the prompt asks to replace windows, else null."""
    low, pair = F.lower(prompt), r"(\d+)\s*[xX×]\s*(\d+)"
    asked = (F.contains(prompt, F.lit("窗")) | F.contains(low, F.lit("window"))) & (holds(prompt, ("替换", "更换")) | F.contains(low, F.lit("replace")))
    family = F.when(F.contains(prompt, F.lit("落地窗")), F.lit("floor_to_ceiling_window")).otherwise(F.lit("updated_window"))
    return F.when(asked, F.struct(F.coalesce(found(prompt, pair, 1).try_cast("long"), F.lit(800)).alias("width_mm"), F.coalesce(found(prompt, pair, 2).try_cast("long"), F.lit(1200)).alias("height_mm"), family.alias("target_family")))


def roof_command(prompt: Column) -> Column:
    """Struct of roof_type, slope_deg, overhang_m if the prompt speaks of a roof of known type, else null."""
    low = F.lower(prompt)
    kind = first_case([(F.contains(low, F.lit(w)), F.lit(k)) for w, k in ROOF_WORDS])
    slope = F.coalesce(prompt_float(prompt, r"(\d+)\s*[°度]"), F.lit(30.0))
    overhang = F.coalesce(prompt_float(prompt, r"悬挑\s*(\d+(?:\.\d+)?)\s*[m米]"), F.lit(0.6))
    return F.when(holds(low, ("屋顶", "坡", "roof")) & kind.isNotNull(), F.struct(kind.alias("roof_type"), slope.alias("slope_deg"), overhang.alias("overhang_m")))


def wall_vector(encoded: Column) -> Column:
    """x1, x2, y1, y2 of a vendor wall: base64 of UTF-16LE text with four comma-separated numbers or more; else null."""
    parts = F.split(F.decode(F.try_to_binary(encoded, F.lit("base64")), "UTF-16LE"), ",")
    values = [F.get(parts, i).try_cast("double") for i in range(4)]
    ok = F.size(parts) >= 4
    for v in values:
        ok = ok & v.isNotNull()
    return F.when(ok, F.struct(*(v.alias(n) for v, n in zip(values, ("x1", "x2", "y1", "y2"), strict=True))))


def opening_category(tags: Sequence[Column], layer: Column, layer_role: Column) -> Column:
    """Category of a vendor opening from its texts and layer; else by the layer's role; else a window."""
    text = F.lower(F.concat_ws(" ", *tags, layer))
    return first_case([(holds(text, words), F.lit(c)) for c, words in TCH_OPENING] + [(layer_role == "door", F.lit("door_block"))], F.lit("window_block"))


def request_summary(parts: Sequence[Column]) -> Column:
    """The parts that are there, joined for display."""
    return F.concat_ws("；", *parts)


def safe_filename(name: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("asset.bin"))
