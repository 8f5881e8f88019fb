"""Lists, records, rule files, stored files and vendor walls, as literal rows."""

import base64
import hashlib
import json

from pyspark.sql import functions as F

from trussline.operators import bundles, intents, proxies, rules
from trussline.sources import registry

ITEMS = "bundle_id long, list string, asset_seq long, item_seq long, value string"


def test_lists_keep_asset_order_and_limits(spark):
    rows = [(1, "grid_axes", a, i, f"{a}:{i}") for a in (2, 1) for i in range(50)]
    rows += [(1, "texts", 1, 1, "b"), (1, "texts", 0, 9, "a"), (1, "texts", 0, 2, "b"), (1, "layers", 1, 1, "x"), (1, "layers", 0, 1, "x")]
    got = bundles.bundle_lists(spark.createDataFrame(rows, ITEMS)).collect()
    axes = sorted((r.place, r.value) for r in got if r["list"] == "grid_axes")
    assert [v for _, v in axes] == [f"1:{i}" for i in range(50)] + [f"2:{i}" for i in range(30)]
    assert sorted((r.place, r.value) for r in got if r["list"] == "texts") == [(1, "b"), (2, "a")]
    assert [(r.asset_seq, r.place) for r in sorted(got) if r["list"] == "layers"] == [(0, None), (1, None)]
    assert bundles.bundle_lists(spark.createDataFrame([], ITEMS)).count() == 0


def test_limits_hold_before_the_exchange(spark):
    plan = bundles.bundle_lists(spark.createDataFrame([], ITEMS).repartition(4))._jdf.queryExecution().toString()
    below = plan[plan.index("== Physical Plan ==") :]
    assert "Partial" in below[below.index("WindowGroupLimit") :]


def test_record_of_bundles(spark):
    box = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
    kind = f"bundle_id long, asset_name string, storey_key string, component_type string, points array<struct<x:double,y:double>>, bbox {box}"
    e = spark.createDataFrame([(1, "a", f"{s}F", "wall", [(1.0, 2.0)], (1.0, 2.0, 1.0, 2.0)) for s in (10, 2, 2)], kind)
    f = spark.createDataFrame([(1, "3F", "plan"), (2, "1F", "section")], "bundle_id long, storey_key string, fragment_role string")
    axes = spark.createDataFrame([(1, "A", "L", "vertical", 1.0)], "bundle_id long, label string, layer string, orientation string, coordinate double")
    record = bundles.parse_analysis(e, f, axes)
    one, two = sorted(record.collect())
    assert (one.storey_keys, one.component_count, one.ready, one.cross_layer_ready, one.grid_signature) == (["2F", "10F"], 3, False, True, "A@1.000")
    assert [(i.category, i.n) for i in one.blocked] == [("storey_missing", 1)] and [i.category for i in one.need_review] == ["duplicate_component"]
    assert (two.ready, two.component_count, two.storeys, [i.category for i in two.need_review]) == (True, 0, [], ["grid_missing"])
    told = json.loads(sorted(bundles.parse_json(record).collect())[0].record)
    assert told["chains"] == [{"signature": "wall:2F;10F", "x": 1.0, "y": 2.0, "members": 3}] and told["duplicates"][0]["copies"] == 2


def test_rules_of_a_file(spark, tmp_path):
    sets = {i: dict(zip(("building_type", "min_floor_count", "min_standard_floor_height_m", "min_first_floor_height_m"), rest, strict=True)) for i, *rest in rules.RULESETS}
    (tmp_path / "rules.json").write_text(json.dumps({"shared": {"max_far_warning": rules.MAX_FAR}, "rulesets": sets, "rule_descriptions": {"a.b": "told"}}))
    limits, told = rules.configured(spark, str(tmp_path / "rules.json"))
    assert sorted(limits.drop("max_far").collect()) == sorted(rules.rulesets(spark).collect())
    assert {r.max_far for r in limits.collect()} == {rules.MAX_FAR} and told.collect() == [("a.b", "told")]
    (tmp_path / "bare.json").write_text("{}")
    limits, told = rules.configured(spark, str(tmp_path / "bare.json"))
    assert limits.count() == told.count() == 0


def test_stored_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, content in (("a", b"x"), ("b c", b"y")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f").write_bytes(content)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    declared = spark.createDataFrame([("a/f", 1, digest(b"x")), ("b c/f", 1, digest(b"x")), ("f", 1, digest(b"x"))], "path string, size_bytes long, content_hash string")
    assert {r.path: r.violation for r in registry.stored_violations(spark, declared, str(tmp_path), relative=True).collect()} == {"b c/f": "hash_mismatch", "f": "missing"}


def test_vendor_walls(spark):
    packed = lambda t: base64.b64encode(t.encode("utf-16-le")).decode()
    texts = ["0,4,1,1.00005,9", "2,2.0005,5,5", "2,2,7,9", "1,2", None]
    rows = [(1, "a", i, "TCH_WALL", "W", {300: [packed(t)] if t else [None], 42: ["200"]}) for i, t in enumerate(texts)]
    raw = spark.createDataFrame(rows, "bundle_id long, asset_name string, entity_seq long, dxftype string, layer string, xtags map<int,array<string>>")
    walls = proxies.vendor_walls(raw)
    assert sorted((r.entity_seq, r.anchor is not None) for r in walls.collect()) == [(0, False), (1, True), (2, False)]
    got = sorted((r.layer, [tuple(p) for p in r.points], r.confidence, r.source_ref) for r in proxies.vendor_wall_entities(walls).collect())
    made = [("WALL", [(2.0, 5.0), (2.0, 7.0)], 0.72, "tch-wall-vertical:2.0:1"), ("WALL", [(2.0, 7.0), (2.0, 9.0)], 0.72, "tch-wall-vertical:2.0:2")]
    assert got == [("W", [(0.0, 1.0), (4.0, 1.0)], 0.84, None), ("W", [(2.0, 7.0), (2.0, 9.0)], 0.84, None), *made]


def test_summary_leaves_out_what_is_not_there(spark):
    kind = "bundle_id long, prompt string, mode_hint string, assets long, form_building_type string, form_floors long, form_height double, form_area double, form_far double, drawn_floors long, drawn_area double, region string"
    rows = [(1, "住宅 3 层", "auto", 0, None, None, None, None, None, None, None, ""), (2, "将窗替换为落地窗", "auto", 2, "office", 4, 3.5, 900.0, 2.5, None, None, "cn")]
    made = intents.build_intents(spark.createDataFrame(rows, kind), intents.profiles(spark))
    one, two = (r.summary for r in intents.parsed_summary(made).orderBy("bundle_id").collect())
    assert one == "建筑类型：住宅；模式：文本描述建模；层数：3 层；标准层层高：3.0m；系统假设：4 项；待确认项：2 项"
    assert two == "建筑类型：办公；模式：CAD驱动建模；层数：4 层；标准层层高：3.5m；用地面积：900.0㎡；容积率：2.5；已解析图纸：2 份；系统假设：3 项；修改指令：replace_family → floor_to_ceiling_window"
    lacking = spark.createDataFrame([(2, "x", True, "why")], "bundle_id long, field string, critical boolean, reason string")
    last = intents.clarifications(made, lacking).where("bundle_id = 2").orderBy(F.desc("question_seq")).first()
    assert (last.question, last.suggested_answers, last.confidence) == ("缺少关键信息：why", ["稍后补充", "使用默认值"], 0.3)
