import hashlib
import json

from pyspark.sql import functions as F

from trussline.operators import components
from trussline.sources import dxf, pdf, registry
from trussline.streaming import feeds

DXF = """0
SECTION
2
HEADER
9
$INSUNITS
70
4
9
$EXTMIN
10
0.0
20
-5.0
9
$EXTMAX
10
100.0
20
50.0
0
ENDSEC
0
SECTION
2
ENTITIES
0
LINE
5
A1
8
A-WALL
10
0.0
20
0.0
11
4000.0
21
0.0
0
LWPOLYLINE
8
ROOM
70
1
10
0
20
0
10
5
20
0
10
5
20
5
0
POLYLINE
8
WALL
10
0
20
0
0
VERTEX
8
WALL
10
1.0
20
2.0
0
VERTEX
10
3.0
20
4.0
0
SEQEND
0
INSERT
2
door_90
8

10
7.0
20
8.0
0
TCH_OPENING
8
W
1
window
10
1.0
20
2.0
40
900
330
A1
330
A2
0
ENDSEC
0
EOF
"""


def test_drawings_in_byte_ranges_and_cells(spark, tmp_path, monkeypatch):
    block = "0\nINSERT\n2\ndoor_90\n66\n1\n10\n7.0\n20\n8.0\n0\nATTRIB\n1\nowned\n10\n1\n20\n1\n0\nATTRIB\n1\nowned too\n0\nSEQEND\n0\nATTDEF\n1\ndefined\n10\n5\n20\n6\n0\nATTRIB\n1\nalone\n"
    body = DXF.replace("0\nTCH_OPENING", block + "0\nTCH_OPENING")
    many = body.replace("0\nENDSEC\n0\nEOF\n", "".join(f"0\nLINE\n5\nB{i}\n8\nL{i % 7}\n10\n{i}\n20\n0\n11\n{i}\n21\n{i * 3}\n" for i in range(300)) + "0\nENDSEC\n0\nEOF\n")
    (tmp_path / "a.dxf").write_text(many)
    (tmp_path / "b.dxf").write_bytes(many.replace("\n", "\r\n").encode())
    (tmp_path / "c.dxf").write_text(body + "7")
    (tmp_path / "empty.dxf").write_text("")
    rows = lambda df: sorted(map(repr, df.collect()))
    plain = dxf.tags(dxf.read_files(spark, str(tmp_path))).where("asset_name <> 'empty.dxf'")
    want = rows(dxf.entities(plain))
    monkeypatch.setattr(dxf, "CELL", 5)
    for size in ("37b", "1000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            tags = dxf.read_tags(spark, str(tmp_path))
            assert rows(tags) == rows(plain)
            ranges = spark.read.text(str(tmp_path / "a.dxf")).select("_metadata.file_block_start").distinct().count()
            assert ranges >= len(many) // int(size[:-1]) // 2
            assert rows(dxf.entities(tags)) == want and rows(dxf.header_values(tags)) == rows(dxf.header_values(plain))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    got = [(r.dxftype, r.text) for r in dxf.entities(plain).where("asset_name = 'c.dxf'").orderBy("entity_seq").collect()]
    assert got[3:8] == [("INSERT", None), ("INSERT", None), ("ATTDEF", "defined"), ("ATTRIB", "alone"), ("TCH_OPENING", None)]


def test_dxf_files(spark, tmp_path):
    (tmp_path / "good.dxf").write_text(DXF)
    (tmp_path / "crlf.dxf").write_bytes(DXF.replace("\n", "\r\n").encode())
    (tmp_path / "bad.dxf").write_text(DXF.replace("70\n4", "oops\n4")[:-6])
    (tmp_path / "other.txt").write_text("x")
    tags = dxf.tags(dxf.read_files(spark, str(tmp_path)))
    assert [r.asset_name for r in dxf.broken_files(tags).collect()] == ["bad.dxf"]
    head = {r.asset_name: r for r in dxf.header_values(tags).collect()}
    assert head["good.dxf"].units == "mm" and tuple(head["good.dxf"].extents) == (0.0, -5.0, 100.0, 50.0)
    rows = dxf.entities(tags)
    got = {n: rows.where(F.col("asset_name") == n).orderBy("entity_seq").collect() for n in ("good.dxf", "crlf.dxf")}
    assert [r[2:] for r in got["good.dxf"]] == [r[2:] for r in got["crlf.dxf"]]
    line, room, wall, door, window = got["good.dxf"]
    assert (line.handle, [tuple(p) for p in line.points]) == ("A1", [(0.0, 0.0), (4000.0, 0.0)])
    assert room.closed and len(room.points) == 3
    assert wall.dxftype == "POLYLINE" and [tuple(p) for p in wall.points] == [(1.0, 2.0), (3.0, 4.0)] and not wall.closed
    assert (door.block_name, door.layer) == ("door_90", "0")
    assert window.xtags[330] == ["A1", "A2"]
    from trussline.operators import proxies

    opening = proxies.vendor_openings(rows.withColumn("bundle_id", F.lit(1)).where("asset_name = 'good.dxf'")).first()
    assert (opening.category, opening.vendor_width, opening.parents) == ("window_block", 900.0, ["A1", "A2"])
    roles = rows.withColumns({"bundle_id": F.lit(1), "role": F.lower("layer"), "block_role": F.lit("door")}).where("asset_name = 'good.dxf'")
    assert sorted(r.category for r in components.classified(roles).collect()) == ["door_block", "room_boundary", "wall_path"]
    marks = spark.createDataFrame([(b"AC1027xx",), (b"AC9999",), (b"%PDF-1.4",)], "c binary")
    assert [r.v for r in marks.select(dxf.dwg_version(F.col("c")).alias("v")).collect()] == ["R2013", "AC9999", None]


def test_register_integrity_ingest(spark, tmp_path):
    files = spark.createDataFrame([("up/a b.DXF", b"123"), ("..", b"")], "filename string, content binary")
    got = registry.register_assets(files).collect()
    assert [(r.storage_name, r.extension, r.size_bytes, r.content_hash) for r in got] == [("a_b.DXF", ".dxf", 3, hashlib.sha256(b"123").hexdigest()), ("asset.bin", ".bin", 0, hashlib.sha256(b"").hexdigest())]
    declared = spark.createDataFrame([("p1", 3, "h"), ("p2", 3, "h"), ("p3", 3, "h"), ("p4", 3, "h")], "path string, size_bytes long, content_hash string")
    stored = spark.createDataFrame([("p1", 3, "h"), ("p2", 4, "h"), ("p3", 3, "x")], "path string, size_bytes long, content_hash string")
    assert {r.path: r.violation for r in registry.integrity_violations(declared, stored).collect()} == {"p2": "size_mismatch", "p3": "hash_mismatch", "p4": "missing"}
    log = tmp_path / "log"
    log.mkdir()
    line = {"ingest_id": "i1", "timestamp": "2024-01-01T00:00:00Z", "path": "p2", "size_bytes": 3, "content_hash": "h"}
    (log / "a.json").write_text(json.dumps(line) + "\n\n" + json.dumps(line | {"ingest_id": "i2", "path": "p1"}) + "\n")
    assert registry.read_ingest_log(spark, str(log)).where("ingest_id is not null").count() == 2
    stream = feeds.checked_ingest(feeds.ingest_stream(spark, str(log)), stored)
    (log / "b.json").write_text(json.dumps(line))  # a repeated line
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.ingest_id, r.violation) for r in spark.read.parquet(f"{tmp_path}/out").where("ingest_id is not null").collect()) == [("i1", "size_mismatch"), ("i2", None)]


def test_versions_stream(spark, tmp_path):
    src, schema = tmp_path / "src", "project_id long, version_id string, ingest_seq long, body string"
    src.mkdir()
    batches = [[(1, "v1", 1, "a"), (1, "v2", 5, "b")], [(1, "v1", 3, "c"), (2, "v3", 4, "d")], [(1, "v1", 2, "late"), (2, "v3", 9, "e"), (None, None, 10, "f")]]
    for k, rows in enumerate(batches):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("project_id", "version_id", "ingest_seq", "body"), r))) for r in rows))
        stream = lambda: spark.readStream.schema(schema).json(str(src))
        feeds.write_changes(feeds.latest_stream(stream(), "version_id", ["project_id", "body"], "ingest_seq"), f"{tmp_path}/v", f"{tmp_path}/cp1").awaitTermination()
        feeds.write_changes(feeds.latest_stream(stream(), "project_id", ["version_id"], "ingest_seq"), f"{tmp_path}/p", f"{tmp_path}/cp2").awaitTermination()
    log = spark.read.schema("version_id string, ingest_seq long, project_id long, body string, batch_id long").json(f"{tmp_path}/v")
    assert log.select("batch_id").distinct().count() == 3
    assert sorted(map(tuple, feeds.current(log, "version_id").where("version_id is not null").collect())) == [("v1", 3, 1, "c"), ("v2", 5, 1, "b"), ("v3", 9, 2, "e")]
    pointers = spark.read.schema("project_id long, ingest_seq long, version_id string, batch_id long").json(f"{tmp_path}/p")
    assert sorted(map(tuple, feeds.current(pointers, "project_id").where("project_id is not null").collect())) == [(1, 5, "v2"), (2, 9, "v3")]


def test_artifacts_and_logs_keep_other_versions(spark, tmp_path):
    one = spark.createDataFrame([(1, "v1", "a"), (2, "v1", "b")], "project_id long, version_id string, body string")
    two = spark.createDataFrame([(1, "v2", "c"), (2, "v1", "new")], "project_id long, version_id string, body string")
    for rows in (one, two, two):
        registry.write_artifacts(rows, f"{tmp_path}/a")
    got = spark.read.json(f"{tmp_path}/a").select("project_id", "version_id", "body").collect()
    assert sorted(map(tuple, got)) == [(1, "v1", "a"), (1, "v2", "c"), (2, "v1", "new")]
    for rows, batch in ((one, "x"), (two, "y"), (one, "x")):
        registry.append_batch(rows.select("body"), f"{tmp_path}/log", batch)
    assert sorted(tuple(r) for r in spark.read.json(f"{tmp_path}/log").select("batch_id", "body").collect()) == [("x", "a"), ("x", "b"), ("y", "c"), ("y", "new")]


def test_resolved_paths(spark):
    paths = {"/a/1/x/y/z/../../../model.ifc": "/a/1/model.ifc", "/a/1/../../../../b": "/b", "//a/./b/": "/a/b", "/a/..b/.../c": "/a/..b/.../c", "/": "/", "/a/1/x/../../../c/../a/1/m": "/a/1/m"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.q for r in rows.select("p", registry.resolved_path(F.col("p")).alias("q")).collect()} == paths
    cases = [("/a/1/x/y/z/../../../model.ifc", False, True), ("/a/1/../1/there", False, False), ("/a/10/there", True, False), ("/a/1/q/../../2/there", True, False), ("/a/1", False, True)]
    found = spark.createDataFrame([("/a/./1/", [("ifc", p), ("log", "x")]) for p, *_ in cases], "artifact_dir string, artifacts array<struct<name:string,path:string>>")
    got = registry.artifact(found, "ifc", spark.createDataFrame([("/a/1/there",), ("/a/2/there",)], "path string")).collect()
    assert {r.a.path: (r.escapes, r.missing) for r in got} == {p: (e, m) for p, e, m in cases}


def test_stored_files_are_hashed_only_where_sizes_agree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("a", b"123"), ("sub/b", b"124"), ("c", b"1234")):
        (tmp_path / name).write_bytes(content)
    h = hashlib.sha256(b"123").hexdigest()
    declared = spark.createDataFrame([(n, 3, h) for n in "abcd"], "path string, size_bytes long, content_hash string")
    assert {r.path: r.violation for r in registry.stored_violations(spark, declared, str(tmp_path)).collect()} == {"b": "hash_mismatch", "c": "size_mismatch", "d": "missing"}


def test_registry_tables(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)], "n long")
    got = registry.numbered(rows.repartition(7), "proj", ["n"], after=3)
    assert {r.n: r.id for r in got.collect()} == {i: f"proj_{i + 4:04d}" for i in range(50)}
    snap = registry.to_snapshot(spark.createDataFrame([(1, "x")], "a long, b string"), ["a", "b"])
    assert [(r.a, r.b) for r in registry.from_snapshot(snap.select("snapshot_json"), "a long, b string").collect()] == [(1, "x")]
    assets = spark.createDataFrame([("a1", ["x.dwg", "y.dxf"]), ("a2", ["q.pdf"]), ("a3", ["none"])], "asset_id string, candidates array<string>")
    found, missing = registry.routed_assets(assets, spark.createDataFrame([("y.dxf",), ("q.pdf",)], "path string"))
    assert {r.asset_id: (r.path, r.kind) for r in found.collect()} == {"a1": ("y.dxf", "cad"), "a2": ("q.pdf", "pdf")} and [r.asset_id for r in missing.collect()] == ["a3"]
    art = spark.createDataFrame([("/d", [("m", "/d/m.json"), ("n", "/d/../e/m.json")])], "artifact_dir string, artifacts array<struct<name:string,path:string>>")
    assert [r.escapes for r in registry.artifact(art, "m").collect()] == [False] and [r.escapes for r in registry.artifact(art, "n").collect()] == [True]
    req = spark.createDataFrame([("r1", ["a2", "a1"])], "request_id string, asset_ids array<string>")
    assert [r.asset_id for r in registry.request_assets(req, assets).orderBy("asset_seq").collect()] == ["a2", "a1"]


def test_pdf_tables(spark):
    items = spark.createDataFrame([("l", "A-WALL", 1.0, 2.0, 0.0, 5.0), ("re", None, 0.0, 0.0, 2.0, 3.0), ("c", "ROOM", 0.0, 0.0, 1.0, 1.0), ("zz", "x", 0.0, 0.0, 1.0, 1.0)], "operator string, layer string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.category, r.confidence, r.bbox.min_x) for r in pdf.vector_entities(items).collect()] == [("wall_line", 0.7, 0.0), ("block_region", 0.72, 0.0), ("room_boundary", 0.72, 0.0)]
    blocks = spark.createDataFrame([(0, " 1F plan "), (1, " ")], "page_index int, text string")
    assert [(r.text, r.semantic_tag) for r in pdf.text_annotations(blocks).collect()] == [("page 1: 1F plan", "view_marker")]
