"""ASCII DXF drawings as Spark jobs: group-code pairs, entities of the model space, header values and vertices.

`read_tags` reads a drawing by byte ranges in many tasks; `tags` takes drawings that are columns already. Whatever depends on
the tags before ("in which section", "of which entity") is a segmented scan: windows over cells of a drawing, and what each
cell carries over to the next from a table of one row a cell. No task holds a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry

# Units of the header and versions of DWG files.
UNITS = {"1": "inch", "4": "mm", "5": "cm", "6": "m"}
DWG_VERSIONS = {"AC1012": "R13", "AC1014": "R14", "AC1015": "R2000", "AC1018": "R2004", "AC1021": "R2007", "AC1024": "R2010", "AC1027": "R2013", "AC1032": "R2018"}


#: Tags of a cell of a drawing, the unit that one task sorts.
CELL = 1 << 16


def read_lines(spark: SparkSession, path: str, pattern: str = "*.dxf", encoding: str = "UTF-8") -> DataFrame:
    """path, line_no (from 0), line of every drawing below the path, each read by byte ranges. A line's number is its place
    in its range and the lines of the ranges before, which are counted first: one row a range."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    line = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    # Lines of one range follow each other in one task, so these ids differ by their distance.
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), line.alias("line"))
    ranges = rows.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # The driver has listed these files already, so a row a range is no more than it holds.
    return rows.join(F.broadcast(ranges), ["path", "start"]).select("path", (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "line")


def read_tags(spark: SparkSession, path: str, pattern: str = "*.dxf", encoding: str = "UTF-8", name: Column | None = None) -> DataFrame:
    """asset_name, tag_seq, code, value of every drawing below the path, as `tags` gives them, but a drawing of any size is
    read by many tasks: even lines are codes, odd ones values, wherever a byte range begins. Assets are named by their file,
    or by an expression on `path`; names must differ."""
    lines = read_lines(spark, path, pattern, encoding).withColumn("asset_name", F.element_at(F.split("path", "/"), -1) if name is None else name)
    # A cell has an even number of lines, so no pair is in two.
    within = Window.partitionBy("asset_name", "cell").orderBy("line_no")
    lines = lines.withColumn("cell", F.floor(F.col("line_no") / (2 * CELL))).withColumn("next", F.lead("line").over(within))
    pairs = lines.where((F.col("line_no") % 2 == 0) & F.col("next").isNotNull())
    return pairs.select("asset_name", F.floor(F.col("line_no") / 2).alias("tag_seq"), F.trim("line").try_cast("int").alias("code"), F.trim("next").alias("value"))


def read_files(spark: SparkSession, path: str, pattern: str = "*.dxf") -> DataFrame:
    """asset_name, content (binary) of every drawing below the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("asset_name"), "content")


def tags(files: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """asset_name, tag_seq, code, value: lines in pairs. A code that is no number marks a broken file (code null)."""
    lines = F.split(F.regexp_replace(F.decode("content", encoding), "\r\n?", "\n"), "\n")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(lines) / 2) - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.trim(F.get(lines, 2 * i)).try_cast("int").alias("code"), F.trim(F.get(lines, 2 * i + 1)).alias("value")))
    return files.select("asset_name", F.posexplode(pairs).alias("tag_seq", "p")).select("asset_name", F.col("tag_seq").cast("long").alias("tag_seq"), "p.code", "p.value").where("value is not null")


def broken_files(all_tags: DataFrame) -> DataFrame:
    """Review rows for files with a broken pair before their end."""
    bad = all_tags.groupBy("asset_name").agg(F.bool_or(F.col("code").isNull()).alias("broken"), F.bool_or((F.col("code") == 0) & (F.col("value") == "EOF")).alias("ended"))
    return bad.where("broken or not ended").select("asset_name", F.lit("parse_failed").alias("category"), F.lit("error").alias("severity"))


#: Entities that belong to the one before them: vertices and the end of old polylines and blocks, attributes of a block.
PARTS = ("VERTEX", "SEQEND", "ATTRIB")


def sections(all_tags: DataFrame, last: dict[str, Column] | None = None) -> DataFrame:
    """Tags with their section's name, the kind (own) and running number of their entity (entity_seq: tags of code 0 so
    far), kind and number of the last entity that can have parts (head), and the last values so far that are not null of
    more expressions (`last`).

    One segmented scan tells all of them. A name (code 2) that stands before the first entity of its cell is pending: it
    names a section if the cells before end in a SECTION."""
    rows = all_tags.select("asset_name", "tag_seq", "code", "value", F.floor(F.col("tag_seq") / CELL).alias("cell"))
    within = Window.partitionBy("asset_name", "cell").orderBy("tag_seq")
    opens = F.col("code") == 0
    rows = rows.withColumns({"_own": F.last(F.when(opens, F.col("value")), ignorenulls=True).over(within), "_n": F.sum(F.when(opens, 1).otherwise(0).cast("long")).over(within)})
    named = F.when((F.col("_own") == "SECTION") & (F.col("code") == 2), F.col("value")).when(opens & (F.col("value") == "ENDSEC"), F.lit(""))
    pending = F.when(F.col("_own").isNull() & (F.col("code") == 2), F.col("value"))
    head = F.when(opens & ~F.col("value").isin(*PARTS), F.struct(F.col("value").alias("kind"), F.col("_n").alias("entity_seq")))
    last = last or {}
    rows = rows.withColumns({k: F.last(c, ignorenulls=True).over(within) for k, c in (("_section", named), ("_pending", pending), ("_head", head), *((f"_{k}", c) for k, c in last.items()))})
    moved = lambda by: F.when(F.col("_head").isNotNull(), F.struct(F.col("_head.kind").alias("kind"), (F.col("_head.entity_seq") + by).alias("entity_seq")))
    ends = rows.groupBy("asset_name", "cell").agg(F.max_by(F.struct("_own", "_n", "_section", "_pending", "_head", *(f"_{k}" for k in last)), "tag_seq").alias("e")).select("asset_name", "cell", "e.*")
    before = Window.partitionBy("asset_name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"before_own": F.last("_own", ignorenulls=True).over(before), "before_n": F.sum("_n").over(before)})
    own_name = F.coalesce("_section", F.when(F.col("before_own") == "SECTION", F.col("_pending")))
    carried = {"before_section": F.last(own_name, ignorenulls=True).over(before), "before_head": F.last(moved(F.coalesce("before_n", F.lit(0))), ignorenulls=True).over(before)}
    carried |= {f"before_{k}": F.last(f"_{k}", ignorenulls=True).over(before) for k in last}
    # The first cell of a drawing takes nothing over. Never broadcast: the size of what is left is not told beforehand.
    ends = ends.withColumns(carried).where("before_n is not null").select("asset_name", "cell", "before_own", "before_n", *carried).hint("merge")
    n = F.coalesce("before_n", F.lit(0))
    section = F.coalesce("_section", F.when(F.col("before_own") == "SECTION", F.col("_pending")), "before_section")
    return rows.join(ends, ["asset_name", "cell"], "left").select("asset_name", "tag_seq", "code", "value", F.coalesce("_own", "before_own").alias("own"), (F.col("_n") + n).alias("entity_seq"), section.alias("section"), F.coalesce(moved(n), "before_head").alias("head"), *(F.coalesce(f"_{k}", f"before_{k}").alias(k) for k in last))


def header_values(all_tags: DataFrame) -> DataFrame:
    """asset_name, units, base_x, base_y, extents of the header."""
    name = F.when(F.col("code") == 9, F.col("value")).when((F.col("code") == 0) & (F.col("value") == "SECTION"), F.lit(""))
    rows = sections(all_tags, {"name": name}).where("section = 'HEADER'")
    pick = lambda name, code: F.max(F.when((F.col("name") == name) & (F.col("code") == code), F.col("value")))
    per = rows.groupBy("asset_name").agg(pick("$INSUNITS", 70).alias("u"), *(pick(n, c).try_cast("double").alias(a) for n, c, a in (("$INSBASE", 10, "base_x"), ("$INSBASE", 20, "base_y"), ("$EXTMIN", 10, "x0"), ("$EXTMIN", 20, "y0"), ("$EXTMAX", 10, "x1"), ("$EXTMAX", 20, "y1"))))
    units = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in UNITS.items() for x in p)), "u"), F.lit("unknown"))
    whole = F.when(F.col("x0").isNotNull() & F.col("x1").isNotNull(), geometry.box(*map(F.col, ("x0", "y0", "x1", "y1"))))
    return per.select("asset_name", units.alias("units"), "base_x", "base_y", whole.alias("extents"))


def entity_layer(layer: Column, xtags: Column) -> Column:
    """The entity's layer, else the first tag of code 8 that is not blank, else `0`."""
    from_tags = F.get(F.filter(F.try_element_at(xtags, F.lit(8)), lambda v: F.trim(v) != ""), 0)
    return F.coalesce(F.nullif(F.trim(layer), F.lit("")), from_tags, F.lit("0"))


def is_closed(flag: Column, points: Column) -> Column:
    same = (F.size(points) > 2) & (F.get(points, 0) == F.element_at(points, -1))
    return (flag.bitwiseAND(F.lit(1)) == 1) | F.coalesce(same, F.lit(False))


def entities(all_tags: DataFrame) -> DataFrame:
    """Entities of the ENTITIES section: asset_name, entity_seq, dxftype, layer, handle, block_name, text, points, closed,
    xtags (code -> values in order). Vertices of old polylines belong to the polyline before them; attributes that follow a
    block are no entities of the model space, others are."""
    rows = sections(all_tags).where("section = 'ENTITIES' and own not in ('SECTION', 'ENDSEC', 'SEQEND')")
    rows = rows.where("own <> 'ATTRIB' or head.kind is null or head.kind <> 'INSERT'")
    vertex = rows.where("own <> 'VERTEX' or code in (10, 20)").withColumn("entity_seq", F.when(F.col("own") == "VERTEX", F.col("head.entity_seq")).otherwise(F.col("entity_seq")))
    # Codes of one entity, values in the order of the file: one exchange, then within the entity's row.
    per = vertex.groupBy("asset_name", "entity_seq").agg(F.array_sort(F.collect_list(F.struct("tag_seq", "code", "value"))).alias("t")).where(F.exists("t", lambda t: t["code"] == 0))
    codes = F.array_distinct(F.filter(F.transform("t", lambda t: t["code"]), lambda c: c.isNotNull()))
    of = lambda c: F.transform(F.filter("t", lambda t: t["code"] == c), lambda t: t["value"])
    per = per.select("asset_name", "entity_seq", F.map_from_entries(F.transform(codes, lambda c: F.struct(c.alias("code"), of(c).alias("v")))).alias("xtags"))
    one = lambda code: F.get(F.try_element_at("xtags", F.lit(code)), 0)
    many = lambda code: F.coalesce(F.try_element_at("xtags", F.lit(code)), F.array().cast("array<string>"))
    near = F.zip_with(many(10), many(20), lambda x, y: geometry.point(F.round(x.try_cast("double"), 3), F.round(y.try_cast("double"), 3)))
    # The head of an old polyline carries a dummy point.
    near = F.when((one(0) == "POLYLINE") & (F.size(near) > 0), F.slice(near, 2, F.greatest(F.size(near) - 1, F.lit(0)))).otherwise(near)
    far = F.zip_with(many(11), many(21), lambda x, y: geometry.point(F.round(x.try_cast("double"), 3), F.round(y.try_cast("double"), 3)))
    points = F.when(one(0).isin("LINE", "XLINE", "RAY"), F.concat(near, far)).otherwise(near)
    out = per.withColumns({"dxftype": one(0), "layer": entity_layer(one(8), F.col("xtags")), "handle": one(5), "block_name": F.when(one(0) == "INSERT", one(2)), "text": F.when(one(0).isin("TEXT", "MTEXT", "TCH_TEXT", "ATTRIB", "ATTDEF"), one(1)), "points": F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())})
    flag = F.coalesce(one(70).try_cast("int"), F.lit(0))
    poly = F.col("dxftype").isin("LWPOLYLINE", "POLYLINE")
    return out.withColumn("closed", poly & is_closed(flag, F.col("points"))).select("asset_name", "entity_seq", "dxftype", "layer", "handle", "block_name", "text", "points", "closed", "xtags")


def dwg_version(content: Column) -> Column:
    """Release of a DWG file by its first six bytes; unknown marks as they are, null for other files."""
    mark = F.decode(F.substring(content, 1, 6), "UTF-8")
    known = F.try_element_at(F.create_map(*(F.lit(x) for p in DWG_VERSIONS.items() for x in p)), mark)
    return F.when(F.startswith(mark, F.lit("AC")), F.coalesce(known, mark))
