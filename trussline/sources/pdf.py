"""Extracted PDF pages: vector items and text blocks as entities and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text


def vector_entities(items: DataFrame) -> DataFrame:
    """Entities of vector items (operator, layer, x0, y0, x1, y1): lines by their layer's role, areas by role or shape."""
    role = text.semantic_role(F.coalesce(F.nullif(F.trim("layer"), F.lit("")), F.lit("PDF-VECTOR")))
    line, area = F.col("operator") == "l", F.col("operator").isin("re", "qu", "c", "v", "y")
    lines = F.when(role == "wall", F.lit("wall_line")).when(role == "facade", F.lit("facade_line")).otherwise(F.lit("vector_line"))
    areas = F.when(role.isin("room", "space"), F.lit("room_boundary")).when(role == "site_boundary", F.lit("site_boundary")).when(F.col("operator") == "re", F.lit("block_region")).otherwise(F.lit("vector_outline"))
    rows = items.where(line | area).withColumn("category", F.when(line, lines).otherwise(areas))
    sure = F.when(F.col("category") == "vector_line", F.lit(0.55)).when(line, F.lit(0.7)).when(F.col("category") == "vector_outline", F.lit(0.58)).otherwise(F.lit(0.72))
    ends = F.array(geometry.point(F.col("x0"), F.col("y0")), geometry.point(F.col("x1"), F.col("y1")))
    box = geometry.box_of_rect(*(f(a, b) for f, a, b in ((F.least, "x0", "x1"), (F.least, "y0", "y1"), (F.greatest, "x0", "x1"), (F.greatest, "y0", "y1"))))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return rows.withColumns({"confidence": sure, "points": F.when(line, ends).otherwise(none), "bbox": box})


def text_annotations(blocks: DataFrame) -> DataFrame:
    """Annotations of text blocks (page_index, text): `page N: text`, tagged by the text itself."""
    body = text.normalize_text(F.col("text"))
    return blocks.where(body != "").withColumns({"semantic_tag": text.text_tag(body, F.lit(None).cast("string")), "text": F.concat(F.lit("page "), (F.col("page_index") + 1).cast("string"), F.lit(": "), body)})
