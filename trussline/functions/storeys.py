"""Storeys: keys read from titles and names, their order, elevation and display, and the views that show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_case, found, holds

# Numerals of floor titles, each at its value.
NUMERALS = "零一二三四五六七八九十"
FLOOR = r"([一二三四五六七八九十\d]+)"


def _digit(c: Column) -> Column:
    """Value of one numeral; null for anything else."""
    return F.when((F.char_length(c) == 1) & F.contains(F.lit(NUMERALS), c), F.instr(F.lit(NUMERALS), c) - 1)


def chinese_floor(token: Column) -> Column:
    """Number of a floor numeral up to 99 (十二 is 12); null if it is none."""
    at = F.instr(token, "十")
    left, right = F.substring(token, F.lit(1), at - 1), F.substring(token, at + 1, F.char_length(token))
    tens = F.when(at == 1, F.lit(1)).otherwise(F.coalesce(_digit(left), F.lit(0)))
    return F.when(at > 0, tens * 10 + F.coalesce(_digit(right), F.lit(0))).otherwise(_digit(token))


def _number(token: Column) -> Column:
    return F.coalesce(token.try_cast("long"), chinese_floor(token).cast("long")).cast("string")


def storey_key(text: Column) -> Column:
    """RF, B<n> or <n>F named by a text; null if it names none. The first rule that gives a storey decides."""
    t = F.trim(text)
    low = F.lower(t)
    below = found(t, r"(?:地下|负)\s*" + FLOOR + r"\s*层")
    return F.coalesce(
        F.when(holds(low, ("roof", "rf")) | F.contains(t, F.lit("屋面")), F.lit("RF")),
        F.concat(F.lit("B"), found(low, r"(?:b|地下)\s*([1-9]\d*)")),
        F.concat(F.lit("B"), _number(below)),
        F.concat(found(t, r"([1-9]\d*)\s*[fF](?![a-z])"), F.lit("F")),
        F.concat(_number(found(t, FLOOR + r"\s*层")), F.lit("F")),
        F.when(F.contains(t, F.lit("首层")), F.lit("1F")),
    )


def storey_order(key: Column) -> Column:
    """Sort key of a storey: basements from the deepest, floors, roof, anything else."""
    k = F.upper(key)
    pair = lambda group, n: F.struct(F.lit(group).alias("grp"), n.cast("long").alias("n"))
    return first_case(
        [
            (k == "RF", pair(2, F.lit(0))),
            (k.rlike(r"^B\d+$"), pair(0, -F.substring(k, 2, 20).try_cast("long"))),
            (k.rlike(r"^\d+F$"), pair(1, F.rtrim(k, F.lit("F")).try_cast("long"))),
        ],
        pair(3, F.lit(0)),
    )


def storey_name(key: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(key), F.lit("")), F.lit("1F"))


def storey_elevation(key: Column, floor_index: Column, floors: Column, standard: Column, first: Column) -> Column:
    """Elevation in metres of a storey; storeys of no known kind follow their index."""
    k = F.upper(key)
    n = F.regexp_extract(k, r"(\d+)", 1).try_cast("double")
    upper = lambda i: F.when(i <= 0, F.lit(0.0)).otherwise(first + (i - 1) * standard)
    return first_case([(k == "RF", first + F.greatest(floors - 1, F.lit(0)) * standard), (k.rlike(r"^B\d+$"), -n * standard), (k.rlike(r"^\d+F$"), upper(n - 1))], upper(floor_index))


def view_role(name: Column) -> Column:
    """View that an asset's name tells; null if it tells none."""
    low = F.lower(name)
    return first_case(
        [
            (holds(low, ("section",)) | holds(name, ("剖面",)), F.lit("section")),
            (holds(low, ("elevation",)) | holds(name, ("立面",)), F.lit("facade")),
            (holds(low, ("plan", "floor")) | holds(name, ("平面",)), F.lit("plan")),
        ]
    )


def candidate_scores(name: Column) -> tuple[Column, Column, Column]:
    """Points that a candidate's name gives to plan, section and facade."""
    low = F.lower(name)
    point = lambda c, n=1: F.when(c, F.lit(n)).otherwise(F.lit(0))
    plan = point(storey_key(name).isNotNull(), 3) + point((low == "standard_floor") | holds(low, ("plan", "floor")) | holds(name, ("平面",)))
    return plan, point((low == "section_reference") | holds(low, ("section",)) | holds(name, ("剖面",))), point((low == "facade_reference") | holds(low, ("elevation",)) | holds(name, ("立面",)))


def fragment_role(title: Column) -> Column:
    low = F.lower(title)
    return first_case([(holds(title, ("剖面",)) | holds(low, ("section",)), F.lit("section")), (holds(title, ("立面",)) | holds(low, ("elevation",)), F.lit("facade"))], F.lit("plan"))


def entity_storey(fragment_key: Column, own_key: Column) -> Column:
    return F.coalesce(F.nullif(fragment_key, F.lit("")), F.nullif(own_key, F.lit("")), F.lit("1F"))


def fragment_storey(own_key: Column, title: Column, asset_name: Column) -> Column:
    return F.coalesce(F.nullif(own_key, F.lit("")), storey_key(title), storey_key(asset_name), F.lit("1F"))
