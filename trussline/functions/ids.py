"""Identifiers: stable hashes, name-based GUIDs and their 22-character form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name spaces of name-based GUIDs, and the 64 digits of the short form.
URL_SPACE, DNS_SPACE = "6ba7b8119dad11d180b400c04fd430c8", "6ba7b8109dad11d180b400c04fd430c8"
GUID_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"


def stable_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of the columns as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def plan_id(token: Column) -> Column:
    return F.concat(F.lit("plan_"), F.substring(token, 1, 12))


def guid_hex(seed: Column, space: str = URL_SPACE) -> Column:
    """The 32 hex digits of the version-5 GUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(seed, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def guid(seed: Column, space: str = URL_SPACE) -> Column:
    """With dashes; null for a null name, so that callers need no condition, in which shared parts are computed again."""
    h = guid_hex(seed, space)
    first, *rest = (F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.concat(first, *(x for part in rest for x in (F.lit("-"), part)))


def short_guid(value: Column) -> Column:
    """22 digits of base 64, high digits first, of a GUID with or without dashes."""
    h = F.concat(F.lit("0"), F.replace(value, F.lit("-"), F.lit("")))
    groups = [F.conv(F.substring(h, 3 * i + 1, 3), 16, 10).cast("int") for i in range(11)]
    digit = lambda n: F.substring(F.lit(GUID_DIGITS), n + 1, F.lit(1))
    return F.concat(*(d for g in groups for d in (digit(F.shiftright(g, 6)), digit(g.bitwiseAND(F.lit(63))))))


def element_id(storey_id: Column, ifc_type: Column, seed: Column) -> Column:
    return F.concat_ws("_", storey_id, F.lower(ifc_type), F.substring(guid_hex(seed, DNS_SPACE), 1, 8))


def sequence_id(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "_%04d", number)
